"""Token counts by a two-tier lookup on the map side.

The first tier is a broadcast table with the token counts of frequent
pre-tokens, at most ``FREQUENT`` of them, taken from a bounded sample. The
second is a cache in each Python worker; what it lacks is encoded by the
tokenizer library in one call for each Arrow batch. There is no shuffle of
pre-tokens: documents are read once and only counts leave the task.

Texts are cut before each single space that has no white space beside it. The
byte-level pattern starts a pre-token at every such space, so counts of these
pieces add up to the count of the text; longer runs of white space stay inside a
piece. Only texts with a special string go to the library whole, as special
strings may reach over a space.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.caches import Recent
from tessera.llm.common import text_of

#: Pre-tokens in the broadcast table: some 10 MB at most, as longer ones than LONGEST stay out.
FREQUENT = 50_000
LONGEST = 32
#: Rows that the sample for the table may have, and characters taken from each.
SAMPLE_ROWS = 1_000
SAMPLE_CHARS = 20_000
#: Pre-tokens in each of a worker cache's two generations.
CACHED = 300_000

#: Of each batch of misses, about so many are compared with the tokenizers library.
CHECKED = 50
#: Fixed value: the byte-level pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ADJOINING = re.compile(r"\s\s|^ | $")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict = {}


def _byte_of() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Lengths:
    """The tokenizers library's file, a fast merger over the same ranks, and the worker's cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.special = [x.content for x in t.get_added_tokens_decoder().values()]
        self.cache = Recent(CACHED)
        self.fast = self._merger(path)

    def _merger(self, path: str):
        """A byte-pair merger for byte-level files whose ids follow their merges; else None."""
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        kind, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if kind["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            return None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in kind["merges"]]
        ids = [kind["vocab"][a + b] for a, b in merges]
        if ids != sorted(ids) or any(kind.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in kind["vocab"].items() if token not in self.special}
        return tiktoken.Encoding("merger", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, names: list[str]) -> list[int]:
        if self.fast is None:
            return [len(e.ids) for e in self.library.encode_batch(names, add_special_tokens=False)]
        counts = [len(self.fast.encode_ordinary(x)) for x in names]
        step = max(1, len(names) // CHECKED)
        for x, n in zip(names[::step], counts[::step]):
            if len(self.library.encode(x, add_special_tokens=False).ids) != n:
                self.fast = None  # from now on the library counts
                return self.encode(names)
        return counts


def _tokenizer(path: str) -> Lengths:
    """Kept for the worker's life."""
    if path not in _loaded:
        _loaded[path] = Lengths(path)
    return _loaded[path]


def pieces(text: str) -> list[str]:
    """The text cut before each single space between other characters than white space; the pieces joined give the text."""
    first, *rest = _CUT.split(text) if _ADJOINING.search(text) else text.split(" ")
    return ([first] if first else []) + [" " + x for x in rest]


def count_batch(texts: list[str], path: str, frequent: dict[str, int]) -> list[int]:
    """Tokens of each text, equal to the library's counts without special tokens added."""
    t = _tokenizer(path)
    counted, odd, misses, waiting = [0] * len(texts), [], {}, []
    for i, text in enumerate(texts):
        if any(x in text for x in t.special):
            odd.append(i)
            continue
        names = pieces(text)
        got = list(map(frequent.get, names))
        if None in got:
            tier2 = t.cache.get
            got = [tier2(x) if n is None else n for x, n in zip(names, got)]
            missed = [x for x, n in zip(names, got) if n is None]
            if missed:
                waiting.append((i, missed))
                misses.update(dict.fromkeys(missed))
                got = filter(None, got)
        counted[i] = sum(got)
    names = list(misses)
    for at in range(0, len(names), 20_000):
        part = names[at : at + 20_000]
        for piece, n in zip(part, t.encode(part)):
            misses[piece] = n
            if len(piece) <= 4 * LONGEST:
                t.cache.put(piece, n)
    for i, missed in waiting:
        counted[i] += sum(map(misses.__getitem__, missed))
    for i in odd:
        counted[i] = len(t.library.encode(texts[i], add_special_tokens=False).ids)
    return counted


def frequent_pieces(docs: DataFrame, path: str) -> dict[str, int]:
    """Token counts of the commonest short pre-tokens of a bounded sample; it decides speed only."""
    rows = docs.select(F.substring(text_of(), 1, SAMPLE_CHARS).alias("t")).limit(SAMPLE_ROWS).collect()
    seen: Counter = Counter()
    special = _tokenizer(path).special
    for row in rows:
        seen.update(x for x in pieces(row["t"]) if len(x) <= LONGEST and not any(s in x for s in special))
    names = [x for x, _ in seen.most_common(FREQUENT)]
    return dict(zip(names, _tokenizer(path).encode(names)))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null
    doc_ids are counted like others; no rows give no rows; other columns are
    ignored. ``tokenizer`` is a tokenizers JSON file present on every node.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, tokenizer))

    def run(batches):
        for b in batches:
            n = count_batch(b.column(2).to_pylist(), tokenizer, table.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(n, np.int64))], ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select(F.col("doc_id").cast("long"), F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("t"))
    counted = sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
