"""Removal of byte strings that occur more than once, by a distributed suffix sort.

Suffixes count by their first ``WIDTH`` bytes. Those that may have an equal are
first narrowed down (see ``repeats``): stretches that repeat as a whole need no
sort, and suffixes whose anchor occurs once have no equal. The others go, with
the stretch of text they start in, to buckets that are range-partitioned by
splitters over the anchor's ``GRAM`` leading bytes, sampled from those stretches
themselves, so a common opening is cut further on. Each bucket sorts the suffixes
of its stretches by multikey quicksort, eight bytes to a character, and compares
neighbours. Equal suffixes have equal anchors, and splitters cut between anchors,
never inside one, so equal suffixes share a bucket and boundaries hide none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import raw_text, same
from tessera.llm.repeats import U, Windows, attach, byte_blocks, covered, keyed, repeated

#: Bytes that make a suffix count as repeated, and bytes of an anchor.
WIDTH = 200
GRAM = 40
#: Open stretches that the splitters are sampled from, about.
SAMPLE = 20_000


def leading(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one character that sorts like them."""
    out = np.zeros(len(at), U)
    for i in range(8):
        out = out << U(8) | raw[at + i].astype(U)
    return out


def splitters(texts: DataFrame, still: DataFrame, buckets: int, gram: int = GRAM) -> np.ndarray:
    """Anchors that cut a bounded sample of the open stretches evenly. They decide balance only."""
    some = still.where("not phrase.hot").select("doc_id", "h", (F.col("phrase.pos") + F.shiftright("phrase.n", 16) + 1).cast("int").alias("at"))
    total = some.count()
    some = some.sample(fraction=min(1.0, SAMPLE / max(1, total)), seed=7).limit(2 * SAMPLE)
    rows = texts.join(F.broadcast(some), same(texts, some, "doc_id", "h")).select(F.substring("t", F.col("at"), F.lit(gram)).alias("lead")).toArrow()
    seen = np.sort(np.array(rows["lead"].to_pylist(), f"S{gram}"))
    return np.unique(seen[np.linspace(0, len(seen) - 1, buckets + 1).astype(int)[1:-1]]) if len(seen) else seen


def multikey_order(first: np.ndarray, following: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey quicksort: order by the first character, then only ties by the next, and so on.

    ``following`` maps entries to their next character. Gives the order, the begin
    of each group of equals, and each entry's group.
    """
    n = len(first)
    order = np.argsort(first, kind="quicksort")
    lead = first[order]
    new = np.r_[True, lead[1:] != lead[:-1]][:n]
    for character in following:
        begin = np.flatnonzero(new)
        size = np.diff(np.r_[begin, n])
        at = np.flatnonzero(np.repeat(size > 1, size))
        if not len(at):
            break
        group = (np.cumsum(new) - 1)[at]
        key = character(order[at])
        inner = np.lexsort((key, group))
        order[at] = order[at][inner]
        k, g = key[inner], group[inner]
        new[at] = np.r_[True, (k[1:] != k[:-1]) | (g[1:] != g[:-1])]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _whole(t: bytes):
    return lambda lo, hi: t[lo:hi]


def repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, h, spans) of documents with repeated byte strings."""
    def buckets_by(texts: DataFrame, still: DataFrame, buckets: int):
        cuts = splitters(texts, still, buckets, gram)
        return lambda a, ahead: np.searchsorted(cuts, np.array(ahead, cuts.dtype), side="right")

    def equal(contexts: list[bytes], w: Windows):
        raw = np.frombuffer(b"".join([*contexts, bytes(8)]), np.uint8)
        sizes = np.array([len(x) for x in contexts])
        at = (np.cumsum(sizes) - sizes)[w.row] + w.pos
        last = max(0, width - 8)
        places = [*range(8, last, 8), last] if last else []
        following = [lambda e, k=k: leading(raw, at[e] + k) for k in places]
        first = leading(raw, at) if width >= 8 else leading(raw, at) >> U(8 * (8 - width))
        return multikey_order(first, following)

    return repeated(docs, byte_blocks, width, gram, _whole, buckets_by, equal)


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row of ``docs``.

    Without ``texts``, kept is null.
    A byte goes if a ``width``-byte string over it also starts elsewhere in the
    corpus, the same document included. Null and empty texts keep no bytes.
    Repeated rows are copies of each other and go whole if long enough. Null
    doc_ids are kept; no rows give no rows; other columns are ignored.
    """
    whole = attach(keyed(docs), repeated_bytes(docs, width, gram), "left").select("doc_id", "t", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 250):
                part, rows = b.slice(lo, 250), []
                for t, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    runs, kept, at = covered(spans, width), [], 0
                    for begin, end in runs:
                        kept.append(t[at:begin])
                        at = end
                    kept = b"".join([*kept, t[at:]])
                    rows.append((len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if texts else None))
                n, gone, parts, sha, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(parts, pa.int64()), pa.array(sha), pa.array(kept, pa.binary())], names)

    return whole.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
