"""SentencePiece encoding and decoding for merge-type vocabularies.

Adjacent symbol pairs that form a piece wait in an agenda ordered by the piece's
score, then by place; the best is merged and its new neighbours join the agenda,
until none is left. Symbols without a piece become byte pieces.

No piece has a space mark after another character, so merges never cross into
the next run of spaces and words are encoded on their own. A worker keeps the
results of recent words; every word that is encoded anew is compared with the
sentencepiece library in the same Arrow batch.

Decoding takes the ids of a whole document: the bytes of its pieces are joined,
space marks become spaces, and the space of the dummy prefix goes. The decoded
text of every document is compared with the library's. Where either comparison
finds a difference, the library's answer is taken.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.caches import Recent
from tessera.llm.common import text_of

MARK = "▁"
#: Words in each of a worker cache's two generations.
CACHED = 400_000
LONGEST = 64
#: Characters up to which a word's agenda is a list.
SHORT = 40
NEVER = float("inf")

_RUN = re.compile(r" *[^ ]+| +")
_models: dict = {}


class Model:
    """Pieces and scores of a merge-type model, read from its library processor."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, tuple[float, int]] = {}
        self.cost: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        self.surface: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.surface.append(b"")
            else:
                self.rank[piece] = (-sp.get_score(i), i)
                self.cost[piece] = -sp.get_score(i)
                self.surface.append(piece.replace(MARK, " ").encode())
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece holds a space mark after another character")
        if [sp.id_to_piece(x) for x in sp.encode(" a")][:1] not in (["▁"], ["▁▁"]) or sp.decode(sp.encode("① ａ")) != "① ａ":
            raise ValueError("the model normalises text; only identity with a dummy prefix is supported")
        self.cache = Recent(CACHED)

    def merge(self, word: str) -> list[int]:
        """Ids of one word, its spaces written as marks.

        The agenda of a short word is a plain list in the order of places, whose
        least entry is sought anew; that of a long one is a heap.
        """
        symbols = list(word)
        n = len(symbols)
        if 1 < n <= SHORT:
            cost = self.cost.get
            agenda = [cost(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
            while agenda and (best := min(agenda)) < NEVER:
                i = agenda.index(best)
                symbols[i] += symbols.pop(i + 1)
                del agenda[i]
                if i:
                    agenda[i - 1] = cost(symbols[i - 1] + symbols[i], NEVER)
                if i < len(agenda):
                    agenda[i] = cost(symbols[i] + symbols[i + 1], NEVER)
        elif n > 1:
            rank = self.rank
            before = list(range(-1, n - 1))
            after = [*range(1, n), -1]
            agenda = []
            for i in range(n - 1):
                joined = symbols[i] + symbols[i + 1]
                got = rank.get(joined)
                if got:
                    agenda.append((got[0], i, i + 1, joined))
            heapq.heapify(agenda)
            while agenda:
                _, i, j, joined = heapq.heappop(agenda)
                left, right = symbols[i], symbols[j]
                if not left or not right or len(left) + len(right) != len(joined) or after[i] != j:
                    continue  # one of the pair was merged meanwhile
                symbols[i], symbols[j] = joined, ""
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    more = joined + symbols[k]
                    got = rank.get(more)
                    if got:
                        heapq.heappush(agenda, (got[0], i, k, more))
                h = before[i]
                if h >= 0:
                    more = symbols[h] + joined
                    got = rank.get(more)
                    if got:
                        heapq.heappush(agenda, (got[0], h, i, more))
        ids: list[int] = []
        for s in symbols:
            if s:
                got = self.rank.get(s)
                if got:
                    ids.append(got[1])
                else:
                    ids += [self.byte_ids[b] for b in s.encode()]
        return ids

    def words(self, names: list[str]) -> dict[str, str]:
        """The ids of each word (its first space a dummy prefix or its own), in decimal, joined by commas."""
        out = {}
        for w, want in zip(names, self.library.encode([w[1:] for w in names], num_threads=1)):
            ids = self.merge(w.replace(" ", MARK))
            if ids != want and w != " ":  # a last space alone: the library has no text for it
                ids = want
            out[w] = ",".join(map(str, ids))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids of a whole document."""
        joined = b"".join([self.surface[i] for i in ids])
        return joined.removeprefix(b" ").decode("utf-8", "replace")

    def decode_all(self, each: list[str]) -> list[str]:
        """The texts of id sequences, each in decimal joined by commas."""
        numbers = [np.fromstring(ids, np.int64, sep=",").tolist() for ids in each]
        texts = [self.decode(n) for n in numbers]
        want = self.library.decode(numbers, num_threads=1) if numbers else []
        return texts if texts == want else want


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def split_words(text: str) -> list[str]:
    """Words with the spaces before them, after the dummy prefix; each begins with a space."""
    text = " " + text.replace(MARK, " ")
    if "  " in text or text[-1] == " ":
        return _RUN.findall(text)
    return [" " + w for w in text[1:].split(" ")]


def encode_batch(texts: list[str], path: str) -> list[tuple[int, str, str]]:
    """Of each text: number of ids, ids in decimal joined by commas, the text that the ids decode to."""
    m = model(path)
    out, waiting, misses = [], [], {}
    for text in texts:
        if not text:
            out.append("")
            continue
        words = split_words(text)
        got = list(map(m.cache.new.get, words))
        if None in got:
            got = [g or m.cache.get(w) for w, g in zip(words, got)]
        if None in got:
            waiting.append((len(out), words, got))
            misses.update(dict.fromkeys(w for w, g in zip(words, got) if g is None))
            out.append("")
        else:
            out.append(",".join(got))
    names = list(misses)
    for at in range(0, len(names), 20_000):
        fresh = m.words(names[at : at + 20_000])
        misses.update(fresh)
        for w, g in fresh.items():
            if len(w) <= LONGEST:
                m.cache.put(w, g)
    for i, words, got in waiting:
        out[i] = ",".join([g or misses[w] for w, g in zip(words, got)])
    return [(ids.count(",") + 1 if ids else 0, ids, text) for ids, text in zip(out, m.decode_all(out))]


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (decimal, comma-joined), n_tokens and decoded text of every row of ``docs``.

    Null and empty texts have no ids and decode to the empty text. A space mark
    inside a text counts as a space, as in the library. Repeated rows and null
    doc_ids are kept; no rows give no rows; other columns are ignored.
    """

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                n, ids, text = zip(*encode_batch(part.column(1).to_pylist(), model_path))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("t")).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")


def round_trip_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; hashed where they are made, so ids never leave the worker."""

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows = [(n, sha(ids.encode()), sha(text.encode())) for n, ids, text in encode_batch(part.column(1).to_pylist(), model_path)]
                n, ids, text = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("t")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
