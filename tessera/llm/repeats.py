"""Windows of symbols that start more than once in a corpus, found without all-pairs work.

A symbol is a byte or a word. A window is ``width`` symbols of one document.

* Each window has an anchor: of its ``gram``-symbol strings, the one with the
  least hash (the first of equals). It depends on the window's content alone, so
  equal windows have equal anchors at equal offsets.
* Consecutive windows with the same anchor form a phrase. A document is the
  sequence of its phrases, about two for every ``width - gram`` symbols.
* Phrases are looked up by anchor and content. A phrase that occurs again is
  repeated as a whole. One that does not, but whose anchor occurs in another
  phrase, may repeat in part and stays open, as does one phrase of each repeated
  content of that anchor. Any other phrase has no repeated window.
* Open phrases with their text meet by anchor, and their windows are compared
  one by one. The windows of an anchor with more than ``HOT`` open phrases are
  dealt by their own content instead.

A worker merges equal entries of a batch before they leave it, so a key sends
one entry from each batch however often it occurs, and entries that are settled
there are dealt evenly. Where an anchor has several phrases in one batch, these
are dealt by content, with a witness for the anchor; thus no anchor and no
phrase can fill a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bucket_ids, raw_text, stored

U = np.uint64
#: Symbols that are worked on at once, entries that a worker gathers before it sends them.
BLOCK = 200_000
GATHER = 250_000

#: Kinds of entries: phrase by anchor, settled span, phrase by content, witness; NULL_ID marks a null doc_id.
BY_ANCHOR, SETTLED, BY_CONTENT, WITNESS, NULL_ID = 0, 1, 2, 3, 128
FIELDS = (("kind", np.uint8), ("times", np.uint8), ("n", np.uint32), ("pos", np.uint32), ("a", U), ("c", U), ("doc", np.int64), ("h", np.int64))
#: Open phrases of one anchor that may meet in one bucket.
HOT = 256
#: Hot anchors that are broadcast at most, 16 MB; with more they are joined by a shuffle.
BROADCAST_HOT = 1_000_000
OUT = "doc_id long, h long, pos long, n long, settled boolean, a long"
OPEN = "bucket long, entries binary, doc_id long, h long, pos long, ctx binary"
SPANS = "doc_id long, h long, span long"


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, U(_BASE))
    down = np.full(n, U(pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Rolling:
    """Hashes of any run of symbols, from prefix sums of a polynomial."""

    def __init__(self, symbols: np.ndarray):
        size = 1 << max(18, int(len(symbols)).bit_length())
        up, self.down = _powers(size)
        self.sums = np.empty(len(symbols) + 1, U)
        self.sums[0] = 0
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        """The hash of every run of ``length`` symbols."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(U).max, U)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


@dataclass
class Block:
    """Symbols of some documents or of one stretch of a long one."""

    symbols: np.ndarray
    row: np.ndarray  # of each symbol, the document's row in its batch
    pos: np.ndarray  # of each symbol, its place in the document
    raw: np.ndarray | None = None


Blocks = Callable[[list, int], Iterator[Block]]


def byte_blocks(texts: list[bytes], width: int) -> Iterator[Block]:
    for rows, joined, sizes in _packed(texts, b""):
        raw = np.frombuffer(joined, np.uint8)
        row = np.repeat(rows, sizes)
        pos = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for lo in range(0, max(1, len(raw) - width + 1), BLOCK):
            cut = slice(lo, lo + BLOCK + width - 1)
            yield Block(_BYTE[raw[cut]], row[cut], pos[cut], raw[cut])


def word_blocks(texts: list[bytes], width: int) -> Iterator[Block]:
    for rows, joined, sizes in _packed(texts, b"\n"):
        start, end = word_bounds(joined)
        symbols = word_hashes(joined, start, end)
        begin = np.cumsum(sizes) - sizes
        of = np.searchsorted(begin, start, side="right") - 1
        pos = np.arange(len(of)) - np.searchsorted(of, of)
        row = rows[of]
        for lo in range(0, max(1, len(symbols) - width + 1), BLOCK):
            cut = slice(lo, lo + BLOCK + width - 1)
            yield Block(symbols[cut], row[cut], pos[cut])


def _packed(texts: list[bytes], between: bytes, most: int = 500_000) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
    """Rows, joined bytes and sizes (with what stands between) of some documents at a time."""
    held, rows, size = [], [], 0
    for i, t in enumerate(texts):
        held.append(t)
        rows.append(i)
        size += len(t) + len(between)
        if size >= most or i == len(texts) - 1:
            yield np.array(rows), between.join([*held, b""]), np.array([len(x) + len(between) for x in held])
            held, rows, size = [], [], 0


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    gap = np.r_[True, _GAP[np.frombuffer(text, np.uint8)], True]
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def word_hashes(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), U)
    step = 1 << 17
    for lo in range(0, len(start), step):
        s, e = start[lo : lo + step], end[lo : lo + step]
        roll = Rolling(_BYTE[np.frombuffer(text, np.uint8)[s[0] : e[-1]]])
        out[lo : lo + step] = mix(roll.runs(s - s[0], e - s[0]) + (e - s).astype(U))
    return out


def phrases(block: Block, width: int, gram: int, roll: Rolling | None = None) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, first symbol, number of windows and anchor's place of each phrase of a block."""
    n = len(block.symbols)
    if n < width:
        return (np.empty(0, U),) * 2 + (np.empty(0, np.int64),) * 3
    roll = roll or Rolling(block.symbols)
    grams = mix(roll.all(gram))
    low = U((1 << 24) - 1)
    anchor = (sliding_min(grams & ~low | np.arange(len(grams), dtype=U), width - gram + 1) & low).astype(np.int64)
    within = block.row[: n - width + 1] == block.row[width - 1 :]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | ~within[:-1]]
    first = np.flatnonzero(within & new)
    stop = np.flatnonzero(within & np.r_[new[1:] | ~within[1:], True]) + 1
    at = anchor[first]
    content = mix(roll.runs(first, stop + width - 1) ^ mix((stop - first).astype(U) << U(32) | (at - first).astype(U)))
    return grams[at], content, first, stop - first, at - first


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that brings equal keys together, begin of each group in it, and each entry's group."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def pack(rec: dict[str, np.ndarray], buckets: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket: its entries, field after field."""
    order = np.argsort(buckets, kind="stable")
    names, begin = np.unique(buckets[order], return_index=True)
    sorted_ = [rec[f][order].astype(t, copy=False) for f, t in FIELDS]
    ends = [*begin[1:], len(order)]
    blobs = [b"".join([x[lo:hi].tobytes() for x in sorted_]) for lo, hi in zip(begin, ends)]
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "entries"])


def unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    each = sum(np.dtype(t).itemsize for _, t in FIELDS)
    parts: dict[str, list] = {f: [] for f, _ in FIELDS}
    for b in blobs:
        n, at = len(b) // each, 0
        for f, t in FIELDS:
            parts[f].append(np.frombuffer(b, t, n, at))
            at += n * np.dtype(t).itemsize
    return {f: np.concatenate(x) for f, x in parts.items()}


def _send(held: list[dict], ids: np.ndarray, bucket_of: Callable | None) -> pa.RecordBatch:
    """Merge equal entries of a batch. The content key is ``c``; ``a`` is the anchor, or part of the key."""
    buckets = len(ids)
    rec = {f: np.concatenate([h[f] for h in held]) for f, _ in FIELDS}
    order, begin, group = groups(rec["a"], rec["c"])
    times = np.diff(np.r_[begin, len(order)])
    settled = order[times[group] > 1]
    lead = order[begin]
    parts = [{f: x[settled] for f, x in rec.items()}, {f: x[lead] for f, x in rec.items()}]
    if bucket_of is not None:
        parts[0] = _joined_windows(parts[0])
    parts[0]["kind"] = parts[0]["kind"] | np.uint8(SETTLED)
    parts[0]["a"] = parts[0]["c"] = np.zeros(len(parts[0]["pos"]), U)
    parts[1]["times"] = np.minimum(times, 2).astype(np.uint8)
    even = mix(parts[0]["h"].astype(U) + parts[0]["pos"].astype(U)) % U(buckets)
    if bucket_of is not None:
        by = bucket_of(parts[1])
    else:
        a = parts[1]["a"]  # in order
        fresh = np.r_[True, a[1:] != a[:-1]]
        several = (np.diff(np.r_[np.flatnonzero(fresh), len(a)]) > 1)[np.cumsum(fresh) - 1]
        parts[1]["kind"] = np.where(several, parts[1]["kind"] | np.uint8(BY_CONTENT), parts[1]["kind"])
        by = np.where(several, parts[1]["c"], a) % U(buckets)
        told = np.flatnonzero(several & fresh)
        parts.append({f: x[told] for f, x in parts[1].items()})
        parts[2]["kind"] = np.full(len(told), WITNESS, np.uint8)
        for f in ("c", "doc", "h", "n", "pos"):
            parts[2][f] = np.zeros_like(parts[2][f])
        by = np.r_[by, parts[2]["a"] % U(buckets)]
    whole = {f: np.concatenate([p[f] for p in parts]) for f, _ in FIELDS}
    return pack(whole, ids[np.r_[even, by].astype(np.int64)])


def _joined_windows(rec: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Neighbouring windows of a document as one entry with their number."""
    order = np.lexsort((rec["pos"], rec["h"], rec["doc"], rec["kind"]))
    doc, h, kind, pos = (rec[f][order] for f in ("doc", "h", "kind", "pos"))
    new = np.arange(len(order)) % 1_000_000 == 0  # a number of windows has 24 bits
    new[1:] |= (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (kind[1:] != kind[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(new)
    return {f: x[order[first]] for f, x in rec.items()} | {"n": np.diff(np.r_[first, len(order)])}


def ids_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc ids (null: 0), text hashes and the null flag of the rows of a batch."""
    ids = b.column("doc_id")
    return np.asarray(ids.fill_null(0)), np.asarray(b.column("h")), np.where(np.asarray(ids.is_null()), np.uint8(NULL_ID), np.uint8(0))


def phrase_entries(docs: DataFrame, blocks: Blocks, width: int, gram: int, ids: np.ndarray) -> DataFrame:
    def run(batches):
        held, count = [], 0
        for b in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            doc, h, null = ids_of(b)
            for block in blocks(b.column("t").to_pylist(), width):
                a, c, first, n, place = phrases(block, width, gram)
                row = block.row[first]
                held.append({"kind": null[row], "times": np.ones(len(a), np.uint8), "n": place << 16 | n, "pos": block.pos[first], "a": a, "c": c, "doc": doc[row], "h": h[row]})
                count += len(a)
                if count >= GATHER:
                    yield _send(held, ids, None)
                    held, count = [], 0
        if count:
            yield _send(held, ids, None)

    return docs.mapInArrow(run, "bucket long, entries binary")


@dataclass
class Windows:
    """All windows of some open phrases: phrase, place in it, and what the windows are compared by."""

    row: np.ndarray
    pos: np.ndarray
    a: np.ndarray
    c: np.ndarray


def windows_of(contexts: list[bytes], blocks: Blocks, width: int, gram: int) -> Windows:
    parts = []
    for block in blocks(contexts, width):
        n = len(block.symbols) - width + 1
        if n < 1:
            continue
        at = np.flatnonzero(block.row[:n] == block.row[width - 1 :])
        roll = Rolling(block.symbols)
        parts.append((block.row[at], block.pos[at], mix(roll.runs(at, at + gram)), mix(roll.runs(at, at + width))))
    if not parts:
        return Windows(*(np.empty(0, np.int64),) * 2, *(np.empty(0, U),) * 2)
    return Windows(*(np.concatenate(x) for x in zip(*parts)))


def open_phrases(found: DataFrame, blocks: Blocks, width: int, gram: int, ids: np.ndarray, cut: Callable, bucket_of: Callable) -> DataFrame:
    """Open phrases (column ``open``) with their text, or the entries of their windows where the anchor is hot.

    ``cut`` gives the text of symbols lo to hi of a document; ``bucket_of`` the
    buckets of phrases by anchor hash and by the text from the anchor on. Of equal
    rows a task sends one: whatever two of them have in common is settled.
    """

    def rows_of(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc, h, null = ids_of(b)
        cold, hot = [], []
        for i, (t, places) in enumerate(zip(b.column("t").to_pylist(), b.column("open").to_pylist())):
            text = cut(t)
            for x in places:
                n, place = x["n"] & 0xFFFF, x["n"] >> 16
                lo, hi = x["pos"], x["pos"] + n + width - 1
                (hot if x["hot"] else cold).append((i, lo, text(lo, hi), x["a"], text(lo + place, min(hi, lo + place + gram))))
        if cold:
            row, pos, ctx, a, ahead = zip(*cold)
            row = np.array(row)
            by = ids[bucket_of(np.array(a, np.int64).view(U), ahead).astype(np.int64)]
            own = pa.array(doc[row], pa.int64(), mask=null[row] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(by), pa.nulls(len(row), pa.binary()), own, pa.array(h[row]), pa.array(pos, pa.int64()), pa.array(ctx, pa.binary())], OPEN_NAMES)
        if hot:
            row, pos, ctx, *_ = zip(*hot)
            row, pos = np.array(row), np.array(pos)
            w = windows_of(list(ctx), blocks, width, gram)
            row, pos = row[w.row], pos[w.row] + w.pos
            rec = {"kind": null[row], "times": np.ones(len(row), np.uint8), "n": np.ones(len(row), np.uint32), "pos": pos, "a": w.a, "c": w.c, "doc": doc[row], "h": h[row]}
            sent = _send([rec], ids, lambda r: r["c"] % U(len(ids)))
            none = pa.nulls(sent.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([sent.column(0), sent.column(1), none, none, none, pa.nulls(sent.num_rows, pa.binary())], OPEN_NAMES)

    def run(batches):
        sent: set[tuple] = set()
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("doc_id", "h"))))
            first = {k: i for i, k in reversed(list(enumerate(keys))) if k not in sent}
            sent.update(first)
            b = b.take(pa.array(sorted(first.values()), pa.int64()))
            for lo in range(0, b.num_rows, 1000):
                yield from rows_of(b.slice(lo, 1000))

    return found.mapInArrow(run, OPEN)


OPEN_NAMES = [x.split()[0] for x in OPEN.split(", ")]


def _out(rec: dict[str, np.ndarray], at: np.ndarray, settled: bool) -> pa.Table:
    null = rec["kind"][at] >= NULL_ID
    return pa.table({"doc_id": pa.array(rec["doc"][at], pa.int64(), mask=null), "h": rec["h"][at], "pos": rec["pos"][at].astype(np.int64), "n": rec["n"][at].astype(np.int64), "settled": np.full(len(at), settled), "a": rec["a"][at].view(np.int64)})


def judge_phrases(t: pa.Table) -> pa.Table:
    """Settled spans of a bucket, and the phrases whose windows are to be compared."""
    rec = unpack(t["entries"].to_pylist())
    kind = rec["kind"] & np.uint8(127)
    done, still = [np.flatnonzero(kind == SETTLED)], []
    for own in (np.flatnonzero((kind == BY_ANCHOR) | (kind == WITNESS)), np.flatnonzero(kind == BY_CONTENT)):
        if not len(own):
            continue
        a, c, k = rec["a"][own], rec["c"][own], kind[own]
        order, begin, group = groups(a, k == WITNESS, c)
        total = np.add.reduceat(rec["times"][own][order].astype(np.int64), begin)
        lead_a, told = a[order][begin], k[order][begin] == WITNESS
        fresh = np.r_[True, lead_a[1:] != lead_a[:-1]]
        of = np.cumsum(fresh) - 1
        several = np.bincount(of)[of] > 1  # a witness counts as another phrase
        if (k == BY_CONTENT).all():
            several[:] = True
        again = (total > 1) & ~told
        at = own[order]
        done.append(at[again[group] & (rec["times"][at] == 1)])
        still.append(at[(~again & several & ~told)[group]])
        still.append(at[begin[again & several]])
    done, still = np.concatenate(done), np.concatenate([*still, np.empty(0, np.int64)]).astype(np.int64)
    return pa.concat_tables([_out(rec, done, True), _out(rec, still, False)])


def judge_open(t: pa.Table, blocks: Blocks, width: int, gram: int, equal: Callable) -> pa.Table:
    """Spans of the windows that occur more than once among a bucket's open phrases and window entries.

    ``equal`` groups the windows of whole phrases: order, begin and group.
    """
    out = []
    whole = t.filter(pc.is_valid(t["ctx"]))
    if whole.num_rows:
        contexts = whole["ctx"].to_pylist()
        w = windows_of(contexts, blocks, width, gram)
        order, begin, group = equal(contexts, w)
        again = np.sort(order[(np.diff(np.r_[begin, len(order)]) > 1)[group]])  # by phrase and place
        row, pos = w.row[again], w.pos[again]
        new = np.r_[True, (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)][: len(again)]
        first = np.flatnonzero(new)
        n = np.diff(np.r_[first, len(again)])
        at = row[first]
        span = np.asarray(whole["pos"])[at] + pos[first] << 24 | n
        out.append(pa.table({"doc_id": whole["doc_id"].take(pa.array(at)), "h": whole["h"].take(pa.array(at)), "span": span}))
    blobs = t.filter(pc.is_valid(t["entries"]))["entries"].to_pylist()
    if blobs:
        rec = unpack(blobs)
        kind = rec["kind"] & np.uint8(127)
        own = np.flatnonzero(kind != SETTLED)
        order, begin, group = groups(rec["a"][own], rec["c"][own])
        total = np.add.reduceat(rec["times"][own][order].astype(np.int64), begin) if len(own) else np.empty(0)
        at = own[order]
        at = np.concatenate([np.flatnonzero(kind == SETTLED), at[(total > 1)[group] & (rec["times"][at] == 1)]])
        one = _out(rec, at, True)
        out.append(pa.table({"doc_id": one["doc_id"], "h": one["h"], "span": np.asarray(one["pos"]) << 24 | np.asarray(one["n"])}))
    return pa.concat_tables(out)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h and t. Rows are told apart by id and text; equal rows get equal results."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(raw_text()).alias("h"), raw_text().alias("t"))


def attach(texts: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Join by document; what was found is the built side, so texts are not sorted."""
    on = texts["doc_id"].eqNullSafe(found["doc_id"]) & (texts["h"] == found["h"])
    return texts.join(found.hint("shuffle_hash"), on, how).drop(found["doc_id"]).drop(found["h"])


def by_hash(buckets: int) -> Callable:
    """Buckets of phrases by the hash of their anchor."""
    return lambda a, ahead: a % U(buckets)


def equal_hashes(contexts: list[bytes], w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return groups(w.a, w.c)


def repeated(docs: DataFrame, blocks: Blocks, width: int, gram: int, cut: Callable, buckets_by: Callable | None = None, equal: Callable = equal_hashes) -> DataFrame:
    """(doc_id, h, spans): the starts of repeated windows of each document that has any.

    A span is a long: the first start, shifted by 24 bits, and the number of starts.
    ``buckets_by`` makes the rule for buckets from all texts and their open phrases.
    """
    ids = bucket_ids(docs.sparkSession)
    texts = keyed(docs)
    sent = phrase_entries(texts, blocks, width, gram, ids)
    judged = stored(sent.groupBy("bucket").applyInArrow(judge_phrases, OUT))
    still = judged.where("not settled")
    hot = stored(still.groupBy("a").count().where(F.col("count") > HOT).select("a", F.lit(True).alias("hot")))
    still = still.join(F.broadcast(hot) if hot.count() <= BROADCAST_HOT else hot, "a", "left").select("doc_id", "h", F.struct("pos", "n", "a", F.coalesce("hot", F.lit(False)).alias("hot")).alias("phrase"))
    found = attach(texts, still.groupBy("doc_id", "h").agg(F.collect_set("phrase").alias("open")), "inner")
    bucket_of = buckets_by(texts, still, len(ids)) if buckets_by else by_hash(len(ids))
    sent = open_phrases(found, blocks, width, gram, ids, cut, bucket_of)
    compared = sent.groupBy("bucket").applyInArrow(lambda t: judge_open(t, blocks, width, gram, equal), SPANS)
    settled = judged.where("settled").select("doc_id", "h", F.shiftleft("pos", 24).bitwiseOR(F.col("n").bitwiseAND(F.lit(0xFFFF))).alias("span"))
    return settled.union(compared).groupBy("doc_id", "h").agg(F.collect_set("span").alias("spans"))


def covered(spans: list[int] | None, width: int) -> list[tuple[int, int]]:
    """Maximal runs of symbols under the windows of ``spans``: (begin, end) in order."""
    out: list[tuple[int, int]] = []
    for x in sorted(spans or ()):
        lo, hi = x >> 24, (x >> 24) + (x & 0xFFFFFF) + width - 1
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out
