"""Relative Lempel-Ziv parsing of a corpus against blocks of itself.

The reference is the whole corpus. It is cut where the anchor of its windows
changes (see ``repeats``), and the pieces, phrases, are dealt by anchor to
reference blocks; the hash of every window of ``width`` words goes with them, so
equal windows share a block. A block indexes all its phrases by a suffix array
over their window hashes, and each phrase is factored greedily against that
index: a factor is the longest run of words from its start that also starts
anywhere else in the block; a word that begins no such run of ``width`` words is
a literal. The next factor is sought from the first window that reaches over the
end of the last one, so none that crosses a boundary between factors is missed,
and a phrase ends ``width - 1`` words after the next one begins, so none that
crosses a boundary between phrases is missed either.

A worker is a small reference block of its own: of equal phrases in a batch only
the first is sent, the others are whole factors with it as their source. Anchors
with more than ``HOT`` phrases are found from one row in ``SAMPLED`` beforehand;
their windows are dealt one by one, by content. Both keep blocks even and decide
no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bucket_ids
from tessera.llm.repeats import NULL_ID, U, Blocks, Rolling, groups, ids_of, keyed, mix, phrases

#: Phrases that a worker gathers before it sends them.
GATHER = 250_000
#: Phrases of one anchor in one block, about; one row in so many is looked at to find anchors with more.
HOT = 4_000
SAMPLED = 16
#: Hot anchors that are broadcast at most, 8 MB: the most frequent ones.
BROADCAST_HOT = 1_000_000

#: Flags of an entry: it is a factor already; the batch holds an equal phrase. NULL_ID marks a null doc_id.
SETTLED, TWIN = 1, 2
FIELDS = (("flags", np.uint8), ("n", np.uint32), ("pos", np.uint32), ("a", U), ("doc", np.int64), ("h", np.int64))
#: Bytes of a window's hash that are sent; it is compared together with the anchor's eight.
HASH = 6


def ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each begin, ``n`` numbers each."""
    n = n.astype(np.int64)
    return np.repeat(begin.astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(n.sum())


def pack(rec: dict[str, np.ndarray], begin: np.ndarray, windows: np.ndarray, buckets: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket: the number of its entries, their fields, and the hashes of their windows."""
    order = np.argsort(buckets, kind="stable")
    names, lo = np.unique(buckets[order], return_index=True)
    hi = np.r_[lo[1:], len(order)].astype(np.int64)
    sorted_ = [rec[f][order].astype(t, copy=False) for f, t in FIELDS]
    sent = np.where(rec["flags"][order] & SETTLED, 0, rec["n"][order])
    raw = windows[ranges(begin[order], sent)].view(np.uint8).reshape(-1, 8)[:, :HASH].tobytes()
    ends = np.r_[0, np.cumsum(sent)] * HASH
    blobs = [b"".join([int(z - a).to_bytes(4, "little"), *[x[a:z].tobytes() for x in sorted_], raw[ends[a] : ends[z]]]) for a, z in zip(lo, hi)]
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "entries"])


def unpack(blobs: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Entries and the hashes of their windows, in the same order."""
    parts: dict[str, list] = {f: [] for f, _ in FIELDS}
    windows = []
    for b in blobs:
        n, at = int.from_bytes(b[:4], "little"), 4
        for f, t in FIELDS:
            parts[f].append(np.frombuffer(b, t, n, at))
            at += n * np.dtype(t).itemsize
        raw = np.zeros(((len(b) - at) // HASH, 8), np.uint8)
        raw[:, :HASH] = np.frombuffer(b, np.uint8, offset=at).reshape(-1, HASH)
        windows.append(raw.reshape(-1).view(U))
    return {f: np.concatenate(x) for f, x in parts.items()}, np.concatenate(windows)


def _factors_in_batch(rec: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Entries that are factors already, neighbouring ones as one."""
    order = np.lexsort((rec["pos"], rec["h"], rec["doc"], rec["flags"]))
    rec = {f: x[order] for f, x in rec.items()}
    new = np.arange(len(order)) % 50_000 == 0
    for f in ("doc", "h", "flags"):
        new[1:] |= rec[f][1:] != rec[f][:-1]
    new[1:] |= rec["pos"][1:] != rec["pos"][:-1] + rec["n"][:-1]
    first = np.flatnonzero(new)
    out = {f: x[first] for f, x in rec.items()}
    out["n"] = np.add.reduceat(rec["n"], first) if len(first) else rec["n"]
    out["flags"] = out["flags"] | np.uint8(SETTLED)
    out["a"] = np.zeros(len(first), U)
    return out


def _send(held: list[dict], windows: list[np.ndarray], hot: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """The entries of a batch: whole phrases by anchor, windows of hot anchors by content, of equal ones the first."""
    rec = {f: np.concatenate([x[f] for x in held]) for f in held[0]}
    w = np.concatenate(windows)
    if len(hot):
        heavy = hot[np.minimum(np.searchsorted(hot, rec["a"]), len(hot) - 1)] == rec["a"]
        of = np.repeat(np.flatnonzero(heavy), rec["n"][heavy].astype(np.int64))
        at = ranges(rec["begin"][heavy], rec["n"][heavy])
        single = {f: x[of] for f, x in rec.items()}
        single |= {"pos": single["pos"] + (at - single["begin"]).astype(np.uint32), "n": np.ones(len(of), np.uint32), "begin": at, "c": w[at], "by": w[at]}
        rec = {f: np.concatenate([x[~heavy], single[f]]) for f, x in rec.items()}
    order, begin, group = groups(rec["a"], rec["c"])
    times = np.diff(np.r_[begin, len(order)])
    rest = np.ones(len(order), bool)
    rest[begin] = False
    lead = {f: x[order[begin]] for f, x in rec.items()}
    lead["flags"] = np.where(times > 1, lead["flags"] | np.uint8(TWIN), lead["flags"])
    done = _factors_in_batch({f: x[order[rest]] for f, x in rec.items()})
    even = mix(done["h"].astype(U) + done["pos"].astype(U))
    whole = {f: np.concatenate([lead[f], done[f]]) for f in rec}
    return pack(whole, whole["begin"], w, ids[np.r_[lead["by"], even] % U(len(ids))])


def _of_blocks(b: pa.RecordBatch, blocks: Blocks, width: int, gram: int):
    """Phrases of a batch of rows, block after block, with the hashes of all windows of the block."""
    for lo in range(0, b.num_rows, 1000):
        part = b.slice(lo, 1000)
        doc, h, null = ids_of(part)
        for block in blocks(part.column("t").to_pylist(), width):
            roll = Rolling(block.symbols)
            a, c, first, n, _ = phrases(block, width, gram, roll)
            if len(a):
                row = block.row[first]
                yield {"flags": null[row], "n": n.astype(np.uint32), "pos": block.pos[first].astype(np.uint32), "a": a, "c": c, "by": a, "begin": first, "doc": doc[row], "h": h[row]}, mix(roll.all(width))


def hot_anchors(texts: DataFrame, blocks: Blocks, width: int, gram: int) -> np.ndarray:
    """Anchors with more than ``HOT`` different phrases, about, in order."""

    def run(batches):
        held: list[np.ndarray] = []

        def counted():
            pairs = np.unique(np.concatenate(held), axis=0)
            a, n = np.unique(pairs[:, 0], return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n.astype(np.int64))], ["a", "n"])

        for b in batches:
            for rec, _ in _of_blocks(b, blocks, width, gram):
                held.append(np.stack([rec["a"], rec["c"]], axis=1))
                if sum(map(len, held)) >= GATHER:
                    yield counted()
        if held:
            yield counted()

    seen = texts.sample(fraction=1 / SAMPLED, seed=5) if SAMPLED > 1 else texts
    counts = seen.mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") > HOT / SAMPLED)
    found = counts.orderBy(F.desc("n"), "a").limit(BROADCAST_HOT).select("a").toArrow()
    return np.sort(found["a"].to_numpy().view(U))


def entries(texts: DataFrame, blocks: Blocks, width: int, gram: int, ids: np.ndarray) -> DataFrame:
    """(bucket, entries): the phrases of all texts, dealt to reference blocks."""
    hot = texts.sparkSession.sparkContext.broadcast(hot_anchors(texts, blocks, width, gram))

    def run(batches):
        held, windows, count, size = [], [], 0, 0
        for b in batches:
            for rec, w in _of_blocks(b, blocks, width, gram):
                rec["begin"] = rec["begin"] + size
                held.append(rec)
                windows.append(w)
                count, size = count + len(rec["a"]), size + len(w)
                if count >= GATHER:
                    yield _send(held, windows, hot.value, ids)
                    held, windows, count, size = [], [], 0, 0
        if held:
            yield _send(held, windows, hot.value, ids)

    return texts.mapInArrow(run, "bucket long, entries binary")


def longest_matches(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of each place, the length of the longest run from it that also starts at another place.

    ``left`` is how far a run may reach, 0 where it may not start. Suffixes are
    sorted by doubling; the longest match of one is with a neighbour in that order.
    """
    at = np.flatnonzero(left)
    place = np.full(len(symbols) + 1, len(at))
    place[at] = np.arange(len(at))
    reach = left[at]
    ranks = [np.r_[np.unique(symbols[at], return_inverse=True)[1] + 1, 0]]  # 0: beyond the end
    step = 1
    while len(at) and step < reach.max():
        r = ranks[-1]
        then = np.where(reach > step, place[np.minimum(at + step, len(symbols))], len(at))
        pair = r[:-1].astype(np.int64) << 32 | r[then]
        ranks.append(np.r_[np.unique(pair, return_inverse=True)[1] + 1, 0])
        step *= 2
    order = np.argsort(ranks[-1][:-1], kind="stable")
    x, y = order[:-1], order[1:]
    least = np.minimum(reach[x], reach[y])
    same = np.zeros(len(x), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        open_ = same < least
        px = np.where(open_, place[np.minimum(at[x] + same, len(symbols))], len(at))
        py = np.where(open_, place[np.minimum(at[y] + same, len(symbols))], len(at))
        same += (open_ & (ranks[level][px] == ranks[level][py])) << level
    same = np.minimum(same, least)
    best = np.zeros(len(at), np.int64)
    best[x] = same
    best[y] = np.maximum(best[y], same)
    out = np.zeros(len(symbols), np.int64)
    out[at] = best
    return out


def greedy(match: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Starts of the factors of each range: after a factor comes the first place it does not cover, after a literal the next place."""
    at, stop, found = begin, end, [np.empty(0, np.int64)]
    while len(at):
        found.append(at[match[at] > 0])
        at = at + np.maximum(match[at], 1)
        live = at < stop
        at, stop = at[live], stop[live]
    return np.concatenate(found)


def factor_block(t: pa.Table) -> pa.Table:
    """(doc_id, h, span) of each factor of a reference block; a span is its first word, shifted by 24 bits, and its number of windows."""
    rec, w = unpack(t["entries"].to_pylist())
    done = np.flatnonzero(rec["flags"] & SETTLED)
    own = np.flatnonzero((rec["flags"] & SETTLED) == 0)
    n = rec["n"][own].astype(np.int64)
    end = np.cumsum(n)
    begin = end - n
    of = np.repeat(np.arange(len(own)), n)
    order, first, group = groups(rec["a"][own][of], w)
    known = np.zeros(len(w), bool)
    known[order] = (np.diff(np.r_[first, len(order)]) > 1)[group]
    symbols = np.zeros(len(w), np.int64)
    symbols[order] = group
    # windows from each place to the next that is known nowhere else, inside the phrase
    ends = np.where(known, np.iinfo(np.int64).max, np.arange(len(w)))
    ends = np.minimum(np.minimum.accumulate(ends[::-1])[::-1], end[of]) if len(w) else ends
    match = longest_matches(symbols, ends - np.arange(len(w)))
    twin = (rec["flags"][own] & TWIN).astype(bool)[of]
    match = np.where(twin, end[of] - np.arange(len(w)), match)
    start = greedy(match, begin, end)
    at = np.r_[own[of[start]], done]
    pos = np.r_[rec["pos"][own[of[start]]] + (start - begin[of[start]]), rec["pos"][done]].astype(np.int64)
    count = np.r_[match[start], rec["n"][done]].astype(np.int64)
    null = rec["flags"][at] >= NULL_ID
    return pa.table({"doc_id": pa.array(rec["doc"][at], pa.int64(), mask=null), "h": rec["h"][at], "span": pos << 24 | count})


def factors(docs: DataFrame, blocks: Blocks, width: int, gram: int) -> DataFrame:
    """(doc_id, h, spans): the factors of each document that has any, each once however often its row is repeated."""
    sent = entries(keyed(docs), blocks, width, gram, bucket_ids(docs.sparkSession))
    found = sent.groupBy("bucket").applyInArrow(factor_block, "doc_id long, h long, span long")
    return found.groupBy("doc_id", "h").agg(F.collect_set("span").alias("spans"))
