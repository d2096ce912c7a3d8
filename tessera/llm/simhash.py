"""Near-duplicate detection with SimHash fingerprints and a trie self-join.

The fingerprint of a document needs no shuffle. Equal fingerprints are merged
first, so a group of copies is one trie leaf however large it is. Distinct
fingerprints meet in subtrees that agree on a whole block of bits (with at most
``BUDGET`` differing bits, one of ``BUDGET + 1`` blocks is equal); subtrees that
are too large agree on a block of the remaining bits too, so that at the third
level a subtree cannot hold more than 2^20 fingerprints. Inside a subtree the
binary trie is joined with itself: node pairs descend together, differing bits
add up, and a pair is dropped as soon as they exceed the budget.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lookup, raw_text, shuffle_parts, stored
from tessera.llm.components import components

SHINGLE = 3
SEED = 42
BITS = 64
BUDGET = 2
#: Fingerprints that one subtree may hold before it is split by further bits.
SUBTREE = 200_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, repeats included.

    A-Z are lower-cased. Fewer words than a shingle make one shingle; no words
    give zero. A bit at exactly half is zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return int.from_bytes(digest(joined, SEED), "big")
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    hashes = b"".join([digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[shingle - 1 :])])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(rows), 200_000):
        ones += np.unpackbits(rows[at : at + 200_000], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (the text's hash) and fp (the fingerprint's 64 bits as a long) of every row."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], ["doc_id", "h", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(raw_text()).alias("h"), raw_text().alias("t")).mapInArrow(run, "doc_id long, h long, fp long")


def _split(mask: int) -> list[int]:
    """Blocks of the bits outside ``mask``, one more than the budget; each joined with ``mask``."""
    free = [b for b in range(BITS - 1, -1, -1) if not mask >> b & 1]
    cuts = [round(i * len(free) / (BUDGET + 1)) for i in range(BUDGET + 2)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


LEVEL1 = _split(0)
MASKS = LEVEL1 + [m for a in LEVEL1 for m in _split(a)]
MASKS += [m for a in MASKS[len(LEVEL1) :] for m in _split(a)]


def _below(df: DataFrame, path) -> DataFrame:
    """Each fingerprint once for each child path of its path: (path, key, fp)."""
    n = BUDGET + 1
    masks = F.array(*[F.lit(_signed(m)) for m in MASKS])
    kids = df.select("fp", F.explode(F.sequence(path * n, path * n + n - 1)).alias("path"))
    return kids.select("path", F.col("fp").bitwiseAND(F.get(masks, F.col("path"))).alias("key"), "fp")


def trie_pairs(key: np.ndarray, value: np.ndarray, free: list[int], budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with equal ``key`` whose ``value`` differs in 1 to ``budget`` bits.

    Rows are sorted by (key, value), values distinct within a key. ``free`` lists
    the bits that may differ, highest first. A node of the trie is a range of
    rows; a pair of nodes holds the bits by which they differ so far.
    """
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    first, size = first[size > 1], size[size > 1]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, len(first), 50_000):
        a, n = first[lo : lo + 50_000], size[lo : lo + 50_000]
        _descend(value, free, budget, a, a + n, a, a + n, np.zeros(len(a), np.int8), found)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _descend(value, free, budget, alo, ahi, blo, bhi, err, found) -> None:
    for at, bit in enumerate([*free, None]):
        own = alo == blo  # small pairs are compared at once
        work = (ahi - alo) * (bhi - blo)
        small = work <= 16 if bit is not None else np.ones(len(work), bool)
        if small.any():
            _compare(value, budget, alo[small], ahi[small], blo[small], bhi[small], own[small], found)
            keep = ~small
            alo, ahi, blo, bhi, err, own = (x[keep] for x in (alo, ahi, blo, bhi, err, own))
        if bit is None or not len(alo):
            return
        zeros = np.r_[0, np.cumsum((value >> np.uint64(bit) & np.uint64(1)) == 0)]
        amid = alo + zeros[ahi] - zeros[alo]
        bmid = blo + zeros[bhi] - zeros[blo]
        two = ~own
        parts = [
            (alo, amid, blo, bmid, err),
            (amid, ahi, bmid, bhi, err),
            (alo, amid, bmid, bhi, err + 1),
            (amid[two], ahi[two], blo[two], bmid[two], err[two] + 1),
        ]
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*parts))
        keep = (err <= budget) & (alo < ahi) & (blo < bhi) & ~((alo == blo) & (ahi - alo < 2))
        alo, ahi, blo, bhi, err = (x[keep] for x in (alo, ahi, blo, bhi, err))
        if len(alo) > 800_000:  # depth first from here, for bounded memory
            for s in range(0, len(alo), 200_000):
                c = slice(s, s + 200_000)
                _descend(value, free[at + 1 :], budget, alo[c], ahi[c], blo[c], bhi[c], err[c], found)
            return


def _compare(value, budget, alo, ahi, blo, bhi, own, found) -> None:
    """All rows of each first node against all of the second."""
    wide = bhi - blo
    count = (ahi - alo) * wide
    pair = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    x = alo[pair] + nth // wide[pair]
    y = blo[pair] + nth % wide[pair]
    ok = (np.bitwise_count(value[x] ^ value[y]) <= budget) & (~own[pair] | (x < y))
    found.append((x[ok], y[ok]))


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest with the same components: each node with its smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    off = root != np.arange(len(nodes))
    return nodes[off], nodes[root[off]]


def _join_bucket(t: pa.Table) -> pa.Table:
    path = t["path"].to_numpy()
    key, fp = (t[c].to_numpy().view(np.uint64) for c in ("key", "fp"))
    us, vs = [], []
    for p in np.unique(path):
        mask, own = MASKS[p], path == p
        k, f = key[own], fp[own]
        value = f & np.uint64(~mask & (1 << 64) - 1)
        order = np.lexsort((value, k))
        k, f, value = k[order], f[order], value[order]
        x, y = trie_pairs(k, value, [b for b in range(BITS - 1, -1, -1) if not mask >> b & 1])
        us.append(f[x])
        vs.append(f[y])
    u, v = np.concatenate(us), np.concatenate(vs)
    if len(u):
        u, v = spanning(u.view(np.int64), v.view(np.int64))
    return pa.table({"u": pa.array(u.view(np.int64), pa.int64()), "v": pa.array(v.view(np.int64), pa.int64())})


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (column fp) -> (u, v) links that join all within the budget.

    Per bucket of subtrees only a spanning forest of the links is kept: as many
    rows as fingerprints at most, with the same components.
    """
    spark = fps.sparkSession
    grouped, light = _below(fps, F.lit(0)), []
    for level in (1, 2):
        heavy = grouped.groupBy("path", "key").count().where(F.col("count") > SUBTREE).select("path", "key")
        if heavy.isEmpty():
            break
        heavy = stored(heavy)
        light.append(grouped.join(heavy, ["path", "key"], "left_anti"))
        grouped = _below(grouped.join(heavy, ["path", "key"], "left_semi"), F.col("path") + 1)
    for other in light:
        grouped = grouped.union(other)
    buckets = 2 * shuffle_parts(spark)
    dealt = grouped.withColumn("bucket", F.pmod(F.xxhash64("path", "key"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(_join_bucket, "u long, v long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, h, fp, root (a fingerprint of the component) and component_id of every row of ``docs``."""
    marked = stored(fingerprints(docs))
    least = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    root = components(links(least.select("fp"))).withColumnRenamed("node", "fp")
    root = stored(root.join(least.drop("n"), "fp"))
    joint = stored(root.groupBy("root").agg(F.min("least").alias("joint"), F.count("*").alias("n")))
    joint = lookup(root.select("root", "fp"), joint, "root").select("fp", "root", "joint")
    ids = least.join(joint, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("joint", "least").alias("component_id"), "n")
    return lookup(marked, stored(ids), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    component_id is the smallest doc_id that is reachable over fingerprints which
    differ in two bits or fewer. Null and empty texts have fingerprint zero and
    link like any other. A repeated row is a row of its own in the same component.
    A null doc_id is no candidate for component_id, which is null where a
    component has no other. No rows give no rows; other columns are ignored.
    """
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of ``docs`` that leads its component: the smallest doc_id and, of several texts with it, the least hash.

    Of equal rows one stays. Null doc_ids stay.
    """
    lead = classes(docs).where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("lead")).select("lead.*")
    lead = lead.select(F.col("doc_id").alias("_sh_doc"), F.col("h").alias("_sh_text"))
    named = docs.where("doc_id is not null").withColumns({"_sh_id": F.col("doc_id").cast("long"), "_sh_h": F.xxhash64(raw_text())})
    named = named.join(lead, (F.col("_sh_id") == F.col("_sh_doc")) & (F.col("_sh_h") == F.col("_sh_text")), "left_semi").dropDuplicates(["_sh_id", "_sh_h"])
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))
