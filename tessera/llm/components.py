"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lookup, stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
    return lookup(both, low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    low = stored(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    hung = lookup(links, low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links of comparable ids -> (node, root): every linked node with the smallest of its component.

    Each round hangs neighbours below their smallest neighbour (large star) and
    flattens chains (small star); the number of rounds grows with the logarithm
    of the longest chain. The minimum of a node's neighbours is combined before
    the shuffle, and joined with the links of a hub by broadcast, so that those never
    meet in one task. Links of a node with
    itself and repeated links have no effect; no links give an empty table.
    """
    ordered = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(ordered)
    mark = _mark(now)
    while mark[0]:
        now = stored(_small_star(stored(_large_star(now))))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _mark(links: DataFrame) -> tuple:
    """Changes whenever the set of links does: its size and an order-free digest."""
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
    return tuple(row)
