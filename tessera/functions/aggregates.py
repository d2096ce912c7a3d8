"""Aggregate expressions that the engine uses throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(flag: Column) -> Column:
    """Share of true among the flags that are not null; null if there are none."""
    return F.avg(flag.cast("double"))


def count_true(flag: Column) -> Column:
    return F.count_if(F.coalesce(flag, F.lit(False))).cast("long")


#: Ranges of about equally many values, a square, that values are counted in.
RANGES = 1024


def _dealt(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """``rows`` of column v with ``label``, the range that v falls in; bounds are a quantile sketch of each group of ``by``."""
    step = math.isqrt(RANGES)
    bounds = rows.groupBy(*by).agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)]).alias("_bounds"))
    coarse = F.transform(F.sequence(F.lit(step), F.lit(RANGES - step), F.lit(step)), lambda i: F.get("_bounds", i - 1))
    placed = rows.join(F.broadcast(bounds), by) if by else rows.crossJoin(F.broadcast(bounds))
    placed = placed.withColumn("_k", F.size(F.filter(coarse, lambda b: b < F.col("v"))))
    fine = F.filter(F.slice("_bounds", F.col("_k") * step + 1, F.lit(step)), lambda b: b < F.col("v"))
    return placed.withColumn(label, F.col("_k") * step + F.size(fine)).drop("_bounds", "_k")


def nearest_rank(values: DataFrame, value: str, quantiles: dict[str, float]) -> DataFrame:
    """One row: for each name, the value at index round-half-even(q * (n - 1)) of the sorted values.

    Equal values are counted before the shuffle. A sketch of the distinct values
    bounds ranges that hold about equally many of them, whatever outliers there are;
    the range that holds a wanted index is divided again in the same way, and only
    what holds it then, a millionth of the values, is ranked. Nulls and NaN are left
    out, an empty input gives nulls.
    """
    v = F.col(value).cast("double")
    counts = values.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("v")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    index = {name: F.bround(F.lit(min(1.0, max(0.0, q))) * (F.col("total") - 1)).cast("long") for name, q in quantiles.items()}

    def holding(placed: DataFrame, labels: list[str], start: Column) -> DataFrame:
        """The rows of ranges that hold a wanted index, with how many values come before the range."""
        ahead = Window.partitionBy(*labels[:-1]).orderBy(labels[-1]).rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
        sizes = placed.groupBy(*labels, *(["before"] if "before" in placed.columns else [])).agg(F.sum("n").alias("size"))
        sizes = sizes.withColumn("before", start + F.coalesce(F.sum("size").over(ahead), F.lit(0))).crossJoin(F.broadcast(total))
        held = F.lit(False)
        for at in index.values():
            held = held | ((F.col("before") <= at) & (at < F.col("before") + F.col("size")))
        return placed.drop("before").join(F.broadcast(sizes.where(held).drop("size")), labels)

    near = holding(_dealt(counts, [], "range"), ["range"], F.lit(0)).drop("total")
    near = holding(_dealt(near, ["range"], "part"), ["range", "part"], F.col("before"))
    own = Window.partitionBy("range", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = near.withColumn("end", F.col("before") + F.sum("n").over(own))
    return ranked.agg(*[F.min(F.when((F.col("end") > at) & (F.col("before") <= at), F.col("v"))).alias(name) for name, at in index.items()])


def first_mode(df: DataFrame, label: str, order: str, *keys: str) -> DataFrame:
    """The most frequent label of each group; of equals, the one that was seen first."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    best = F.max_by(F.struct(label, "n"), F.struct(F.col("n"), -F.col("seen"))).alias("best")
    return counts.groupBy(*keys).agg(best).select(*keys, f"best.{label}", "best.n")


def entropy_bits(counts: DataFrame, n: str) -> DataFrame:
    """One row: Shannon entropy of the counts; null if they sum to nothing."""
    total = counts.agg(F.sum(n).alias("total"))
    p = F.col(n) / F.col("total")
    return counts.where(F.col(n) > 0).crossJoin(F.broadcast(total)).agg((-F.sum(p * F.log2(p))).alias("entropy_bits"))
