"""Deterministic choice of representative examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def round_robin(rows: DataFrame, bucket: str, sort_keys: tuple[str, ...], limit: int) -> DataFrame:
    """Up to ``limit`` rows, one from each bucket in turn; buckets in the order of their first row.

    Only the first ``limit`` rows of each bucket and the first ``limit`` buckets
    can be taken, so what is ranked last is bounded by the limit squared. The
    result has the column ``turn``, from 1 on.
    """
    if limit <= 0:
        return rows.limit(0).withColumn("turn", F.lit(0))
    keys = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in sort_keys]
    named = rows.withColumn("_bucket", F.coalesce(F.nullif(F.col(bucket).cast("string"), F.lit("")), F.lit("unknown")))
    nth = named.withColumn("_nth", F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))).where(F.col("_nth") <= limit)
    first = nth.where("_nth = 1").select("_bucket", *[k.alias(f"_k{i}") for i, k in enumerate(keys)]).orderBy(*[f"_k{i}" for i in range(len(keys))]).limit(limit)
    place = first.withColumn("_place", F.row_number().over(Window.orderBy(*[f"_k{i}" for i in range(len(keys))]))).select("_bucket", "_place")
    taken = nth.join(F.broadcast(place), "_bucket").orderBy("_nth", "_place").limit(limit)
    return taken.withColumn("turn", F.row_number().over(Window.orderBy("_nth", "_place"))).drop("_bucket", "_nth", "_place")


def representative(rows: DataFrame, successes: int = 5, failures: int = 5, bucket: str = "trick_id", sort_keys: tuple[str, ...] = ("trick_id", "example_id")) -> DataFrame:
    """Successes and failures, each by ``round_robin``, with column ``kind``."""
    good = round_robin(rows.where("correct"), bucket, sort_keys, successes).withColumn("kind", F.lit("success"))
    return good.unionByName(round_robin(rows.where("not correct"), bucket, sort_keys, failures).withColumn("kind", F.lit("failure")))


def first_present(cells: DataFrame, order: str = "method_id") -> DataFrame:
    """The first cell of each example that is not missing."""
    there = F.min_by(F.struct("method_id", "correct", "parsed_answer"), F.when(~F.col("missing"), F.col(order)))
    return cells.groupBy("example_id").agg(there.alias("cell"))
