"""Deterministic frame sampling and shuffling, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_indices(n: Column, most: int, strategy: str = "uniform") -> Column:
    """At most ``most`` of n frames in order: with both ends and halves rounded to even, or the first ones."""
    if strategy not in ("uniform", "first_n"):
        raise ValueError(f"unknown strategy {strategy!r}")
    k = F.least(F.lit(most), n)
    places = F.sequence(F.lit(0), k - 1)
    if strategy == "uniform":
        places = F.transform(places, lambda i: F.when(k == 1, 0).otherwise(F.bround(F.try_divide(i * (n - 1), k - 1)).cast("int")))
    checked = F.when(n < 1, F.raise_error(F.lit("there must be a frame")).cast("array<int>")).otherwise(places.cast("array<int>"))
    return F.when(n.isNotNull(), checked)


def review_indices(n: Column) -> Column:
    """Stills for review: twelve evenly spread, the thirds, the half and the ends; sorted and distinct."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.bround(i * (n - 1) / 11).cast("int"))
    extra = F.array(F.floor(n / 3), F.floor(n / 2), F.least(n - 1, F.floor(2 * n / 3)), F.lit(0), n - 1).cast("array<int>")
    return F.when(n >= 1, F.array_sort(F.array_distinct(F.concat(spread, extra)))).otherwise(F.array().cast("array<int>"))


#: Multiplier and increment of the generator, and its 32 bits.
LCG = (1664525, 1013904223, 0xFFFFFFFF)


def shuffled(values: Column, seed: Column | int) -> Column:
    """Fisher-Yates from the end, with a linear congruential generator of 32 bits."""
    a, c, mask = LCG
    seed = F.lit(seed) if isinstance(seed, int) else seed
    start = F.struct(seed.cast("long").bitwiseAND(F.lit(mask)).alias("state"), values.alias("v"))

    def step(s: Column, i: Column) -> Column:
        state = (s["state"] * a + c).bitwiseAND(F.lit(mask))
        j = state % (i + 1)
        x, y = F.get(s["v"], i), F.get(s["v"], j.cast("int"))
        moved = F.transform(s["v"], lambda e, k: F.when(k == i, y).when(k == j, x).otherwise(e))
        return F.struct(state.alias("state"), moved.alias("v"))

    order = F.when(F.size(values) > 1, F.sequence(F.size(values) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.when(values.isNotNull(), F.aggregate(order, start, step, lambda s: s["v"]))


def sample_plan(n: Column, most: int, seed: Column | int, strategy: str = "uniform") -> Column:
    """Ordered and shuffled presentation of one sample, and whether the shuffle moved anything."""
    ordered = frame_indices(n, most, strategy)
    mixed = shuffled(ordered, seed)
    same_frames = F.array_sort(ordered).eqNullSafe(F.array_sort(mixed))
    return F.struct(ordered.alias("ordered_indices"), mixed.alias("shuffled_indices"), same_frames.alias("same_frame_set"), (ordered != mixed).alias("permuted"))
