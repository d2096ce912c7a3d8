"""Closed intervals in seconds or frames: parsing, overlap, gold resolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import blank, strip

#: How responses state an interval, in order of preference.
SECONDS = (
    r"(?i)start_s\s*[=:]\s*([+-]?(?:\d+\.?\d*|\.\d+))\s*[,\s]+end_s\s*[=:]\s*([+-]?(?:\d+\.?\d*|\.\d+))",
    r"(?i)interval\s*[=:]\s*\[?\s*([+-]?(?:\d+\.?\d*|\.\d+))\s*[,--]\s*([+-]?(?:\d+\.?\d*|\.\d+))\s*\]?\s*(?:s|sec|seconds)?",
    r"(?i)(?:from\s+)?([+-]?(?:\d+\.?\d*|\.\d+))\s*(?:s|sec|seconds)\s*(?:-|-|to)\s*([+-]?(?:\d+\.?\d*|\.\d+))\s*(?:s|sec|seconds)?",
)
FRAMES = (
    r"(?i)start_frame\s*[=:]\s*(\d+)\s*[,\s]+end_frame\s*[=:]\s*(\d+)",
    r"(?i)frames?\s*[=:]?\s*(\d+)\s*(?:-|-|to)\s*(\d+)",
)
TYPE = "struct<start:double,end:double,unit:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, whose expression is then held and evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def interval(start: Column, end: Column, unit: Column | str) -> Column:
    unit = F.lit(unit) if isinstance(unit, str) else unit
    return F.struct(start.cast("double").alias("start"), end.cast("double").alias("end"), unit.alias("unit"))


def no_interval() -> Column:
    return F.lit(None).cast(TYPE)


def valid(i: Column) -> Column:
    return (i["start"] >= 0) & (i["end"] >= 0) & (i["start"] <= i["end"])


def length(i: Column) -> Column:
    return i["end"] - i["start"]


def intersection(a: Column, b: Column) -> Column:
    """Length of the common part; intervals of different units are an error."""
    common = F.greatest(F.lit(0.0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    return F.when(a["unit"] == b["unit"], common).when(a["unit"] != b["unit"], F.raise_error(F.lit("intervals have different units")).cast("double"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; two points are 1 if they are the same, an invalid interval is an error."""
    common = intersection(a, b)
    union = length(a) + length(b) - common
    points = (length(a) == 0) & (length(b) == 0)
    value = F.when(points, (a["start"] == b["start"]).cast("double")).when(union <= 0, 0.0).otherwise(F.try_divide(common, union))
    bad = ~valid(a) | ~valid(b)
    return F.when(bad, F.raise_error(F.lit("an interval is invalid")).cast("double")).when(a["unit"].isNotNull() & b["unit"].isNotNull(), value)


def span_interval(span: Column, unit: str = "auto") -> tuple[Column, Column]:
    """The interval of a span and why there is none; seconds are preferred unless frames are asked for."""
    has_s = span["start_s"].isNotNull() & span["end_s"].isNotNull()
    has_f = span["start_frame"].isNotNull() & span["end_frame"].isNotNull()
    s, f = interval(span["start_s"], span["end_s"], "seconds"), interval(span["start_frame"], span["end_frame"], "frames")
    if unit == "seconds":
        found, missing = F.when(has_s, s), F.when(~has_s, F.lit("span_missing_seconds"))
    elif unit == "frames":
        found, missing = F.when(has_f, f), F.when(~has_f, F.lit("span_missing_frames"))
    else:
        found, missing = F.when(has_s, s).when(has_f, f), F.when(~has_s & ~has_f, F.lit("span_missing_both_ends"))
    reason = F.coalesce(missing, F.when(~valid(found), F.lit("invalid_interval")))
    return F.when(reason.isNull(), found), reason


def _first(text: Column, patterns: tuple[str, ...], unit: str) -> Column:
    out = no_interval()
    for p in reversed(patterns):
        ends = [F.regexp_extract(text, p, k).try_cast("double") for k in (1, 2)]
        out = F.when(text.rlike(p), interval(*ends, unit)).otherwise(out)
    return out


def parse_interval(raw: Column, unit: Column | str = "auto") -> Column:
    """What a response states: struct of ``interval`` and the ``reason`` why there is none; unit is auto, seconds or frames."""
    unit = F.lit(unit) if isinstance(unit, str) else unit

    def choose(hit: Column) -> Column:
        s, f = hit["s"], hit["f"]
        return F.struct(hit["unit"].alias("unit"), s.isNotNull().alias("s"), f.isNotNull().alias("f"), F.when(hit["unit"] == "seconds", s).when(hit["unit"] == "frames", f).otherwise(F.coalesce(s, f)).alias("chosen"), hit["empty"].alias("empty"))

    def judge(c: Column) -> Column:
        reason = (
            F.when(c["empty"], "empty_response")
            .when((c["unit"] == "seconds") & ~c["s"] & c["f"], "predicted_frames_but_seconds_required")
            .when((c["unit"] == "frames") & ~c["f"] & c["s"], "predicted_seconds_but_frames_required")
            .when(c["chosen"].isNull(), "no_interval_parsed")
            .when(~valid(c["chosen"]), "invalid_predicted_interval")
        )
        return let(reason, lambda r: F.struct(F.when(r.isNull(), c["chosen"]).alias("interval"), r.alias("reason")))

    def hits(text: Column) -> Column:
        return F.struct(_first(text, SECONDS, "seconds").alias("s"), _first(text, FRAMES, "frames").alias("f"), unit.alias("unit"), blank(text).alias("empty"))

    return let(strip(F.coalesce(raw, F.lit(""))), lambda t: let(hits(t), lambda h: let(choose(h), judge)))


def gold_interval(causal: Column, unit: str = "auto") -> Column:
    """Resolve an annotated causal moment: eligible, interval, reason, status and its label.

    The span of the clip never stands in. An ambiguous annotation keeps its span
    for inspection and is not eligible.
    """
    found, error = span_interval(causal["causal_moment"], unit)

    def resolve(x: Column) -> Column:
        none, moment, error = x["none"], x["moment"], x["error"]
        ambiguous = causal["status"] == "ambiguous"
        reason = (
            F.when(none, "no_causal_annotation")
            .when(ambiguous & moment & error.isNotNull(), F.concat(F.lit("ambiguous_annotation;"), error))
            .when(ambiguous, "ambiguous_annotation")
            .when(~moment, "missing_causal_moment")
            .otherwise(error)
        )
        label = F.when(causal["status"] == "known", "objectively_established").otherwise(causal["status"])
        return let(reason, lambda r: F.struct(r.isNull().alias("eligible"), F.when(moment, x["found"]).alias("interval"), r.alias("reason"), causal["status"].alias("annotation_status"), label.alias("status_label"), causal["unique_cause"].alias("unique_cause")))

    seen = F.struct(causal.isNull().alias("none"), causal["causal_moment"].isNotNull().alias("moment"), found.alias("found"), error.alias("error"))
    return let(seen, resolve)


def temporal_value(overlap: Column, eligible: Column, failed: Column, mode: str = "binary", threshold: float = 0.5) -> Column:
    """Score of an overlap: clamped (partial) or at the threshold (binary); 0 where there is nothing to score."""
    if mode not in ("binary", "partial"):
        raise ValueError(f"mode must be binary or partial, not {mode!r}")
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), overlap)) if mode == "partial" else (overlap >= threshold).cast("double")
    return F.when(eligible & ~failed & overlap.isNotNull(), value).otherwise(0.0)
