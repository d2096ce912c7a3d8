"""Data-quality and leakage findings over an example table.

Every check returns findings with the same columns, so a report is their union.
Columns: severity, code, subject (what the finding is about), example_ids,
clip_ids, detail. Checks are grouped aggregates or row expressions; no check
looks at pairs of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import EDGES, normalize_question, strip

SCHEMA = "severity string, code string, subject string, example_ids array<string>, clip_ids array<string>, detail string"
FPS_RANGE = (1.0, 120.0)
FPS_DURATION_TOLERANCE = 0.35
FPS_TOLERANCE = 0.51
DENSE_COMBO = 4
#: Order of severities in a report.
SEVERITIES = {"error": 0, "leakage": 1, "review": 2}


@dataclass(frozen=True)
class Options:
    """``allowed_answers`` is compared with stored labels as they are."""

    allowed_answers: tuple[str, ...] | None = None
    expected_fps: float | None = None
    fail_on_leakage: bool = True


def _finding(severity: str, code: str, subject: Column, examples: Column | None = None, clips: Column | None = None, detail: Column | None = None) -> list[Column]:
    none = F.array().cast("array<string>")
    return [
        F.lit(severity).alias("severity"),
        F.lit(code).alias("code"),
        subject.cast("string").alias("subject"),
        (none if examples is None else examples).alias("example_ids"),
        (none if clips is None else clips).alias("clip_ids"),
        (F.lit(None).cast("string") if detail is None else detail.cast("string")).alias("detail"),
    ]


def _ids(column: str) -> Column:
    return F.array_sort(F.collect_set(column))


def duplicate_ids(ex: DataFrame) -> DataFrame:
    groups = ex.groupBy("example_id").agg(F.count("*").alias("n")).where("n > 1")
    return groups.select(*_finding("error", "duplicate_example_id", F.col("example_id"), F.array("example_id"), None, F.col("n")))


def first_violation(ex: DataFrame) -> DataFrame:
    """At most one finding: the first row that repeats an id, or whose path or split differs from its clip's first."""
    by_id = Window.partitionBy("example_id").orderBy("ord")
    by_clip = Window.partitionBy("clip_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = ex.select(
        "ord", "example_id", "clip_id",
        (F.row_number().over(by_id) > 1).alias("again"),
        (~F.first("video_path").over(by_clip).eqNullSafe(F.col("video_path"))).alias("path"),
        (~F.first("split").over(by_clip).eqNullSafe(F.col("split"))).alias("split"),
    )
    reason = F.when(F.col("again"), "duplicate_example_id").when(F.col("path"), "multiple_paths").when(F.col("split"), "multiple_splits")
    first = marked.withColumn("reason", reason).where("reason is not null").orderBy("ord").limit(1)
    return first.select(*_finding("error", "manifest_integrity", F.when(F.col("reason") == "duplicate_example_id", F.col("example_id")).otherwise(F.col("clip_id")), None, None, F.col("reason")))


def ground_truth(ex: DataFrame, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """Missing, blank, unknown or padded gold labels of hidden-state examples; the first that applies."""
    gold = F.col("ground_truth")
    code = F.when(gold.isNull() | (gold == ""), "missing_ground_truth").when(strip(gold) == "", "invalid_ground_truth_whitespace")
    if allowed is not None:
        code = code.when(~gold.isin(*allowed), "invalid_answer_not_in_vocab")
    code = code.when(gold.rlike(EDGES), "ground_truth_peripheral_whitespace")
    rows = ex.where("task = 'hidden_state'").withColumn("_code", code).where("_code is not null")
    found = rows.select(*_finding("error", "", F.col("example_id"), F.array("example_id"), F.array("clip_id"), gold), "_code")
    severity = F.when(F.col("_code") == "ground_truth_peripheral_whitespace", "review").otherwise("error")
    return found.select(severity.alias("severity"), F.col("_code").alias("code"), "subject", "example_ids", "clip_ids", "detail")


def _variety(column: str) -> Column:
    """Distinct values, null being one."""
    return F.count_distinct(F.coalesce(F.col(column), F.lit("\0")))


def clip_consistency(ex: DataFrame) -> DataFrame:
    """Clips whose rows disagree on identity, on path or split, or on gold (of hidden-state rows)."""
    golds = F.count_distinct(F.when(F.col("task") == "hidden_state", F.coalesce(F.col("ground_truth"), F.lit("\0"))))
    groups = ex.groupBy("clip_id").agg(
        ((_variety("trick_id") > 1) | (_variety("performer_id") > 1) | (_variety("camera_id") > 1)).alias("inconsistent_clip_metadata"),
        ((_variety("video_path") > 1) | (_variety("split") > 1)).alias("inconsistent_clip_path_or_split"),
        (golds > 1).alias("inconsistent_clip_ground_truth"),
        _ids("example_id").alias("ids"),
    )
    codes = ("inconsistent_clip_metadata", "inconsistent_clip_path_or_split", "inconsistent_clip_ground_truth")
    each = groups.select("clip_id", "ids", F.explode(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in codes]))).alias("found"))
    return each.select(*_finding("error", "", F.col("clip_id"), F.col("ids"), F.array("clip_id")), "found").withColumn("code", F.col("found")).drop("found")


def _shared(ex: DataFrame, key: Column, severity: str, code: str) -> DataFrame:
    groups = ex.withColumn("_key", key).where("_key is not null and _key <> ''").groupBy("_key").agg(_ids("clip_id").alias("clips"), _ids("example_id").alias("ids"))
    return groups.where(F.size("clips") > 1).select(*_finding(severity, code, F.col("_key"), F.col("ids"), F.col("clips"), F.size("clips")))


def duplicate_video_path(ex: DataFrame) -> DataFrame:
    return _shared(ex, F.col("video_path"), "error", "duplicate_video_path")


def shared_content_hash(ex: DataFrame) -> DataFrame:
    return _shared(ex, F.col("content_hash"), "review", "near_duplicate_content_hash")


def duplicate_questions(ex: DataFrame) -> DataFrame:
    """Questions of one clip that are the same but for case and white space."""
    groups = ex.groupBy("clip_id", normalize_question(F.col("question")).alias("q")).agg(_ids("example_id").alias("ids"), F.count("*").alias("n")).where("n > 1")
    return groups.select(*_finding("review", "duplicate_question_phrasing", F.col("clip_id"), F.col("ids"), F.array("clip_id"), F.col("q")))


def dense_combos(ex: DataFrame, least: int = DENSE_COMBO) -> DataFrame:
    """Trick and performer pairs that occur in many clips."""
    groups = ex.groupBy("trick_id", "performer_id").agg(_ids("clip_id").alias("clips")).where(F.size("clips") >= least)
    return groups.select(*_finding("review", "repeated_trick_performer_combo", F.concat_ws("|", "trick_id", "performer_id"), None, F.col("clips"), F.size("clips")))


def fps_and_spans(ex: DataFrame, expected: float | None = None) -> DataFrame:
    """Frame rate, span and causal annotation rules; several may hold for a row."""
    fps, low, high = F.col("fps"), *FPS_RANGE
    implied = F.try_divide(F.col("num_frames"), fps)
    off = F.try_divide(F.abs(implied - F.col("duration_s")), F.col("duration_s"))
    rules = [
        ("review", "missing_fps", fps.isNull()),
        ("error", "unexpected_fps", (fps < low) | (fps > high)),
        ("review", "fps_duration_inconsistency", (fps != 0) & (F.col("num_frames") != 0) & (F.col("duration_s") > 0) & (off > FPS_DURATION_TOLERANCE)),
    ]
    if expected is not None:
        rules.append(("review", "fps_deviates_from_expected", F.abs(fps - expected) > FPS_TOLERANCE))
    if "temporal" in ex.columns:
        rules.append(("error", "invalid_temporal_interval", F.col("temporal.start_s") > F.col("temporal.end_s")))
    if "causal" in ex.columns:
        there, status = F.col("causal").isNotNull(), F.col("causal.status")
        rules += [
            ("review", "causal_annotation_present", there),
            ("review", "ambiguous_causal_annotation", status == "ambiguous"),
            ("error", "causal_missing_moment", there & (status != "ambiguous") & F.col("causal.causal_moment").isNull()),
        ]
    hits = F.array_compact(F.array(*[F.when(p, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for s, c, p in rules]))
    each = ex.select("example_id", "clip_id", F.inline(hits))
    return each.select("severity", "code", *_finding("", "", F.col("example_id"), F.array("example_id"), F.array("clip_id"))[2:])


def overlaps(ex: DataFrame) -> DataFrame:
    """Values shared across the held-out boundary (leakage) and between train and val (review): one row each.

    Columns: severity, code, value. One pass: each value is grouped once with the
    splits it occurs in.
    """
    attributes = {"clip_id": "clip", "video_path": "path", "trick_id": "trick", "performer_id": "performer"}
    values = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in attributes])
    sides = ex.select("split", F.inline(values)).groupBy("attribute", "value").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    has = lambda s: F.array_contains("splits", s)
    leak = F.when(F.col("attribute") == "video_path", "leakage_video_path").otherwise(F.concat(F.lit("leakage_"), F.col("attribute")))
    both = F.when(F.col("attribute") != "video_path", F.concat(F.lit("train_val_"), F.regexp_replace("attribute", "_id$", ""), F.lit("_overlap")))
    found = F.array_compact(
        F.array(
            F.when(has("held_out") & (has("train") | has("val")), F.struct(F.lit("leakage").alias("severity"), leak.alias("code"))),
            F.when(has("train") & has("val") & both.isNotNull(), F.struct(F.lit("review").alias("severity"), both.alias("code"))),
        )
    )
    return sides.select("value", F.inline(found)).select("severity", "code", "value")


def split_leakage(ex: DataFrame) -> DataFrame:
    """``overlaps`` as findings: one for each code, with the values that are shared."""
    groups = overlaps(ex).groupBy("severity", "code").agg(F.array_sort(F.collect_set("value")).alias("shared"))
    return groups.select("severity", "code", *_finding("", "", F.array_join("shared", ","), None, None, F.size("shared"))[2:])


def split_presence(ex: DataFrame) -> DataFrame:
    """Whether a held-out split is missing, or is all there is."""
    counts = ex.agg(F.count_if(F.col("split") == "held_out").alias("held"), F.count("*").alias("n"))
    code = F.when((F.col("n") > 0) & (F.col("held") == 0), "no_held_out_split").when((F.col("n") > 0) & (F.col("held") == F.col("n")), "only_held_out_present")
    return counts.withColumn("_c", code).where("_c is not null").select(*_finding("review", "", F.lit("split")), "_c").withColumn("code", F.col("_c")).drop("_c")


def media(ex: DataFrame, files: DataFrame | None) -> DataFrame:
    """Missing and empty media; one finding for each path, told of its first row. ``files`` has path and length."""
    if files is None:
        return ex.sparkSession.range(1).select(*_finding("review", "media_check_disabled", F.lit("media")))
    first = ex.groupBy("video_path").agg(F.min_by(F.struct("example_id", "clip_id"), "ord").alias("r"))
    seen = first.join(files.select(F.col("path").alias("video_path"), "length"), "video_path", "left")
    code = F.when(F.col("length").isNull(), "missing_video").when(F.col("length") == 0, "unreadable_video_empty")
    bad = seen.withColumn("_c", code).where("_c is not null")
    return bad.select(*_finding("error", "", F.col("video_path"), F.array("r.example_id"), F.array("r.clip_id")), "_c").withColumn("code", F.col("_c")).drop("_c")


def malformed(lines: DataFrame) -> DataFrame:
    """Findings for lines that could not be read (line_no, error)."""
    return lines.select(*_finding("error", "malformed_metadata", F.concat(F.lit("line "), F.col("line_no").cast("string")), None, None, F.col("error")))


def findings(ex: DataFrame, options: Options | None = None, files: DataFrame | None = None) -> DataFrame:
    """All findings of a manifest."""
    o = options or Options()
    parts = [
        first_violation(ex), duplicate_ids(ex), ground_truth(ex, o.allowed_answers), clip_consistency(ex), duplicate_video_path(ex),
        fps_and_spans(ex, o.expected_fps), split_leakage(ex), split_presence(ex), shared_content_hash(ex), duplicate_questions(ex), dense_combos(ex),
    ]
    if files is not None:
        parts.append(media(ex, files))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ordered(found: DataFrame) -> DataFrame:
    """Findings by severity, code and subject."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, k) for s, k in SEVERITIES.items()])
    return found.orderBy(rank, "code", "subject")


def report(ex: DataFrame, found: DataFrame, fail_on_leakage: bool = True) -> DataFrame:
    """One row: records, clips, findings by severity and whether the manifest passes."""
    counts = found.agg(*[F.count_if(F.col("severity") == s).cast("long").alias(f"n_{s}") for s in SEVERITIES])
    sizes = ex.agg(F.count("*").cast("long").alias("n_records"), F.count_distinct("clip_id").cast("long").alias("n_clips"))
    passed = (F.col("n_error") == 0) & ((F.col("n_leakage") == 0) if fail_on_leakage else F.lit(True))
    return sizes.crossJoin(counts).withColumn("passed", passed)
