"""Evaluation on a locked example set: alignment, coverage, metrics, slices, deltas.

Alignment is kept long, one row for each example and method, so that every
metric is a grouped aggregate; ``nested`` gives one row for each example.
Missing predictions stay as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.aggregates import count_true, rate
from tessera.functions.text import exact_match, parse_failure

IDENTITIES = ("trick_id", "performer_id", "camera_id", "prop_id", "question_variant")
AXES = (*IDENTITIES, "clip_id")
SLICES = ("unseen_trick", "unseen_performer", "unseen_camera", "unseen_prop", "unseen_wording", "known_trick_variation", "all_locked")


def locked(examples: DataFrame, split: str = "held_out", task: str = "hidden_state") -> DataFrame:
    """The examples that all methods are compared on."""
    return examples.where((F.col("split") == split) & (F.col("task") == task))


def normalized_predictions(predictions: DataFrame) -> DataFrame:
    """Stored flags and rewards where there are any, else derived ones, row by row.

    ``_keys`` lists the keys that a row's line has; without that column every row
    has the columns that the source has. A key that is absent is derived; one
    that is there and null is false, as for ``correct`` and ``parse_failed``.
    """
    columns = set(predictions.columns)

    def given(name: str) -> Column:
        if name not in columns:
            return F.lit(False)
        return F.array_contains("_keys", name) if "_keys" in columns else F.lit(True)

    def stored(name: str) -> Column:
        return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in columns else F.lit(False)

    raw = F.coalesce(F.col("raw_text"), F.lit("")) if "raw_text" in columns else F.lit("")
    gold = F.col("ground_truth") if "ground_truth" in columns else F.lit(None).cast("string")
    failed = F.when(given("parse_failed"), stored("parse_failed")).otherwise(parse_failure(raw, F.col("parsed_answer")))
    df = predictions.withColumns({"raw_text": raw, "parse_failed": failed})
    own = F.when(gold.isNotNull(), ~F.col("parse_failed") & exact_match(F.col("parsed_answer"), gold))
    df = df.withColumn("correct", F.when(given("correct"), stored("correct")).when(given("matched"), stored("matched")).otherwise(own))
    reward = F.col("reward").cast("double") if "reward" in columns else F.lit(None).cast("double")
    return df.withColumn("reward", F.coalesce(reward, F.col("correct").cast("int").cast("double"))).drop("_keys")


def align(examples: DataFrame, methods: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row for each locked example and method, with ``missing`` where there is no prediction.

    ``methods`` (method_id) is a configured list of a few rows, so its product
    with the examples is broadcast. A null ``correct`` is recomputed from gold.
    """
    cells = examples.crossJoin(F.broadcast(methods.select("method_id").distinct()))
    found = normalized_predictions(predictions)
    gold = found["ground_truth"] if "ground_truth" in found.columns else F.lit(None).cast("string")
    found = found.select("example_id", "method_id", "raw_text", "parsed_answer", "parse_failed", "correct", "reward", gold.alias("_gold"), F.lit(True).alias("_there"))
    joined = cells.join(found, ["example_id", "method_id"], "left")
    gold = F.coalesce(F.col("ground_truth"), F.col("_gold"))
    again = F.when(F.col("_there") & gold.isNotNull(), ~F.col("parse_failed") & exact_match(F.col("parsed_answer"), gold))
    return joined.withColumns({"missing": F.col("_there").isNull(), "correct": F.coalesce(F.col("correct"), again)}).drop("_there", "_gold")


def nested(aligned: DataFrame) -> DataFrame:
    """One row for each example with a map of method cells."""
    cell = F.struct("missing", "correct", "parse_failed", "raw_text", "parsed_answer", "reward")
    keys = [c for c in aligned.columns if c not in ("method_id", "missing", "correct", "parse_failed", "raw_text", "parsed_answer", "reward")]
    return aligned.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("method_id"), cell.alias("cell"))))).alias("methods"))


def coverage(aligned: DataFrame, first: int = 5) -> DataFrame:
    """Present and missing cells of each method, with the first missing ids."""
    ids = F.slice(F.array_sort(F.collect_set(F.when(F.col("missing"), F.col("example_id")))), 1, first)
    return aligned.groupBy("method_id").agg(
        F.count("*").cast("long").alias("n_locked"),
        count_true(~F.col("missing")).alias("n_present"),
        count_true(F.col("missing")).alias("n_missing"),
        (count_true(F.col("missing")) == 0).alias("full_coverage"),
        ids.alias("first_missing"),
    )


def missing_ids(aligned: DataFrame) -> DataFrame:
    return aligned.where("missing").select("method_id", "example_id")


def extra_ids(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions for examples outside the lock."""
    return predictions.select("method_id", "example_id").join(examples.select("example_id"), "example_id", "left_anti").select("method_id", "example_id").distinct()


def require_full_coverage(aligned: DataFrame) -> DataFrame:
    """``aligned``, failing at run time on the first missing cell."""
    text = F.concat(F.lit("method "), F.col("method_id"), F.lit(" lacks locked example "), F.col("example_id"))
    return aligned.withColumn("missing", F.when(F.col("missing"), F.raise_error(text).cast("boolean")).otherwise(F.lit(False)))


def method_metrics(aligned: DataFrame) -> DataFrame:
    """Counts, accuracy over scored cells, and the parse failure rate, which divides all failures by scored cells."""
    there = ~F.col("missing")
    scored = count_true(there & F.col("correct").isNotNull())
    failures = count_true(there & F.col("parse_failed"))
    return aligned.groupBy("method_id").agg(
        F.count("*").cast("long").alias("n_locked"),
        scored.alias("n_scored"),
        count_true(F.col("missing")).alias("n_missing"),
        count_true(F.col("correct")).alias("n_correct"),
        rate(F.col("correct")).alias("accuracy"),
        failures.alias("n_parse_failures"),
        F.try_divide(failures.cast("double"), scored).alias("parse_failure_rate"),
        F.avg(F.when(there, F.col("reward"))).alias("mean_reward"),
    )


def deltas(metrics: DataFrame, reference: str) -> DataFrame:
    """Each other method against the reference; null where either side is."""
    ref = metrics.where(F.col("method_id") == reference).select(F.col("accuracy").alias("_a"), F.col("mean_reward").alias("_r"))
    others = metrics.where(F.col("method_id") != reference).crossJoin(F.broadcast(ref))
    return others.select("method_id", (F.col("accuracy") - F.col("_a")).alias("accuracy_delta"), (F.col("mean_reward") - F.col("_r")).alias("mean_reward_delta"))


def identity_metrics(aligned: DataFrame, identities: tuple[str, ...] = IDENTITIES) -> DataFrame:
    """All breakdowns at once: method, identity, key and its counts; null and empty keys are ``unknown``."""
    scored = aligned.where(~F.col("missing") & F.col("correct").isNotNull())
    named = scored.select("method_id", "correct", "parse_failed", *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c) for c in identities])
    sets = [[F.col("method_id"), F.col(c)] for c in identities]
    which = F.lit(None).cast("string")
    for c in identities:
        which = F.when(F.grouping(c) == 0, c).otherwise(which)
    out = named.groupingSets(sets, "method_id", *identities).agg(which.alias("identity"), F.coalesce(*identities).alias("key"), *group_columns())
    return out.select("method_id", "identity", "key", "n", "n_correct", "accuracy", "n_parse_failures")


def group_columns() -> list[Column]:
    return [F.count("*").cast("long").alias("n"), count_true(F.col("correct")).alias("n_correct"), rate(F.col("correct")).alias("accuracy"), count_true(F.col("parse_failed")).alias("n_parse_failures")]


def group_stats(rows: DataFrame, key: str) -> DataFrame:
    """Counts and accuracy of each group."""
    return rows.groupBy(F.col(key).alias("key")).agg(*group_columns())


def seen_values(examples: DataFrame) -> DataFrame:
    """(axis, value) that occur outside the held-out split; empty props and wordings are no value."""
    kept = examples.where("split <> 'held_out'")
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in AXES])
    long = kept.select(F.inline(pairs)).where(F.col("value").isNotNull() & ~(F.col("axis").isin("prop_id", "question_variant") & (F.col("value") == "")))
    return long.distinct()


def axis_flags(examples: DataFrame, seen: DataFrame) -> DataFrame:
    """``examples`` with the generalisation axes of each; one join for each axis with its seen values."""
    out = examples
    for axis in AXES[:-1]:
        known = seen.where(F.col("axis") == axis).select(F.col("value").alias(axis), F.lit(True).alias(f"_{axis}"))
        out = out.join(known, axis, "left").withColumn(f"_{axis}", F.coalesce(F.col(f"_{axis}"), F.lit(False)))
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    wording = given("question_variant") & ~F.col("_question_variant")
    flags = {
        "unseen_trick": ~F.col("_trick_id"),
        "unseen_performer": ~F.col("_performer_id"),
        "unseen_camera": ~F.col("_camera_id"),
        "unseen_prop": given("prop_id") & ~F.col("_prop_id"),
        "unseen_wording": wording,
        "known_trick_variation": F.col("_trick_id") & wording,
        "has_prop_id": F.col("prop_id").isNotNull(),
        "has_question_variant": F.col("question_variant").isNotNull(),
    }
    return out.withColumns(flags).drop(*[f"_{a}" for a in AXES[:-1]]).select(*examples.columns, *flags)


def slice_accuracy(aligned: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Accuracy of each method in each slice; a slice without scored cells has no row. ``extra`` adds slices by predicate."""
    predicates = {s: F.col(s) for s in SLICES[:-1]} | {"all_locked": F.lit(True)} | (extra or {})
    active = F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in predicates.items()]))
    scored = aligned.where(~F.col("missing") & F.col("correct").isNotNull())
    long = scored.select("method_id", "correct", F.explode(active).alias("slice"))
    return long.groupBy("slice", "method_id").agg(F.count("*").cast("long").alias("n"), count_true(F.col("correct")).alias("n_correct"), rate(F.col("correct")).alias("accuracy"))


def protocol_report(policies: dict[str, str]) -> dict:
    """Whether all methods share one generation policy; values are policy fingerprints."""
    return {"compatible": len(set(policies.values())) <= 1, "fingerprints": policies, "n_distinct_policies": len(set(policies.values()))}
