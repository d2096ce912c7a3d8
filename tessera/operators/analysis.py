"""Failure analysis of scored predictions: tags, distributions, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.aggregates import count_true, entropy_bits, first_mode, rate
from tessera.functions.text import blank, exact_match, normalize_label, parse_failure, suggests_ambiguity
from tessera.operators.align import group_stats


def join_manifest(predictions: DataFrame, examples: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Predictions with example columns; a prediction without an example is an error at run time."""
    own = examples.select("example_id", *columns, F.lit(True).alias("_there"))
    joined = predictions.join(own, "example_id", "left")
    check = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no example "), F.col("example_id"))).cast("string")).otherwise(F.col("example_id"))
    return joined.withColumn("example_id", check).drop("_there")


def positional(examples: DataFrame, artifacts: DataFrame, predictions: DataFrame) -> DataFrame:
    """Three tables row by row (column ``ord``), with the columns of predictions and trick_id.

    Every position must be in all three with one example id; else it is an error
    at run time.
    """
    e = examples.select("ord", F.col("example_id").alias("_e"), "trick_id")
    a = artifacts.select("ord", F.col("example_id").alias("_a"))
    rows = e.join(a, "ord", "full").join(predictions.drop("trick_id"), "ord", "full")
    aligned = F.col("_e").eqNullSafe(F.col("_a")) & F.col("_e").eqNullSafe(F.col("example_id")) & F.col("_e").isNotNull()
    broken = F.raise_error(F.concat(F.lit("rows differ at position "), F.col("ord").cast("string"))).cast("string")
    return rows.withColumn("example_id", F.when(aligned, F.col("example_id")).otherwise(broken)).drop("_e", "_a")


def diagnostic_tags(correct: Column, failed: Column, raw: Column, parsed: Column, error: Column, mode: Column, majority: Column, *notes: Column) -> Column:
    """Observations on one prediction, in a fixed order; a correct one has only ``correct``."""
    mode = F.lower(F.coalesce(mode, F.lit("")))
    no_pixels = mode.contains("indices_only") | mode.isin("no_pixels", "meta_only")
    failure = failed | parse_failure(F.coalesce(raw, F.lit("")), parsed)
    tags = F.array(
        F.when(F.coalesce(error, F.lit("")) != "", "inference_error"),
        F.when(blank(raw), "empty_raw_response"),
        F.when(failure, "parse_failure").when(~blank(parsed), "wrong_label"),
        F.when(no_pixels, "visual_input_missing").when(mode.contains("pixel"), "incorrect_with_pixels_present"),
        F.when((F.coalesce(majority, F.lit("")) != "") & parsed.isNotNull() & (normalize_label(parsed) == normalize_label(majority)), "possible_answer_frequency_shortcut"),
        F.when(suggests_ambiguity(*notes), "ambiguity_or_task_design_note") if notes else F.lit(None).cast("string"),
    )
    return F.when(correct, F.array(F.lit("correct"))).otherwise(F.array_distinct(F.array_compact(tags)))


def majority_gold(rows: DataFrame, order: str = "ord", *keys: str) -> DataFrame:
    """The most frequent normalised gold label, of equals the first seen; blank labels do not count."""
    labels = rows.where(~blank(F.col("ground_truth"))).withColumn("label", normalize_label(F.col("ground_truth")))
    return first_mode(labels, "label", order, *keys)


def tag_counts(rows: DataFrame, tags: str = "tags") -> DataFrame:
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").cast("long").alias("n"))


def label_counts(rows: DataFrame) -> DataFrame:
    """(side, label, n): gold and predicted labels, normalised; missing gold and unparsed predictions have buckets."""
    gold = F.coalesce(F.nullif(normalize_label(F.col("ground_truth")), F.lit("")), F.lit("<missing>"))
    predicted = F.when(F.col("parsed_answer").isNull(), "<unparsed>").otherwise(normalize_label(F.col("parsed_answer")))
    sides = F.array(F.struct(F.lit("gold").alias("side"), gold.alias("label")), F.struct(F.lit("predicted").alias("side"), predicted.alias("label")))
    return rows.select("ord", F.inline(sides)).groupBy("side", "label").agg(F.count("*").cast("long").alias("n"), F.min("ord").alias("seen"))


def label_entropy(counts: DataFrame, side: str) -> DataFrame:
    return entropy_bits(counts.where(F.col("side") == side), "n").select(F.lit(side).alias("side"), "entropy_bits")


def distribution_summary(rows: DataFrame) -> DataFrame:
    """One row: majority gold label, its share and baseline accuracy, and the predicted mode."""
    majority = majority_gold(rows).select(F.col("label").alias("majority_label"), F.col("n").alias("majority_count"))
    predicted = label_counts(rows).where("side = 'predicted'")
    mode = predicted.agg(F.max_by(F.struct("label", "n"), F.struct(F.col("n"), -F.col("seen"))).alias("m")).select("m.label", "m.n")
    total = rows.agg(F.count("*").alias("n_rows"))
    golds = rows.groupBy(normalize_label(F.col("ground_truth")).alias("majority_label")).agg(F.count("*").alias("n_same"))
    wide = total.join(F.broadcast(majority), F.lit(True), "left").join(golds, "majority_label", "left").join(F.broadcast(mode), F.lit(True), "left")
    return wide.select(
        "majority_label",
        F.coalesce("majority_count", F.lit(0)).cast("long").alias("majority_count"),
        F.when(F.col("majority_label").isNotNull(), F.try_divide("majority_count", "n_rows")).alias("majority_fraction"),
        F.when(F.col("majority_label").isNotNull(), F.try_divide(F.coalesce("n_same", F.lit(0)), "n_rows")).alias("majority_baseline_accuracy"),
        F.col("label").alias("predicted_mode"),
        F.try_divide("n", "n_rows").alias("predicted_mode_fraction"),
    )


def scored(rows: DataFrame) -> DataFrame:
    """``rows`` with correct and parse_failed recomputed from what was said and the gold label."""
    failed = parse_failure(F.coalesce(F.col("raw_text"), F.lit("")), F.col("parsed_answer"))
    return rows.withColumns({"parse_failed": failed, "correct": ~failed & exact_match(F.col("parsed_answer"), F.col("ground_truth"))})


def accuracy_by_split(rows: DataFrame) -> DataFrame:
    """Overall and for each split that occurs; of no rows, a null accuracy overall."""
    overall = rows.agg(F.lit("overall").alias("split"), F.count("*").cast("long").alias("n"), rate(F.col("correct")).alias("accuracy"))
    each = rows.groupBy("split").agg(F.count("*").cast("long").alias("n"), rate(F.col("correct")).alias("accuracy"))
    return overall.unionByName(each)


def run_summary(rows: DataFrame) -> DataFrame:
    """One row of a run: counts, rates and the mean latency of the rows that have one."""
    return rows.agg(
        F.count("*").cast("long").alias("n_examples"),
        count_true(F.col("correct")).alias("n_correct"),
        rate(F.col("correct")).alias("overall_accuracy"),
        count_true(F.col("parse_failed")).alias("n_parse_failures"),
        rate(F.col("parse_failed")).alias("parse_failure_rate"),
        F.avg("latency_s").alias("mean_latency_s"),
    )


def score_summary(rows: DataFrame) -> DataFrame:
    """n and accuracy, which is 0 and not null for no rows."""
    return rows.agg(F.count("*").cast("long").alias("n"), F.coalesce(rate(F.col("correct")), F.lit(0.0)).alias("accuracy"))


def integrity(rows: DataFrame, key: str = "trick_id") -> DataFrame:
    """One row of self-checks: group totals and counts must agree with the number of rows."""
    groups = group_stats(rows, key).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("sum_groups"))
    totals = rows.agg(F.count("*").cast("long").alias("n"), count_true(F.col("correct")).alias("n_correct"), count_true(~F.col("correct")).alias("n_incorrect"))
    both = totals.crossJoin(groups)
    return both.select("n", "sum_groups", (F.col("sum_groups") == F.col("n")).alias("groups_match"), (F.col("n_correct") + F.col("n_incorrect") == F.col("n")).alias("counts_match"))


def split_lock(examples: DataFrame) -> DataFrame:
    """One row: the distinct clips and tricks that a run is locked to."""
    return examples.agg(F.array_sort(F.collect_set("clip_id")).alias("clip_ids"), F.array_sort(F.collect_set("trick_id")).alias("trick_ids"))


def temporal_pairs(ordered: DataFrame, shuffled: DataFrame) -> DataFrame:
    """Ordered and shuffled outcomes of each example; both sides must show the same frames."""
    from tessera.functions.scoring import paired_outcome

    a, b = ordered.alias("a"), shuffled.alias("b")
    both = a.join(b, "example_id")
    same = F.array_sort(F.col("a.frame_indices")).eqNullSafe(F.array_sort(F.col("b.frame_indices")))
    checked = F.when(~same, F.raise_error(F.concat(F.lit("frames differ for "), F.col("example_id"))).cast("boolean")).otherwise(F.col("a.correct"))
    return both.select("example_id", checked.alias("ordered_correct"), F.col("b.correct").alias("shuffled_correct")).withColumn("outcome", paired_outcome(F.col("ordered_correct"), F.col("shuffled_correct")))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Both accuracies, their difference and the four outcomes."""
    count = lambda o: F.count_if(F.col("outcome") == o).cast("long").alias(f"n_{o}")
    out = pairs.agg(F.count("*").cast("long").alias("n_pairs"), rate(F.col("ordered_correct")).alias("ordered_accuracy"), rate(F.col("shuffled_correct")).alias("shuffled_accuracy"), *map(count, ("both_correct", "both_incorrect", "ordered_only", "shuffled_only")))
    return out.withColumn("accuracy_difference", F.col("ordered_accuracy") - F.col("shuffled_accuracy"))


def reward_stats(rollouts: DataFrame) -> DataFrame:
    """n, mean, ones, zeros and parse failures of logged rollouts."""
    r = F.col("reward")
    return rollouts.agg(F.count("*").cast("long").alias("n_rollouts"), F.avg(r).alias("mean_reward"), F.count_if(r == 1).cast("long").alias("n_reward_one"), F.count_if(r == 0).cast("long").alias("n_reward_zero"), count_true(F.col("parse_failed")).alias("n_parse_failed"))


def best_epoch(metrics: DataFrame) -> DataFrame:
    """The epoch with the highest validation accuracy, of equals the latest, and the gap to training accuracy."""
    best = F.max_by(F.struct("epoch", "val_accuracy", "train_accuracy"), F.struct("val_accuracy", "epoch"))
    return metrics.agg(best.alias("b")).select("b.epoch", "b.val_accuracy", (F.col("b.train_accuracy") - F.col("b.val_accuracy")).alias("overfit_gap"))
