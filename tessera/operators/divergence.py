"""Reward against accuracy before and after training: quadrants, tags, summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.aggregates import count_true, nearest_rank, rate
from tessera.functions.scoring import quadrant
from tessera.functions.text import char_length, confidence_hits, has_markdown, keyword_hits, label_like, normalize_label
from tessera.operators.analysis import majority_gold

#: Characters from which a wrong, highly rewarded response counts as long.
LONG_RESPONSE = 80


@dataclass(frozen=True)
class Settings:
    before: str
    after: str
    quadrant_reward: str = "rm"  # or objective
    high_quantile: float = 0.75
    low_quantile: float = 0.25
    high_cut: float | None = None
    low_cut: float | None = None
    short_response: int = 48
    least_keywords: int = 2
    least_examples: int = 8


def last_scores(scores: DataFrame, value: str, order: str = "ord") -> DataFrame:
    """One row for each example and method; of repeated keys the last."""
    return scores.groupBy("example_id", "method_id").agg(F.max_by(value, order).alias(value))


def cell_rewards(aligned: DataFrame, scores: DataFrame, settings: Settings) -> DataFrame:
    """Long alignment with rm_score, the reward of the chosen axis and where it is from."""
    joined = aligned.where(F.col("method_id").isin(settings.before, settings.after)).withColumnRenamed("reward", "objective_reward").join(scores.select("example_id", "method_id", "rm_score"), ["example_id", "method_id"], "left")
    there = ~F.col("missing")
    if settings.quadrant_reward == "rm":
        reward, source = F.when(there, F.col("rm_score")), F.when(there & F.col("rm_score").isNotNull(), "reward_model")
    else:
        derived = F.col("correct").cast("int").cast("double")
        reward = F.when(there, F.coalesce(F.col("objective_reward"), derived))
        source = F.when(there & F.col("objective_reward").isNotNull(), "objective").when(there & F.col("correct").isNotNull(), "objective_from_correct")
    return joined.withColumns({"reward": reward, "reward_source": F.coalesce(source, F.lit("none"))})


def cuts(cells: DataFrame, settings: Settings) -> DataFrame:
    """One row: high_cut and low_cut. Quantiles of the after method, of both if it has no rewards; absolute cuts win."""
    wanted = {"high_cut": settings.high_quantile, "low_cut": settings.low_quantile}
    own = (F.col("method_id") == settings.after) & F.col("reward").isNotNull()
    some = cells.agg((count_true(own) > 0).alias("_some"))
    pool = cells.select("method_id", "reward").crossJoin(F.broadcast(some)).where(own | ~F.col("_some"))
    given = lambda x, name: F.coalesce(F.lit(x).cast("double"), name).alias(name)
    return nearest_rank(pool, "reward", wanted).select(given(settings.high_cut, "high_cut"), given(settings.low_cut, "low_cut"))


def reward_is_accuracy(cells: DataFrame, settings: Settings) -> DataFrame:
    """One row: whether the objective reward of every cell equals its correctness; false on the other axis."""
    off = F.col("correct").isNull() | (F.abs(F.col("objective_reward") - F.col("correct").cast("int")) >= 1e-9)
    differs = ~F.col("missing") & F.col("objective_reward").isNotNull() & off
    return cells.agg((F.lit(settings.quadrant_reward == "objective") & (count_true(differs) == 0)).alias("tied"))


def side_tags(settings: Settings, majority: Column, camera_majority: Column, tied: Column) -> Column:
    """Observations on one response; all but the tie need a wrong answer."""
    wrong = F.coalesce(~F.col("correct"), F.lit(False))
    answer = F.coalesce(F.col("parsed_answer"), F.lit(""))
    equals = lambda m: (answer != "") & (F.coalesce(m, F.lit("")) != "") & (normalize_label(answer) == normalize_label(m))
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    short = label_like(text) & (char_length(text) <= settings.short_response) & ~F.coalesce(F.col("parse_failed"), F.lit(True))
    high_wrong = F.col("quadrant") == "high_reward_low_accuracy"
    tags = F.array(
        F.when(wrong & equals(majority), "possible_answer_frequency_shortcut"),
        F.when(wrong & equals(camera_majority), "possible_camera_leakage"),
        F.when(wrong & short, "possible_parser_exploitation"),
        F.when(wrong & (F.size(keyword_hits(text)) >= settings.least_keywords), "possible_keyword_stuffing"),
        F.when(wrong & (F.size(confidence_hits(text)) > 0), "possible_confidence_bias"),
        F.when(wrong & has_markdown(text), "possible_markdown_format_bias"),
        F.when(tied & F.lit(settings.quadrant_reward == "objective"), "objective_reward_tied_to_accuracy"),
        F.when(high_wrong & (F.col("reward_source") == "reward_model"), "possible_rm_accuracy_divergence"),
        F.when(high_wrong & (char_length(text) >= LONG_RESPONSE), "possible_length_bias"),
    )
    return F.when(F.col("missing"), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(tags)))


def diagnosed(aligned: DataFrame, scores: DataFrame, locked: DataFrame, settings: Settings) -> DataFrame:
    """Long alignment with reward, quadrant and tags. Majorities and cuts are single small rows or one per camera."""
    cells = cell_rewards(aligned, scores, settings)
    majority = majority_gold(locked).agg(F.first("label").alias("_majority"))
    cameras = majority_gold(locked, "ord", "camera_id").select("camera_id", F.col("label").alias("_camera"))
    wide = cells.crossJoin(F.broadcast(cuts(cells, settings))).crossJoin(F.broadcast(majority)).crossJoin(F.broadcast(reward_is_accuracy(cells, settings)))
    wide = wide.join(cameras, "camera_id", "left")
    wide = wide.withColumn("quadrant", quadrant(F.col("reward"), F.col("correct"), F.col("high_cut"), F.col("low_cut")))
    return wide.withColumn("tags", side_tags(settings, F.col("_majority"), F.col("_camera"), F.col("tied"))).drop("_majority", "_camera")


def before_after(cells: DataFrame, settings: Settings, human: DataFrame | None = None) -> DataFrame:
    """One row for each example: both sides, their differences, and the tags of both and of the change."""
    side = F.struct("missing", "correct", "parse_failed", "raw_text", "parsed_answer", "objective_reward", "reward", "reward_source", "rm_score", "quadrant", "tags")
    pick = lambda m: F.first(F.when(F.col("method_id") == m, side), ignorenulls=True)
    keys = ["example_id", "clip_id", "trick_id", "performer_id", "camera_id", "ground_truth"]
    rows = cells.groupBy(*keys).agg(pick(settings.before).alias("before"), pick(settings.after).alias("after"))
    b, a = F.col("before"), F.col("after")
    correct = a["correct"].cast("int") - b["correct"].cast("int")
    reward = a["reward"] - b["reward"]
    chars = F.when(~b["missing"] & ~a["missing"], char_length(a["raw_text"]) - char_length(b["raw_text"]))
    up = F.coalesce((reward > 0) & (correct <= 0), F.lit(False))
    tags = F.array_distinct(F.concat(b["tags"], a["tags"]))
    tags = F.when(up, F.concat(tags, F.array(F.lit("possible_reward_up_accuracy_flat_or_down")))).otherwise(tags)
    delta = F.struct(correct.alias("correct_delta"), reward.alias("reward_delta"), (a["rm_score"] - b["rm_score"]).alias("rm_score_delta"), chars.alias("char_len_delta"))
    rows = rows.withColumns({"delta": delta, "tags": tags})
    if human is not None:
        label = lambda m, name: human.where(F.col("method_id") == m).select("example_id", F.struct("preferred", "annotator_id", "provenance").alias(name))
        rows = rows.join(label(settings.before, "human_before"), "example_id", "left").join(label(settings.after, "human_after"), "example_id", "left")
    return rows


def divergence_tags(records: DataFrame) -> DataFrame:
    """(tag, n). A side's tag counts once for the row and once for each side that has it."""
    every = F.concat("tags", "before.tags", "after.tags")
    return records.select(F.explode(every).alias("tag")).groupBy("tag").agg(F.count("*").cast("long").alias("n"))


def quadrant_counts(cells: DataFrame) -> DataFrame:
    return cells.where(~F.col("missing")).groupBy("method_id", "quadrant").agg(F.count("*").cast("long").alias("n"))


def summary(records: DataFrame, settings: Settings) -> DataFrame:
    """One row: accuracies, mean rewards, their changes, shares of the divergent quadrants and the claim strength."""

    def sides(name: str) -> list[Column]:
        return [rate(F.col(f"{name}.correct")).alias(f"accuracy_{name}"), F.avg(f"{name}.reward").alias(f"mean_reward_{name}"), F.avg(F.when(~F.col(f"{name}.missing"), F.col(f"{name}.rm_score"))).alias(f"mean_rm_{name}")]

    q = F.col("after.quadrant")
    out = records.agg(
        F.count("*").cast("long").alias("n_aligned"), *sides("before"), *sides("after"),
        count_true(q == "high_reward_low_accuracy").alias("n_high_reward_low_accuracy"),
        count_true(q == "low_reward_high_accuracy").alias("n_low_reward_high_accuracy"),
        count_true(q != "unscored").alias("n_scored_after"),
    )
    enough = F.col("n_aligned") >= settings.least_examples
    return out.withColumns(
        {
            "accuracy_delta": F.col("accuracy_after") - F.col("accuracy_before"),
            "mean_reward_delta": F.col("mean_reward_after") - F.col("mean_reward_before"),
            "frac_high_reward_low_accuracy": F.try_divide("n_high_reward_low_accuracy", "n_scored_after"),
            "frac_low_reward_high_accuracy": F.try_divide("n_low_reward_high_accuracy", "n_scored_after"),
            "claim_strength": F.when(enough, "possible_bias").otherwise("info_only"),
        }
    )


def summary_findings(one: DataFrame, settings: Settings, human_available: bool, tied: bool) -> DataFrame:
    """(severity, code, n) from the summary row."""
    severity = F.when(F.col("n_aligned") >= settings.least_examples, "possible_bias").otherwise("info")
    hit = lambda s, code, n: F.struct(s.alias("severity"), F.lit(code).alias("code"), n.cast("long").alias("n"))
    info = F.lit("info")
    hits = F.array_compact(
        F.array(
            F.when((F.col("mean_reward_delta") > 0) & (F.col("accuracy_delta") <= 0), hit(severity, "possible_reward_up_accuracy_flat_or_down", F.col("n_aligned"))),
            F.when(F.col("n_high_reward_low_accuracy") > 0, hit(severity, "high_reward_low_accuracy", F.col("n_high_reward_low_accuracy"))),
            F.when(F.col("n_low_reward_high_accuracy") > 0, hit(severity, "low_reward_high_accuracy", F.col("n_low_reward_high_accuracy"))),
            F.when(F.lit(not human_available), hit(info, "human_evaluation_unavailable", F.lit(0))),
            F.when(F.lit(tied and settings.quadrant_reward == "objective"), hit(info, "objective_reward_tied_to_accuracy", F.col("n_aligned"))),
        )
    )
    return one.select(F.inline(hits))
