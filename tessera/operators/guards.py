"""Split filters and run-time guards against training on held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "val", "held_out")
#: Stages that fit something to the rows they get.
TRAINING_STAGES = ("train", "training", "dpo", "grpo", "ppo", "reward_model", "preference", "sft")


def of_split(rows: DataFrame, split: str) -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    return rows.where(F.col("split") == split)


def of_task(rows: DataFrame, task: str) -> DataFrame:
    return rows.where(F.col("task") == task)


def of_clip(rows: DataFrame, clip_id: str) -> DataFrame:
    return rows.where(F.col("clip_id") == clip_id)


def assert_no_held_out(rows: DataFrame, context: str) -> None:
    """Raise with the first ids if there are held-out rows; at most five are fetched."""
    found = [r[0] for r in rows.where("split = 'held_out'").select("example_id").orderBy("example_id").limit(5).collect()]
    if found:
        raise ValueError(f"{context}: held-out rows are not allowed: {', '.join(found)}")


def for_stage(rows: DataFrame, stage: str, allow_held_out: bool = False) -> DataFrame:
    """Rows for a stage. Training stages never yield held-out rows: they raise on one, or skip it if allowed."""
    if stage.strip().lower() not in TRAINING_STAGES:
        return rows
    if not allow_held_out:
        assert_no_held_out(rows, f"stage {stage!r}")
    return rows.where("split <> 'held_out'")


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(f"there are no {what}")
    return rows


def require_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` if no key occurs twice; else raise with the first keys."""
    twice = rows.groupBy(*keys).count().where("count > 1").orderBy(*keys).limit(5).collect()
    if twice:
        raise ValueError(f"{', '.join(keys)} occur more than once: {[tuple(r)[:-1] for r in twice]}")
    return rows


def grpo_rows(examples: DataFrame, allow_held_out: bool = False) -> DataFrame:
    """Prompt rows of hidden-state examples; a blank gold label is an error at run time."""
    from tessera.functions.text import blank, prompt

    rows = for_stage(of_task(examples, "hidden_state"), "grpo", allow_held_out)
    gold = F.when(blank(F.col("ground_truth")), F.raise_error(F.concat(F.lit("no gold label for "), F.col("example_id"))).cast("string")).otherwise(F.col("ground_truth"))
    return rows.select(prompt(F.col("question")).alias("prompt"), "example_id", gold.alias("ground_truth"), "split")


def rollout_rewards(rollouts: DataFrame, examples: DataFrame) -> DataFrame:
    """Rewards of completions; one without an example scores 0 and stays."""
    from tessera.functions.scoring import exact_match_reward

    joined = rollouts.join(examples.select("example_id", "ground_truth", "task"), "example_id", "left")
    scored = exact_match_reward(F.col("completion"), F.lit(None).cast("string"), F.col("ground_truth"), F.coalesce(F.col("task"), F.lit("unknown")))
    return joined.withColumn("r", scored).select(*rollouts.columns, F.coalesce("r.value", F.lit(0.0)).alias("reward"), F.coalesce("r.matched", F.lit(False)).alias("matched"), F.coalesce("r.parse_failed", F.lit(False)).alias("parse_failed"))
