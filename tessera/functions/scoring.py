"""Rewards and losses as column expressions, and a registry of rewards by id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.intervals import gold_interval, iou, let, parse_interval, temporal_value
from tessera.functions.text import blank, char_length, exact_match, extract_prediction, normalize_label, parse_failure

EXACT_MATCH, TEMPORAL = "hidden_state_exact_match", "temporal_iou"


def exact_match_value(prediction: Column, gold: Column, failed: Column) -> Column:
    """1 for a usable prediction that equals the gold label, else 0."""
    usable = ~failed & ~blank(prediction) & ~blank(gold)
    return F.when(usable & exact_match(prediction, gold), 1.0).otherwise(0.0)


def exact_match_reward(raw: Column, parsed: Column, gold: Column, task: Column) -> Column:
    """value, matched, parse_failed, prediction, canonical forms and notes; other tasks score 0 with a note."""
    own = task == "hidden_state"
    prediction = F.when(own, extract_prediction(raw, parsed))
    failed = own & parse_failure(raw, extract_prediction(raw, parsed))
    value = F.when(own, exact_match_value(prediction, gold, failed)).otherwise(0.0)
    notes = F.when(~own, F.concat(F.lit("reward applies to hidden_state only (got "), task, F.lit(")"))).when(failed, "parse_failed").when(value != 1, "label_mismatch")
    return F.struct(
        value.alias("value"), (own & (value == 1)).alias("matched"), failed.alias("parse_failed"), prediction.alias("prediction"), gold.alias("gold"),
        normalize_label(prediction).alias("canonical_prediction"), normalize_label(gold).alias("canonical_gold"), notes.alias("notes"),
    )


def temporal_reward(raw: Column, causal: Column, mode: str = "binary", threshold: float = 0.5, unit: str = "auto") -> Column:
    """value, matched, iou, parse_failed, intervals and notes. The response must use the gold interval's unit."""

    def judge(x: Column) -> Column:
        gold, said, failed = x["gold"], x["said"], x["said"]["reason"].isNotNull()
        overlap = F.when(gold["eligible"] & ~failed, iou(said["interval"], gold["interval"]))
        return let(overlap, lambda o: result(gold, said, failed, o))

    def result(gold: Column, said: Column, failed: Column, overlap: Column) -> Column:
        weak = (overlap < threshold) if mode == "binary" else (overlap == 0)
        notes = F.when(~gold["eligible"], gold["reason"]).when(failed, said["reason"]).when(weak, "below_iou_threshold" if mode == "binary" else "no_overlap")
        value = temporal_value(overlap, gold["eligible"], failed, mode, threshold)
        matched = F.coalesce(overlap >= threshold, F.lit(False))
        return F.struct(value.alias("value"), matched.alias("matched"), overlap.alias("iou"), failed.alias("parse_failed"), said["interval"].alias("predicted"), gold["interval"].alias("gold"), gold["eligible"].alias("eligible"), notes.alias("notes"))

    def both(gold: Column) -> Column:
        wanted = F.coalesce(F.when(gold["eligible"], gold["interval"]["unit"]), F.lit(unit))
        return F.struct(gold.alias("gold"), parse_interval(raw, wanted).alias("said"))

    return let(gold_interval(causal, unit), lambda g: let(both(g), judge))


def length_penalty(base: Column, raw: Column, most: int = 200) -> Column:
    """A diagnostic probe: the base score halves as the response reaches ``most`` characters."""
    return base * (1.0 - 0.5 * F.least(char_length(raw) / float(most), F.lit(1.0)))


def bradley_terry_loss(delta: Column) -> Column:
    """-log sigmoid(delta), stable at both ends."""
    x = -delta
    return F.when(x > 50, x).when(x < -50, F.exp(x)).otherwise(F.log1p(F.exp(x)))


def paired_outcome(ordered: Column, shuffled: Column) -> Column:
    return F.when(ordered & shuffled, "both_correct").when(~ordered & ~shuffled, "both_incorrect").when(ordered, "ordered_only").otherwise("shuffled_only")


def quadrant(reward: Column, correct: Column, high: Column, low: Column) -> Column:
    """Reward against accuracy; the first rule that holds decides where cuts cross."""
    unknown = reward.isNull() | correct.isNull() | high.isNull() | low.isNull()
    return (
        F.when(unknown, "unscored")
        .when((reward >= high) & ~correct, "high_reward_low_accuracy")
        .when((reward <= low) & correct, "low_reward_high_accuracy")
        .when((reward >= high) & correct, "high_reward_high_accuracy")
        .when((reward <= low) & ~correct, "low_reward_low_accuracy")
        .otherwise("unscored")
    )


REWARDS: dict[str, Callable[..., Column]] = {
    EXACT_MATCH: lambda raw, parsed, gold, task, causal=None, **_: exact_match_reward(raw, parsed, gold, task),
    "exact_match": lambda raw, parsed, gold, task, causal=None, **_: exact_match_reward(raw, parsed, gold, task),
    TEMPORAL: lambda raw, parsed, gold, task, causal=None, **kw: temporal_reward(raw, causal, **kw),
}
VERSIONS = {EXACT_MATCH: "1.0.0", "exact_match": "1.0.0", TEMPORAL: "1.0.0"}
RESERVED = ("explanation_quality",)


def build_reward(reward_id: str, version: str | None = None) -> Callable[..., Column]:
    """The expression builder of a registered reward; a pinned version must be the registered one."""
    if reward_id in RESERVED:
        raise NotImplementedError(f"reward {reward_id!r} is reserved")
    if reward_id not in REWARDS:
        raise KeyError(f"unknown reward {reward_id!r}; known: {sorted(REWARDS)}")
    if version is not None and version != VERSIONS[reward_id]:
        raise ValueError(f"reward {reward_id!r} has version {VERSIONS[reward_id]}, not {version}")
    return REWARDS[reward_id]


def compare_rewards(raw: Column, parsed: Column, gold: Column, task: Column, causal: Column) -> Column:
    """Both rewards side by side; they are never combined."""
    return F.struct(exact_match_reward(raw, parsed, gold, task).alias("hidden_state"), temporal_reward(raw, causal).alias("temporal_iou"), F.lit(False).alias("combined"))
