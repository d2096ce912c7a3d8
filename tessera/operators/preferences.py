"""Preference judgments: validation, quality statistics, training projections."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.aggregates import count_true
from tessera.functions.text import blank, char_length, has_confidence, has_markdown, pair_id

FINDING = "severity string, code string, judgment_id string, pair_id string, n bigint"
#: Ways to name a side.
SIDES = {"a": "a", "response_a": "a", "1": "a", "b": "b", "response_b": "b", "2": "b", "tie": "tie"}


def chosen(a: str = "response_a", b: str = "response_b") -> Column:
    return F.when(F.col("winner") == "a", F.col(a)).when(F.col("winner") == "b", F.col(b))


def rejected(a: str = "response_a", b: str = "response_b") -> Column:
    return F.when(F.col("winner") == "a", F.col(b)).when(F.col("winner") == "b", F.col(a))


def comparison_label(winner: Column) -> Column:
    return F.when(winner == "a", 1).when(winner == "b", -1).otherwise(0)


def judged_side(answer: Column) -> Column:
    """What an annotator typed as a, b or tie; else null."""
    said = F.lower(F.trim(answer))
    out = F.lit(None).cast("string")
    for word, side in SIDES.items():
        out = F.when(said == word, side).otherwise(out)
    return out


def expected_pair_id() -> Column:
    return pair_id(F.col("clip_id"), F.col("instruction"), F.col("response_a"), F.col("response_b"), F.col("task"))


def dpo_rows(pairs: DataFrame) -> DataFrame:
    """Chosen and rejected responses of forced choices; ties are left out."""
    rows = pairs.where(F.col("winner").isin("a", "b"))
    return rows.select("judgment_id", "pair_id", "clip_id", "example_id", "instruction", chosen().alias("chosen"), rejected().alias("rejected"), "task", "split")


def trainer_rows(pairs: DataFrame, allow_held_out: bool = False) -> DataFrame:
    """prompt, chosen and rejected; a held-out judgment is an error unless allowed."""
    rows = dpo_rows(pairs if allow_held_out else refuse_held_out(pairs))
    return rows.select(F.col("instruction").alias("prompt"), "chosen", "rejected", "split")


def refuse_held_out(rows: DataFrame) -> DataFrame:
    """``rows``, failing at run time on a held-out one."""
    return rows.withColumn("split", F.when(F.col("split") == "held_out", F.raise_error(F.lit("held-out rows must not be trained on")).cast("string")).otherwise(F.col("split")))


def comparison_rows(pairs: DataFrame) -> DataFrame:
    """Both responses and the label 1, -1 or, for ties, 0."""
    return pairs.select("judgment_id", "pair_id", "clip_id", "instruction", "response_a", "response_b", comparison_label(F.col("winner")).cast("int").alias("label"), "winner", "annotator_id", "split")


def train_and_validation(rows: DataFrame, fallback: bool) -> tuple[DataFrame, DataFrame]:
    """Train and val rows. Without train rows: all that is not val if ``fallback``, else an error."""
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    if train.isEmpty():
        if not fallback:
            raise ValueError("there are no train rows")
        train = rows.where("split <> 'val'")
    return train, val


#: Ranges that one pass of ``smallest`` counts, and how many rows it sorts.
RANGES = 1024
SORTED = 10_000
#: Bits of the hash by which rows are dealt.
DEAL_BITS = 60


def dealt(key: Column, seed: int) -> Column:
    """A seeded hash of a key, from 0 up to 2^60."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, DEAL_BITS // 4), 16, 10).cast("long")


def smallest(rows: DataFrame, n: int, order: str, key: str) -> Column:
    """A condition for the n rows with the smallest (order, key); order is a long from 0 up to 2^60.

    Rows are counted by range, and the range that holds the n-th is narrowed down
    until few rows are left to sort, so no task ranks them all. Rows of equal
    order and key are taken together.
    """
    lo, bits, left = 0, DEAL_BITS, n
    inside = rows.select(order, F.col(key).cast("string").alias("_key"))
    while bits > 0 and n > 0:
        bits = max(0, bits - RANGES.bit_length() + 1)
        counts = inside.groupBy(F.shiftright(F.col(order) - lo, bits).alias("_range")).count().orderBy("_range").collect()
        for r in counts:
            if left <= r["count"]:
                break
            left -= r["count"]
        lo += r["_range"] << bits
        inside = inside.where(F.col(order).between(lo, lo + (1 << bits) - 1))
        if r["count"] <= SORTED:
            break
    if n <= 0:
        return F.lit(False)
    edge = inside.orderBy(order, "_key").limit(left).agg(F.max(F.struct(F.col(order).alias("o"), F.coalesce("_key", F.lit("")).alias("k"))).alias("m")).first()["m"]
    return (F.col(order) < edge["o"]) | ((F.col(order) == edge["o"]) & (F.coalesce(F.col(key).cast("string"), F.lit("")) <= edge["k"]))


def seeded_split(rows: DataFrame, key: str, seed: int, fraction: float) -> DataFrame:
    """``rows`` with column ``part``, train or val; held-out rows are an error at run time.

    Labelled rows keep their split. If there are train rows and no val, exactly
    max(1, round(n * fraction)) of the n train rows become val, none of a single one;
    the same without any labels, where one row at least stays in train. Which rows
    they are follows from a seeded hash of the key, so repeated keys stay together.
    Labelled rows beside others, or val rows without train rows, are refused. A
    fraction of 0 or less carves nothing.
    """
    rows = refuse_held_out(rows)
    kind = F.when(F.col("split").isin("train", "val"), F.col("split")).otherwise("none")
    n = {r["kind"]: r["count"] for r in rows.groupBy(kind.alias("kind")).count().collect()}
    labelled = n.get("train", 0) + n.get("val", 0)
    if labelled and n.get("none"):
        raise ValueError("rows with a train or val split beside rows without one")
    if n.get("val") and not n.get("train"):
        raise ValueError("there are no train rows")
    if n.get("val") or fraction <= 0:
        return rows.withColumn("part", F.when(F.col("split") == "val", "val").otherwise("train"))
    whole = labelled or n.get("none", 0)
    take = 0 if whole < 2 else max(1, round(whole * fraction))
    if not labelled:
        take = min(take, max(0, whole - 1))
    hashed = rows.withColumn("_dealt", dealt(F.col(key), seed))
    return hashed.withColumn("part", F.when(smallest(hashed, take, "_dealt", key), "val").otherwise("train")).drop("_dealt")


@dataclass(frozen=True)
class Policy:
    allow_ties: bool = True
    allow_identical_responses: bool = False
    require_rationale: bool = False
    allow_multiple_annotations: bool = True
    fail_on_review: bool = False


def validate(pairs: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Findings on single judgments and on content pairs that were judged more than once."""
    p = policy or Policy()
    again = F.row_number().over(Window.partitionBy("judgment_id").orderBy("ord")) > 1
    rules = [
        ("review", "pair_id_mismatch", F.col("pair_id") != expected_pair_id()),
        ("error", "duplicate_judgment_id", F.col("_again")),
        ("error", "tie_not_allowed", (F.col("winner") == "tie") & F.lit(not p.allow_ties)),
        ("review" if p.allow_identical_responses else "error", "identical_responses", F.col("response_a") == F.col("response_b")),
        ("review", "held_out_preference", F.col("split") == "held_out"),
    ]
    if p.require_rationale:
        rules.append(("error", "missing_rationale", blank(F.col("rationale"))))
    hits = F.array_compact(F.array(*[F.when(r, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for s, c, r in rules]))
    single = pairs.withColumn("_again", again).select("judgment_id", "pair_id", F.inline(hits)).select("severity", "code", "judgment_id", "pair_id", F.lit(1).cast("long").alias("n"))
    groups = pairs.groupBy("pair_id").agg(F.count("*").cast("long").alias("n"), F.count_distinct("winner").alias("winners")).where("n > 1")
    if p.allow_multiple_annotations:
        kinds = F.array_compact(F.array(F.lit("multiple_annotations"), F.when(F.col("winners") > 1, "annotator_disagreement")))
        severity = "review"
    else:
        kinds, severity = F.array(F.lit("duplicate_pair_id")), "error"
    several = groups.select(F.lit(severity).alias("severity"), F.explode(kinds).alias("code"), F.lit(None).cast("string").alias("judgment_id"), "pair_id", "n")
    return single.unionByName(several)


def passes(found: DataFrame, fail_on_review: bool = False) -> DataFrame:
    return found.agg(((F.count_if(F.col("severity") == "error") == 0) & (F.lit(not fail_on_review) | (F.count_if(F.col("severity") == "review") == 0))).alias("passed"))


def winner_balance(pairs: DataFrame) -> DataFrame:
    """Counts of winners; balanced if they differ by a tenth of the forced choices at most, or by one."""
    w = F.col("winner")
    out = pairs.agg(count_true(w == "a").alias("n_a"), count_true(w == "b").alias("n_b"), count_true(w == "tie").alias("n_tie")).withColumn("n_forced", F.col("n_a") + F.col("n_b"))
    apart = F.abs(F.col("n_a") - F.col("n_b"))
    return out.withColumns(
        {
            "frac_a": F.try_divide(F.col("n_a"), F.col("n_forced")),
            "frac_b": F.try_divide(F.col("n_b"), F.col("n_forced")),
            "abs_imbalance": apart,
            "balanced": apart <= F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(0.1) * F.col("n_forced"))),
        }
    )


def agreement(pairs: DataFrame) -> DataFrame:
    """Content pairs that were judged more than once, and how often all judgments agree."""
    groups = pairs.groupBy("pair_id").agg(F.count("*").alias("n"), F.count_distinct("winner").alias("w"))
    several = groups.agg(
        F.count("*").cast("long").alias("n_unique_pairs"),
        F.count_if(F.col("n") > 1).cast("long").alias("n_repeated"),
        F.count_if((F.col("n") > 1) & (F.col("w") == 1)).cast("long").alias("n_unanimous"),
        F.count_if((F.col("n") > 1) & (F.col("w") > 1)).cast("long").alias("n_contradictory"),
    )
    people = pairs.agg(F.count_distinct("annotator_id").cast("long").alias("n_annotators"))
    both = people.crossJoin(several)
    return both.withColumns({"agreement_rate": F.try_divide(F.col("n_unanimous"), F.col("n_repeated")), "can_estimate_reliability": (F.col("n_annotators") >= 2) & (F.col("n_repeated") >= 1)})


def length_stats(pairs: DataFrame) -> DataFrame:
    """Lengths of forced choices, and how often the preferred response is the longer one."""
    forced = pairs.where(F.col("winner").isin("a", "b")).select(char_length(F.col("response_a")).alias("a"), char_length(F.col("response_b")).alias("b"), char_length(chosen()).alias("c"), char_length(rejected()).alias("r"))
    delta = F.col("c") - F.col("r")
    return forced.agg(
        F.count("*").cast("long").alias("n"),
        F.avg("a").alias("mean_chars_a"),
        F.avg("b").alias("mean_chars_b"),
        F.avg("c").alias("mean_chars_preferred"),
        F.avg("r").alias("mean_chars_rejected"),
        F.count_if(delta > 0).cast("long").alias("n_longer"),
        F.count_if(delta < 0).cast("long").alias("n_shorter"),
        F.count_if(delta == 0).cast("long").alias("n_equal"),
        F.avg((delta > 0).cast("double")).alias("frac_longer"),
        F.avg(delta).alias("mean_delta"),
    )


def format_stats(pairs: DataFrame) -> DataFrame:
    """How often the preferred side is the one with confident words, or with markdown, where only one side has them."""
    forced = pairs.where(F.col("winner").isin("a", "b"))
    f = forced.select(has_confidence(chosen()).alias("cc"), has_confidence(rejected()).alias("rc"), has_markdown(chosen()).alias("cm"), has_markdown(rejected()).alias("rm"))
    n = lambda p, name: count_true(p).alias(name)
    out = f.agg(
        F.count("*").cast("long").alias("n"),
        n(F.col("cc"), "n_preferred_confidence"), n(F.col("rc"), "n_rejected_confidence"),
        n(F.col("cm"), "n_preferred_markdown"), n(F.col("rm"), "n_rejected_markdown"),
        n(F.col("cc") != F.col("rc"), "n_confidence_differs"), n(F.col("cc") & ~F.col("rc"), "n_prefer_confidence"),
        n(F.col("cm") != F.col("rm"), "n_markdown_differs"), n(F.col("cm") & ~F.col("rm"), "n_prefer_markdown"),
    )
    return out.withColumns({"frac_confidence": F.try_divide(F.col("n_prefer_confidence"), F.col("n_confidence_differs")), "frac_markdown": F.try_divide(F.col("n_prefer_markdown"), F.col("n_markdown_differs"))})


def response_duplicates(pairs: DataFrame) -> DataFrame:
    """Exact responses that occur in more than one content pair: text, n_pairs, first appearance."""
    sides = pairs.select("ord", F.lit(0).alias("side"), F.col("response_a").alias("text"), "pair_id").unionByName(pairs.select("ord", F.lit(1).alias("side"), F.col("response_b").alias("text"), "pair_id"))
    return sides.groupBy("text").agg(F.count_distinct("pair_id").cast("long").alias("n_pairs"), F.min(F.struct("ord", "side")).alias("seen")).where("n_pairs > 1")


def top_response_duplicates(pairs: DataFrame, most: int = 10) -> DataFrame:
    top = response_duplicates(pairs).orderBy(F.desc("n_pairs"), "seen").limit(most)
    return top.select(F.substring("text", 1, 80).alias("text_preview"), "n_pairs")


def quality_findings(pairs: DataFrame, n_malformed: int = 0) -> DataFrame:
    """(severity, code, n): the findings of the quality report."""
    one = winner_balance(pairs).select(*[F.col(c).alias(f"w_{c}") for c in ("n_a", "n_b", "n_forced", "balanced")])
    for name, part in (("g", agreement(pairs)), ("l", length_stats(pairs)), ("f", format_stats(pairs))):
        one = one.crossJoin(part.select(*[F.col(c).alias(f"{name}_{c}") for c in part.columns]))
    checks = pairs.agg(
        F.count("*").cast("long").alias("p_n"), F.count_distinct("clip_id").alias("p_clips"),
        count_true(F.col("response_a") == F.col("response_b")).alias("p_identical"),
        count_true(F.col("pair_id") != expected_pair_id()).alias("p_mismatch"),
    )
    twice = pairs.groupBy("judgment_id").count().agg(count_true(F.col("count") > 1).alias("d_judgments"))
    same = response_duplicates(pairs).agg(F.count("*").cast("long").alias("d_responses"))
    one = one.crossJoin(checks).crossJoin(twice).crossJoin(same)
    c = F.col
    largest = F.greatest(c("w_n_a"), c("w_n_b"))
    balance = (
        F.when((c("w_n_forced") > 0) & (F.least(c("w_n_a"), c("w_n_b")) == 0), _hit("warning", "winner_one_sided", c("w_n_forced")))
        .when((c("w_n_forced") >= 4) & (largest >= 0.75 * c("w_n_forced")), _hit("warning", "winner_imbalance", c("w_n_forced")))
        .when((c("w_n_forced") > 0) & ~c("w_balanced"), _hit("info", "winner_mild_imbalance", c("w_n_forced")))
    )
    raters = F.when(~c("g_can_estimate_reliability"), _hit("info", "irr_unavailable", c("g_n_annotators"))).when(c("g_n_contradictory") > 0, _hit("warning", "repeated_judgment_disagreement", c("g_n_contradictory")))
    hits = F.array_compact(
        F.array(
            F.when(F.lit(n_malformed > 0), _hit("error", "malformed_records", F.lit(n_malformed))),
            balance,
            F.when(c("g_n_repeated") > 0, _hit("warning", "duplicate_pair_ids", c("g_n_repeated"))),
            F.when(c("g_n_contradictory") > 0, _hit("warning", "contradictory_labels", c("g_n_contradictory"))),
            F.when(c("p_identical") > 0, _hit("error", "identical_responses_within_pair", c("p_identical"))),
            F.when(c("d_responses") > 0, _hit("warning", "exact_response_duplicates", c("d_responses"))),
            F.when(c("p_mismatch") > 0, _hit("error", "pair_id_mismatch", c("p_mismatch"))),
            F.when(c("d_judgments") > 0, _hit("error", "duplicate_judgment_ids", c("d_judgments"))),
            raters,
            F.when((c("l_n") >= 4) & (c("l_frac_longer") >= 2 / 3), _hit("possible_bias", "possible_length_bias", c("l_n_longer"))),
            F.when((c("f_n_confidence_differs") >= 3) & (c("f_frac_confidence") >= 0.75), _hit("possible_bias", "possible_confidence_format_bias", c("f_n_prefer_confidence"))),
            F.when((c("f_n_markdown_differs") >= 3) & (c("f_frac_markdown") >= 0.75), _hit("possible_bias", "possible_markdown_format_bias", c("f_n_prefer_markdown"))),
            F.when((c("p_clips") == 1) & (c("p_n") >= 4), _hit("warning", "single_clip_concentration", c("p_n"))),
        )
    )
    return one.select(F.inline(hits))


def _hit(severity: str, code: str, n: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), n.cast("long").alias("n"))


def concentration(pairs: DataFrame) -> DataFrame:
    """(kind, key, n): judgments by clip, task, annotator and winner, in one pass."""
    kinds = {"clip": "clip_id", "task": "task", "annotator": "annotator_id", "winner": "winner"}
    long = pairs.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in kinds.items()])))
    return long.groupBy("kind", "key").agg(F.count("*").cast("long").alias("n"))


def pending(queue: DataFrame, judgments: DataFrame, annotator: str | Column) -> DataFrame:
    """Queue rows that the annotator has not judged."""
    who = F.lit(annotator) if isinstance(annotator, str) else annotator
    return queue.withColumn("annotator_id", who).join(judgments.select("annotator_id", "pair_id").distinct(), ["annotator_id", "pair_id"], "left_anti")


def queue_positions(queue: DataFrame, order: str = "ord") -> DataFrame:
    """1-based index of each row and the total.

    A sketch of the order bounds as many ranges as there are shuffle partitions; rows are
    counted by range, ranked inside it and shifted by the ranges before it. Rows of
    equal order follow each other in any order, those without one come first.
    """
    n = max(1, int(queue.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = F.col(order).cast("double")
    found = queue.select(place.alias("_place")).where("_place is not null").stat.approxQuantile("_place", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    bounds = [-math.inf, *sorted({b for b in found if math.isfinite(b)} or {0.0}), math.inf]
    dealt = Bucketizer(splits=bounds, inputCol="_place", outputCol="_range", handleInvalid="keep").transform(queue.withColumn("_place", place))
    dealt = dealt.withColumn("_range", F.when(F.col("_place").isNull(), -1.0).otherwise(F.col("_range"))).drop("_place")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))  # at most n + 2 rows
    every = Window.orderBy("_range")
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_size").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("_size").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    index = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return dealt.join(F.broadcast(sizes), "_range").withColumn("index", index).select(*queue.columns, "index", "total")
