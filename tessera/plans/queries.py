"""Queries of the evaluation engine over the driver tables, each with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import aggregates, canonical, intervals, sampling, scoring, text
from tessera.operators import align, analysis, divergence, eligibility, embedding_reward, guards, preferences, reward_model, selection, validation
from tessera.plans import bindings as b
from tessera.plans import runs
from tessera.sources import files, jsonl, sinks
from tessera.streaming import judgments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: The SQL of each query without the shared views.
OWN: dict[str, str] = {}

SETTINGS = divergence.Settings(before="m0", after="m1")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            OWN[f.__name__] = sql.strip()
            ORACLE[f.__name__] = f"WITH {b.SQL.strip()}\n{sql.strip()}" if sql.lstrip()[0] != "," else f"WITH {b.SQL.strip()}{sql.strip()}"
        return f

    return keep


def _part(name: str) -> str:
    """The SQL of an earlier query as a subquery."""
    sql = OWN[name]
    return f"(WITH {sql[1:]})" if sql.startswith(",") else f"({sql})"


def _scored(s: SparkSession, d: str) -> DataFrame:
    return analysis.scored(b.predictions(b.examples(s, d)))


def _aligned(s: SparkSession, d: str, ex: DataFrame | None = None) -> DataFrame:
    ex = b.examples(s, d) if ex is None else ex
    preds = analysis.scored(b.predictions(ex))
    return align.align(align.locked(ex), b.methods(s), preds)


def _records(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ex = b.examples(s, d)
    lock = align.locked(ex)
    cells = divergence.diagnosed(align.align(lock, b.methods(s), analysis.scored(b.predictions(ex))), b.model_scores(ex), lock, SETTINGS)
    return cells, divergence.before_after(cells, SETTINGS)


# alignment and metrics


@query(
    """SELECT method_id, count(*)::BIGINT AS n_locked, count(correct)::BIGINT AS n_scored, sum(missing::INT)::BIGINT AS n_missing,
  coalesce(sum(correct::INT), 0)::BIGINT AS n_correct, avg(correct::INT) AS accuracy, coalesce(sum(parse_failed::INT), 0)::BIGINT AS n_parse_failures,
  sum(parse_failed::INT)::DOUBLE / nullif(count(correct), 0) AS parse_failure_rate, avg(reward) AS mean_reward
FROM aligned GROUP BY 1"""
)
def method_accuracy(s, d):
    return align.method_metrics(_aligned(s, d))


@query("SELECT example_id, method_id, trick_id, missing, correct, parse_failed, parsed_answer, reward FROM aligned")
def method_alignment(s, d):
    return _aligned(s, d).select("example_id", "method_id", "trick_id", "missing", "correct", "parse_failed", "parsed_answer", "reward")


@query("SELECT method_id, count(*)::BIGINT AS n_locked, sum((NOT missing)::INT)::BIGINT AS n_present, sum(missing::INT)::BIGINT AS n_missing, sum(missing::INT) = 0 AS full_coverage FROM aligned GROUP BY 1")
def coverage(s, d):
    return align.coverage(_aligned(s, d)).drop("first_missing")


@query("SELECT method_id, example_id FROM aligned WHERE missing")
def coverage_missing(s, d):
    return align.missing_ids(_aligned(s, d))


@query("SELECT method_id, example_id FROM pred WHERE example_id NOT IN (SELECT example_id FROM lock_set)")
def coverage_extra(s, d):
    ex = b.examples(s, d)
    return align.extra_ids(align.locked(ex), b.predictions(ex))


@query(
    """, m AS (SELECT method_id, avg(correct::INT) AS accuracy, avg(reward) AS mean_reward FROM aligned GROUP BY 1)
SELECT a.method_id, a.accuracy - r.accuracy AS accuracy_delta, a.mean_reward - r.mean_reward AS mean_reward_delta FROM m a, m r WHERE r.method_id = 'm0' AND a.method_id <> 'm0'"""
)
def method_deltas(s, d):
    return align.deltas(align.method_metrics(_aligned(s, d)), "m0")


@query(
    """, u AS (
  SELECT method_id, unnest([{'identity': 'trick_id', 'key': coalesce(nullif(trick_id, ''), 'unknown')}, {'identity': 'performer_id', 'key': coalesce(nullif(performer_id, ''), 'unknown')},
    {'identity': 'camera_id', 'key': coalesce(nullif(camera_id, ''), 'unknown')}, {'identity': 'prop_id', 'key': coalesce(nullif(prop_id, ''), 'unknown')},
    {'identity': 'question_variant', 'key': coalesce(nullif(question_variant, ''), 'unknown')}]) AS i, correct, parse_failed
  FROM aligned WHERE NOT missing AND correct IS NOT NULL)
SELECT method_id, i.identity AS identity, i.key AS key, count(*)::BIGINT AS n, sum(correct::INT)::BIGINT AS n_correct, avg(correct::INT) AS accuracy, sum(parse_failed::INT)::BIGINT AS n_parse_failures FROM u GROUP BY 1, 2, 3"""
)
def per_identity_grouping_sets(s, d):
    return align.identity_metrics(_aligned(s, d))


@query("SELECT trick_id AS key, count(*)::BIGINT AS n, sum(correct::INT)::BIGINT AS n_correct, avg(correct::INT) AS accuracy, sum(parse_failed::INT)::BIGINT AS n_parse_failures FROM scored WHERE method_id = 'm0' GROUP BY 1")
def per_trick_stats(s, d):
    return align.group_stats(_scored(s, d).where("method_id = 'm0'"), "trick_id")


@query(
    """SELECT 'overall' AS split, count(*)::BIGINT AS n, avg(correct::INT) AS accuracy FROM scored WHERE method_id = 'm0'
UNION ALL SELECT split, count(*)::BIGINT, avg(correct::INT) FROM scored WHERE method_id = 'm0' GROUP BY 1"""
)
def accuracy_by_split(s, d):
    return analysis.accuracy_by_split(_scored(s, d).where("method_id = 'm0'"))


@query(
    """SELECT count(*)::BIGINT AS n_examples, sum(correct::INT)::BIGINT AS n_correct, avg(correct::INT) AS overall_accuracy, sum(parse_failed::INT)::BIGINT AS n_parse_failures,
  avg(parse_failed::INT) AS parse_failure_rate, round(avg(latency_s), 9) AS mean_latency_s FROM scored WHERE method_id = 'm0'"""
)
def run_summary(s, d):
    return analysis.run_summary(_scored(s, d).where("method_id = 'm0'")).withColumn("mean_latency_s", F.round("mean_latency_s", 9))


@query("SELECT count(*)::BIGINT AS n, coalesce(avg(correct::INT), 0.0) AS accuracy FROM scored WHERE method_id = 'm9'")
def score_summary_empty(s, d):
    return analysis.score_summary(_scored(s, d).where("method_id = 'm9'"))


@query("SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS sum_groups, true AS groups_match, true AS counts_match FROM scored WHERE method_id = 'm0'")
def integrity_checks(s, d):
    return analysis.integrity(_scored(s, d).where("method_id = 'm0'"))


@query(
    """, v AS (SELECT unnest([{'axis': 'trick_id', 'value': trick_id}, {'axis': 'performer_id', 'value': performer_id}, {'axis': 'camera_id', 'value': camera_id},
  {'axis': 'prop_id', 'value': prop_id}, {'axis': 'question_variant', 'value': question_variant}, {'axis': 'clip_id', 'value': clip_id}]) AS i FROM ex WHERE split <> 'held_out')
SELECT DISTINCT i.axis AS axis, i.value AS value FROM v WHERE i.value IS NOT NULL"""
)
def seen_sets(s, d):
    return align.seen_values(b.examples(s, d))


_AXES = """, flags AS (
  SELECT e.*, trick_id NOT IN (SELECT trick_id FROM ex WHERE split <> 'held_out') AS unseen_trick,
    performer_id NOT IN (SELECT performer_id FROM ex WHERE split <> 'held_out') AS unseen_performer,
    camera_id NOT IN (SELECT camera_id FROM ex WHERE split <> 'held_out') AS unseen_camera,
    prop_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ex t WHERE t.split <> 'held_out' AND t.prop_id = e.prop_id) AS unseen_prop,
    question_variant IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ex t WHERE t.split <> 'held_out' AND t.question_variant = e.question_variant) AS unseen_wording
  FROM lock_set e)"""


@query(
    """SELECT method_id, ord % 5 AS kind, count(*)::BIGINT AS n, count_if(failed)::BIGINT AS n_failed, count(ok)::BIGINT AS n_scored, count_if(ok)::BIGINT AS n_correct, avg(ok::INT) AS mean_reward
FROM (SELECT *, CASE ord % 5 WHEN 0 THEN num % 2 = 0 WHEN 1 THEN num % 3 = 0 WHEN 2 THEN CASE WHEN ground_truth IS NOT NULL THEN num % 7 <> 0 AND parsed_answer IS NOT NULL AND parsed_answer = ground_truth END
    WHEN 3 THEN CASE WHEN ground_truth IS NOT NULL THEN parsed_answer IS NOT NULL AND parsed_answer = ground_truth END ELSE false END AS ok,
  CASE WHEN ord % 5 = 2 THEN num % 7 = 0 ELSE parsed_answer IS NULL END AS failed FROM (SELECT *, ord // 5 AS num FROM pred)) GROUP BY 1, 2"""
)
def mixed_key_presence(s, d):
    """Rows of one source that have different keys: correct; matched; parse_failed; none of them; a null correct."""
    kind, num = F.col("ord") % 5, F.floor(F.col("ord") / 5)
    keys = F.when(kind == 0, F.array(F.lit("correct"), F.lit("matched"))).when(kind == 1, F.array(F.lit("matched"))).when(kind == 2, F.array(F.lit("parse_failed"))).when(kind == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("correct")))
    stored = {"_keys": keys, "correct": F.when(kind == 0, num % 2 == 0), "matched": F.when(kind == 0, num % 2 != 0).when(kind == 1, num % 3 == 0), "parse_failed": F.when(kind == 2, num % 7 == 0)}
    out = align.normalized_predictions(b.predictions(b.examples(s, d)).withColumns(stored))
    out = out.groupBy("method_id", kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if("parse_failed").alias("n_failed"), F.count("correct").alias("n_scored"), F.count_if("correct").alias("n_correct"), F.avg("reward").alias("mean_reward"))
    return out


@query(_AXES + " SELECT example_id, unseen_trick, unseen_performer, unseen_camera, unseen_prop, unseen_wording, NOT unseen_trick AND unseen_wording AS known_trick_variation, prop_id IS NOT NULL AS has_prop_id, question_variant IS NOT NULL AS has_question_variant FROM flags")
def axis_flags(s, d):
    ex = b.examples(s, d)
    out = align.axis_flags(align.locked(ex), align.seen_values(ex))
    return out.select("example_id", *align.SLICES[:-1], "has_prop_id", "has_question_variant")


@query(
    _AXES
    + """, s AS (SELECT a.method_id, a.correct, unnest(list_filter([CASE WHEN f.unseen_trick THEN 'unseen_trick' END, CASE WHEN f.unseen_performer THEN 'unseen_performer' END,
  CASE WHEN f.unseen_camera THEN 'unseen_camera' END, CASE WHEN f.unseen_prop THEN 'unseen_prop' END, CASE WHEN f.unseen_wording THEN 'unseen_wording' END,
  CASE WHEN NOT f.unseen_trick AND f.unseen_wording THEN 'known_trick_variation' END, 'all_locked'], lambda x: x IS NOT NULL)) AS slice
  FROM aligned a JOIN flags f USING (example_id) WHERE NOT a.missing AND a.correct IS NOT NULL)
SELECT slice, method_id, count(*)::BIGINT AS n, sum(correct::INT)::BIGINT AS n_correct, avg(correct::INT) AS accuracy FROM s GROUP BY 1, 2"""
)
def slice_accuracy(s, d):
    ex = b.examples(s, d)
    lock = align.axis_flags(align.locked(ex), align.seen_values(ex))
    return align.slice_accuracy(align.align(lock, b.methods(s), analysis.scored(b.predictions(ex))))


# analysis


@query("SELECT 'gold' AS side, coalesce(ground_truth, '<missing>') AS label, count(*)::BIGINT AS n FROM scored WHERE method_id = 'm0' GROUP BY 2 UNION ALL SELECT 'predicted', coalesce(parsed_answer, '<unparsed>'), count(*)::BIGINT FROM scored WHERE method_id = 'm0' GROUP BY 2")
def answer_distribution(s, d):
    return analysis.label_counts(_scored(s, d).where("method_id = 'm0'")).drop("seen")


@query(
    """, c AS (SELECT coalesce(ground_truth, '<missing>') AS l, count(*) AS n FROM scored WHERE method_id = 'm0' GROUP BY 1), t AS (SELECT sum(n) AS t FROM c)
SELECT 'gold' AS side, round(-sum(n / t * log2(n / t)), 9) AS entropy_bits FROM c, t"""
)
def label_entropy(s, d):
    counts = analysis.label_counts(_scored(s, d).where("method_id = 'm0'"))
    return analysis.label_entropy(counts, "gold").withColumn("entropy_bits", F.round("entropy_bits", 9))


_MAJORITY = """, g AS (SELECT ground_truth AS label, count(*) AS n, min(ord) AS seen FROM scored WHERE method_id = 'm0' AND ground_truth IS NOT NULL GROUP BY 1),
maj AS (SELECT label, n FROM g ORDER BY n DESC, seen LIMIT 1)"""


@query(_MAJORITY + " SELECT label, n::BIGINT AS n FROM maj")
def majority_label(s, d):
    return analysis.majority_gold(_scored(s, d).where("method_id = 'm0'"))


@query(
    _MAJORITY
    + """, p AS (SELECT coalesce(parsed_answer, '<unparsed>') AS l, count(*) AS n, min(ord) AS seen FROM scored WHERE method_id = 'm0' GROUP BY 1), pm AS (SELECT l, n FROM p ORDER BY n DESC, seen LIMIT 1),
t AS (SELECT count(*) AS t FROM scored WHERE method_id = 'm0')
SELECT maj.label AS majority_label, maj.n::BIGINT AS majority_count, maj.n / t.t AS majority_fraction, maj.n / t.t AS majority_baseline_accuracy, pm.l AS predicted_mode, pm.n / t.t AS predicted_mode_fraction FROM maj, pm, t"""
)
def distribution_summary(s, d):
    return analysis.distribution_summary(_scored(s, d).where("method_id = 'm0'"))


def _tagged(s: SparkSession, d: str) -> DataFrame:
    rows = _scored(s, d).where("method_id = 'm0'")
    majority = analysis.majority_gold(rows).agg(F.first("label").alias("majority"))
    mode = F.when(F.col("ord") % 3 == 0, "indices_only_no_pixels").when(F.col("ord") % 3 == 1, "external_pixels").otherwise("")
    note = F.when(F.col("ord") % 11 == 0, "label is Unclear")
    error = F.when(F.col("ord") % 37 == 0, "timeout")
    tags = analysis.diagnostic_tags(F.col("correct"), F.col("parse_failed"), F.col("raw_text"), F.col("parsed_answer"), error, mode, F.col("majority"), note)
    return rows.crossJoin(F.broadcast(majority)).select("example_id", tags.alias("tags"))


_TAGS = (
    _MAJORITY
    + """, tagged AS (SELECT example_id, CASE WHEN correct THEN ['correct'] ELSE list_filter([CASE WHEN ord % 37 = 0 THEN 'inference_error' END,
  CASE WHEN parse_failed THEN 'parse_failure' ELSE 'wrong_label' END, CASE ord % 3 WHEN 0 THEN 'visual_input_missing' WHEN 1 THEN 'incorrect_with_pixels_present' END,
  CASE WHEN parsed_answer = (SELECT label FROM maj) THEN 'possible_answer_frequency_shortcut' END, CASE WHEN ord % 11 = 0 THEN 'ambiguity_or_task_design_note' END], lambda x: x IS NOT NULL) END AS tags
  FROM scored WHERE method_id = 'm0')"""
)


@query(_TAGS + " SELECT example_id, array_to_string(tags, ',') AS tags FROM tagged")
def diagnostic_tags(s, d):
    return _tagged(s, d).withColumn("tags", F.array_join("tags", ","))


@query(_TAGS + ", u AS (SELECT unnest(tags) AS tag FROM tagged) SELECT tag, count(*)::BIGINT AS n FROM u GROUP BY 1")
def tag_counts(s, d):
    return analysis.tag_counts(_tagged(s, d))


@query("SELECT array_to_string(list_sort(list(DISTINCT clip_id)), ',') AS clip_ids, array_to_string(list_sort(list(DISTINCT trick_id)), ',') AS trick_ids FROM lock_set")
def split_lock(s, d):
    return analysis.split_lock(align.locked(b.examples(s, d))).select(F.array_join("clip_ids", ",").alias("clip_ids"), F.array_join("trick_ids", ",").alias("trick_ids"))


@query(
    """, p AS (SELECT a.example_id, a.correct AS o, b.correct AS s FROM scored a JOIN scored b USING (example_id) WHERE a.method_id = 'm0' AND b.method_id = 'm1')
SELECT count(*)::BIGINT AS n_pairs, avg(o::INT) AS ordered_accuracy, avg(s::INT) AS shuffled_accuracy, sum((o AND s)::INT)::BIGINT AS n_both_correct, sum((NOT o AND NOT s)::INT)::BIGINT AS n_both_incorrect,
  sum((o AND NOT s)::INT)::BIGINT AS n_ordered_only, sum((NOT o AND s)::INT)::BIGINT AS n_shuffled_only, avg(o::INT) - avg(s::INT) AS accuracy_difference FROM p"""
)
def paired_shuffle_summary(s, d):
    rows = _scored(s, d).withColumn("frame_indices", F.array(F.lit(0), F.lit(1)))
    return analysis.pair_summary(analysis.temporal_pairs(rows.where("method_id = 'm0'"), rows.where("method_id = 'm1'")))


@query("SELECT count(*)::BIGINT AS n_rollouts, avg(correct::INT) AS mean_reward, sum(correct::INT)::BIGINT AS n_reward_one, sum((NOT correct)::INT)::BIGINT AS n_reward_zero, sum(parse_failed::INT)::BIGINT AS n_parse_failed FROM scored")
def rollout_reward_stats(s, d):
    return analysis.reward_stats(_scored(s, d).withColumn("reward", F.col("correct").cast("int").cast("double")))


# validation


def _flat(found: DataFrame) -> DataFrame:
    return found.select("severity", "code", "subject", F.array_join("example_ids", ",").alias("example_ids"), F.array_join("clip_ids", ",").alias("clip_ids"))


@query("SELECT 'error' AS severity, 'duplicate_example_id' AS code, example_id AS subject, example_id AS example_ids, '' AS clip_ids FROM (SELECT * FROM ex UNION ALL SELECT * FROM ex WHERE ord % 50 = 0) GROUP BY example_id HAVING count(*) > 1")
def duplicate_ids(s, d):
    ex = b.examples(s, d)
    return _flat(validation.duplicate_ids(ex.union(ex.where("ord % 50 = 0"))))


@query(
    """, g AS (SELECT *, CASE ord % 9 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN 'good ' WHEN 3 THEN 'other' ELSE ground_truth END AS gt FROM ex WHERE task = 'hidden_state'),
c AS (SELECT *, CASE WHEN gt IS NULL OR gt = '' THEN 'missing_ground_truth' WHEN trim(gt) = '' THEN 'invalid_ground_truth_whitespace' WHEN gt NOT IN ('good', 'bad', 'good ') THEN 'invalid_answer_not_in_vocab'
  WHEN gt <> trim(gt) THEN 'ground_truth_peripheral_whitespace' END AS code FROM g)
SELECT CASE code WHEN 'ground_truth_peripheral_whitespace' THEN 'review' ELSE 'error' END AS severity, code, example_id AS subject, example_id AS example_ids, clip_id AS clip_ids FROM c WHERE code IS NOT NULL"""
)
def ground_truth_findings(s, d):
    k = F.col("ord") % 9
    gold = F.when(k == 0, "").when(k == 1, "  ").when(k == 2, "good ").when(k == 3, "other").otherwise(F.col("ground_truth"))
    return _flat(validation.ground_truth(b.examples(s, d).withColumn("ground_truth", gold), ("good", "bad", "good ")))


@query(
    """, g AS (SELECT clip_id, count(DISTINCT trick_id) > 1 OR count(DISTINCT performer_id) > 1 OR count(DISTINCT camera_id) > 1 AS meta, count(DISTINCT video_path) > 1 OR count(DISTINCT split) > 1 AS path,
  count(DISTINCT CASE WHEN task = 'hidden_state' THEN ground_truth END) > 1 AS gold, array_to_string(list_sort(list(DISTINCT example_id)), ',') AS ids FROM ex GROUP BY 1)
SELECT 'error' AS severity, 'inconsistent_clip_metadata' AS code, clip_id AS subject, ids AS example_ids, clip_id AS clip_ids FROM g WHERE meta
UNION ALL SELECT 'error', 'inconsistent_clip_path_or_split', clip_id, ids, clip_id FROM g WHERE path
UNION ALL SELECT 'error', 'inconsistent_clip_ground_truth', clip_id, ids, clip_id FROM g WHERE gold"""
)
def clip_consistency(s, d):
    return _flat(validation.clip_consistency(b.examples(s, d)))


@query(
    """SELECT 'error' AS severity, 'duplicate_video_path' AS code, p AS subject, array_to_string(list_sort(list(DISTINCT example_id)), ',') AS example_ids, array_to_string(list_sort(list(DISTINCT clip_id)), ',') AS clip_ids
FROM (SELECT *, concat('v/', CAST(ord % 100 AS VARCHAR)) AS p FROM ex) GROUP BY p HAVING count(DISTINCT clip_id) > 1"""
)
def duplicate_video_path(s, d):
    return _flat(validation.duplicate_video_path(b.examples(s, d).withColumn("video_path", F.concat(F.lit("v/"), (F.col("ord") % 100).cast("string")))))


@query("SELECT 'review' AS severity, 'near_duplicate_content_hash' AS code, content_hash AS subject, array_to_string(list_sort(list(DISTINCT example_id)), ',') AS example_ids, array_to_string(list_sort(list(DISTINCT clip_id)), ',') AS clip_ids FROM ex GROUP BY content_hash HAVING count(DISTINCT clip_id) > 1")
def duplicate_content_hash(s, d):
    return _flat(validation.shared_content_hash(b.examples(s, d)))


def _questions(source: str) -> str:
    return f"""(WITH q AS (SELECT *, regexp_replace(lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))), '\\s+', ' ', 'g') AS k FROM {source})
SELECT 'review' AS severity, 'duplicate_question_phrasing' AS code, clip_id AS subject, array_to_string(list_sort(list(DISTINCT example_id)), ',') AS example_ids, clip_id AS clip_ids FROM q GROUP BY clip_id, k HAVING count(*) > 1)"""


@query("SELECT * FROM " + _questions("(SELECT * REPLACE (performer_id AS clip_id) FROM ex)"))
def duplicate_questions(s, d):
    """Whole questions, within each performer."""
    return _flat(validation.duplicate_questions(b.examples(s, d).withColumn("clip_id", F.col("performer_id"))))


@query("SELECT 'review' AS severity, 'repeated_trick_performer_combo' AS code, concat(trick_id, '|', performer_id) AS subject, '' AS example_ids, array_to_string(list_sort(list(DISTINCT clip_id)), ',') AS clip_ids FROM ex GROUP BY trick_id, performer_id HAVING count(DISTINCT clip_id) >= 4")
def repeated_combo(s, d):
    return _flat(validation.dense_combos(b.examples(s, d)))


@query(
    """, f AS (SELECT *, CASE WHEN ord % 19 = 0 THEN 500.0::DOUBLE ELSE fps END AS r FROM ex)
SELECT 'review' AS severity, 'missing_fps' AS code, example_id AS subject, example_id AS example_ids, clip_id AS clip_ids FROM f WHERE r IS NULL
UNION ALL SELECT 'error', 'unexpected_fps', example_id, example_id, clip_id FROM f WHERE r < 1 OR r > 120
UNION ALL SELECT 'review', 'fps_deviates_from_expected', example_id, example_id, clip_id FROM f WHERE abs(r - 27) > 0.51
UNION ALL SELECT 'review', 'fps_duration_inconsistency', example_id, example_id, clip_id FROM f WHERE r <> 0 AND num_frames <> 0 AND duration_s > 0 AND abs(num_frames / r - duration_s) / duration_s > 0.35"""
)
def fps_findings(s, d):
    ex = b.examples(s, d)
    return _flat(validation.fps_and_spans(ex.withColumn("fps", F.when(F.col("ord") % 19 == 0, 500.0).otherwise(F.col("fps"))), 27.0))


_OVERLAPS = """, s AS (SELECT attribute, value, list(DISTINCT split) AS l FROM (SELECT split, unnest([{'attribute': 'clip_id', 'value': clip_id}, {'attribute': 'video_path', 'value': video_path},
  {'attribute': 'trick_id', 'value': trick_id}, {'attribute': 'performer_id', 'value': performer_id}], recursive := true) FROM ex) GROUP BY 1, 2),
o AS (SELECT 'leakage' AS severity, concat('leakage_', attribute) AS code, value FROM s WHERE list_contains(l, 'held_out') AND len(l) > 1
  UNION ALL SELECT 'review', concat('train_val_', replace(attribute, '_id', ''), '_overlap'), value FROM s WHERE attribute <> 'video_path' AND list_contains(l, 'train') AND list_contains(l, 'val'))"""


@query(_OVERLAPS + " SELECT severity, code, value FROM o WHERE severity = 'leakage'")
def leakage_overlaps(s, d):
    return validation.overlaps(b.examples(s, d)).where("severity = 'leakage'")


@query(_OVERLAPS + " SELECT severity, code, value FROM o WHERE severity = 'review'")
def train_val_overlaps(s, d):
    return validation.overlaps(b.examples(s, d)).where("severity = 'review'")


@query(_OVERLAPS + " SELECT severity, code, array_to_string(list_sort(list(value)), ',') AS subject FROM o GROUP BY 1, 2")
def split_leakage_findings(s, d):
    return validation.split_leakage(b.examples(s, d)).select("severity", "code", "subject")


@query(
    """, r AS (SELECT ord, example_id, clip_id, row_number() OVER (PARTITION BY example_id ORDER BY ord) > 1 AS again, first_value(k) OVER (PARTITION BY clip_id ORDER BY ord) <> k AS path
  FROM (SELECT *, CASE WHEN ord % 400 = 399 THEN 'moved' ELSE video_path END AS k FROM ex))
SELECT 'manifest_integrity' AS code, CASE WHEN again THEN example_id ELSE clip_id END AS subject FROM r WHERE again OR path ORDER BY ord LIMIT 1"""
)
def first_violation(s, d):
    ex = b.examples(s, d)
    moved = ex.withColumn("video_path", F.when(F.col("ord") % 400 == 399, "moved").otherwise(F.col("video_path")))
    return validation.first_violation(moved).select("code", "subject")


@query(
    """, f AS (SELECT 'error' AS severity, 'inconsistent_clip_ground_truth' AS code, clip_id AS subject FROM ex WHERE task = 'hidden_state' GROUP BY clip_id HAVING count(DISTINCT ground_truth) > 1
  UNION ALL SELECT 'review', 'missing_fps', example_id FROM ex WHERE fps IS NULL)
SELECT severity, code, subject FROM f ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'leakage' THEN 1 ELSE 2 END, code, subject"""
)
def findings_sorted(s, d):
    ex = b.examples(s, d)
    found = validation.clip_consistency(ex).where("code = 'inconsistent_clip_ground_truth'").unionByName(validation.fps_and_spans(ex).where("code = 'missing_fps'"))
    return validation.ordered(found).select("severity", "code", "subject")


@query(
    """, m AS (SELECT video_path, min_by(example_id, ord) AS e, min_by(clip_id, ord) AS c FROM ex GROUP BY 1), f AS (SELECT *, CAST(substr(c, 6) AS INT) AS k FROM m)
SELECT 'error' AS severity, CASE WHEN k % 5 = 0 THEN 'missing_video' ELSE 'unreadable_video_empty' END AS code, video_path AS subject, e AS example_ids, c AS clip_ids FROM f WHERE k % 5 IN (0, 1)"""
)
def media_findings(s, d):
    ex = b.examples(s, d)
    k = F.substring("clip_id", 6, 10).cast("int")
    files = ex.select(F.col("video_path").alias("path"), k.alias("k")).distinct().where("k % 5 <> 0").select("path", F.when(F.col("k") % 5 == 1, 0).otherwise(100).alias("length"))
    return _flat(validation.media(ex, files))


_INTEGRITY = """r AS (SELECT ord, example_id, clip_id, row_number() OVER (PARTITION BY example_id ORDER BY ord) > 1 AS again,
  first_value(video_path) OVER w IS DISTINCT FROM video_path OR first_value(split) OVER w IS DISTINCT FROM split AS moved FROM ex WINDOW w AS (PARTITION BY clip_id ORDER BY ord)),
first_bad AS (SELECT * FROM r WHERE again OR moved ORDER BY ord LIMIT 1)"""
_IDS = "array_to_string(list_sort(list(DISTINCT example_id)), ',') AS example_ids, array_to_string(list_sort(list(DISTINCT clip_id)), ',') AS clip_ids"


def _all_findings(expected_fps: float | None) -> str:
    """All findings of ``ex`` as the CTE ``found``."""
    fps = f"UNION ALL SELECT 'review', 'fps_deviates_from_expected', example_id, example_id, clip_id FROM ex WHERE abs(fps - {expected_fps}) > 0.51" if expected_fps else ""
    return f""", {_INTEGRITY}, found AS (
SELECT 'error' AS severity, 'manifest_integrity' AS code, CASE WHEN again THEN example_id ELSE clip_id END AS subject, '' AS example_ids, '' AS clip_ids FROM first_bad
UNION ALL SELECT 'error', 'duplicate_example_id', example_id, example_id, '' FROM ex GROUP BY example_id HAVING count(*) > 1
UNION ALL SELECT CASE WHEN trim(ground_truth) <> '' THEN 'review' ELSE 'error' END, CASE WHEN ground_truth IS NULL OR ground_truth = '' THEN 'missing_ground_truth' WHEN trim(ground_truth) = '' THEN 'invalid_ground_truth_whitespace'
  ELSE 'ground_truth_peripheral_whitespace' END, example_id, example_id, clip_id FROM ex WHERE task = 'hidden_state' AND (ground_truth IS NULL OR ground_truth = '' OR ground_truth <> trim(ground_truth))
UNION ALL {_part('clip_consistency')}
UNION ALL SELECT 'error', 'duplicate_video_path', video_path, {_IDS} FROM ex GROUP BY video_path HAVING count(DISTINCT clip_id) > 1
UNION ALL SELECT 'review', 'missing_fps', example_id, example_id, clip_id FROM ex WHERE fps IS NULL
UNION ALL SELECT 'error', 'unexpected_fps', example_id, example_id, clip_id FROM ex WHERE fps < 1 OR fps > 120
UNION ALL SELECT 'review', 'fps_duration_inconsistency', example_id, example_id, clip_id FROM ex WHERE fps <> 0 AND num_frames <> 0 AND duration_s > 0 AND abs(num_frames / fps - duration_s) / duration_s > 0.35
{fps}
UNION ALL SELECT severity, code, subject, '', '' FROM {_part('split_leakage_findings')}
UNION ALL SELECT 'review', CASE held WHEN 0 THEN 'no_held_out_split' ELSE 'only_held_out_present' END, 'split', '', '' FROM (SELECT count_if(split = 'held_out') AS held, count(*) AS n FROM ex) WHERE n > 0 AND held IN (0, n)
UNION ALL {_part('duplicate_content_hash')}
UNION ALL {_questions('ex')}
UNION ALL {_part('repeated_combo')})"""


@query(_all_findings(27.0) + " SELECT * FROM found")
def validation_findings(s, d):
    return _flat(validation.findings(b.examples(s, d), validation.Options(expected_fps=27.0)))


@query(
    _all_findings(None)
    + """ SELECT (SELECT count(*) FROM ex)::BIGINT AS n_records, (SELECT count(DISTINCT clip_id) FROM ex)::BIGINT AS n_clips, count_if(severity = 'error')::BIGINT AS n_error,
  count_if(severity = 'leakage')::BIGINT AS n_leakage, count_if(severity = 'review')::BIGINT AS n_review, count_if(severity IN ('error', 'leakage')) = 0 AS passed FROM found"""
)
def validation_report(s, d):
    ex = b.examples(s, d)
    return validation.report(ex, validation.findings(ex))


# preferences


@query(
    """, c AS (SELECT count_if(winner = 'a')::BIGINT AS n_a, count_if(winner = 'b')::BIGINT AS n_b, count_if(winner = 'tie')::BIGINT AS n_tie FROM pref)
SELECT n_a, n_b, n_tie, n_a + n_b AS n_forced, n_a / (n_a + n_b) AS frac_a, n_b / (n_a + n_b) AS frac_b, abs(n_a - n_b) AS abs_imbalance, abs(n_a - n_b) <= greatest(1, ceil(0.1 * (n_a + n_b))) AS balanced FROM c"""
)
def winner_balance(s, d):
    return preferences.winner_balance(b.preferences(s, d))


@query(
    """, g AS (SELECT pair_id, count(*) AS n, count(DISTINCT winner) AS w FROM pref GROUP BY 1),
c AS (SELECT count(*)::BIGINT AS n_unique_pairs, count_if(n > 1)::BIGINT AS n_repeated, count_if(n > 1 AND w = 1)::BIGINT AS n_unanimous, count_if(n > 1 AND w > 1)::BIGINT AS n_contradictory FROM g),
p AS (SELECT count(DISTINCT annotator_id)::BIGINT AS n_annotators FROM pref)
SELECT n_annotators, n_unique_pairs, n_repeated, n_unanimous, n_contradictory, n_unanimous / nullif(n_repeated, 0) AS agreement_rate, n_annotators >= 2 AND n_repeated >= 1 AS can_estimate_reliability FROM p, c"""
)
def annotator_agreement(s, d):
    return preferences.agreement(b.preferences(s, d))


@query(
    """SELECT count(*)::BIGINT AS n, round(avg(length(response_a)), 6) AS mean_chars_a, round(avg(length(response_b)), 6) AS mean_chars_b, round(avg(length(chosen)), 6) AS mean_chars_preferred, round(avg(length(rejected)), 6) AS mean_chars_rejected,
  count_if(length(chosen) > length(rejected))::BIGINT AS n_longer, count_if(length(chosen) < length(rejected))::BIGINT AS n_shorter, count_if(length(chosen) = length(rejected))::BIGINT AS n_equal,
  round(avg((length(chosen) > length(rejected))::INT), 6) AS frac_longer, round(avg(length(chosen) - length(rejected)), 6) AS mean_delta FROM forced"""
)
def length_bias(s, d):
    out = preferences.length_stats(b.preferences(s, d))
    return out.select(*[F.round(c, 6).alias(c) if c.startswith(("mean", "frac")) else F.col(c) for c in out.columns])


_STYLE = """(contains(lower({0}), 'certainly') OR contains(lower({0}), 'definitely') OR contains(lower({0}), 'obviously') OR contains(lower({0}), 'clearly') OR contains(lower({0}), 'without a doubt') OR contains(lower({0}), 'i am sure') OR contains(lower({0}), 'i''m sure') OR contains(lower({0}), 'confidence alone'))"""
_MARKDOWN = r"""(regexp_matches({0}, '(?m)^\s{{0,3}}#{{1,6}}\s') OR regexp_matches({0}, '(?m)^\s*[-*+]\s+\S') OR regexp_matches({0}, '(?m)^\s*\d+\.\s+\S') OR regexp_matches({0}, '\*\*[^*]+\*\*') OR contains({0}, '```'))"""


@query(
    f""", f AS (SELECT {_STYLE.format('chosen')} AS cc, {_STYLE.format('rejected')} AS rc, {_MARKDOWN.format('chosen')} AS cm, {_MARKDOWN.format('rejected')} AS rm FROM forced)
SELECT count(*)::BIGINT AS n, count_if(cc)::BIGINT AS n_preferred_confidence, count_if(rc)::BIGINT AS n_rejected_confidence, count_if(cm)::BIGINT AS n_preferred_markdown, count_if(rm)::BIGINT AS n_rejected_markdown,
  count_if(cc <> rc)::BIGINT AS n_confidence_differs, count_if(cc AND NOT rc)::BIGINT AS n_prefer_confidence, count_if(cm <> rm)::BIGINT AS n_markdown_differs, count_if(cm AND NOT rm)::BIGINT AS n_prefer_markdown,
  count_if(cc AND NOT rc) / nullif(count_if(cc <> rc), 0) AS frac_confidence, count_if(cm AND NOT rm) / nullif(count_if(cm <> rm), 0) AS frac_markdown FROM f"""
)
def format_bias(s, d):
    return preferences.format_stats(b.preferences(s, d))


@query(f"SELECT doc_id, {_MARKDOWN.format('text')} AS markdown, {_STYLE.format('text')} AS confident FROM documents")
def markdown_flags(s, d):
    docs = b.table(s, d, "documents")
    return docs.select("doc_id", text.has_markdown(F.col("text")).alias("markdown"), text.has_confidence(F.col("text")).alias("confident"))


@query(
    """, t AS (SELECT response_a AS text, pair_id FROM pref UNION ALL SELECT response_b, pair_id FROM pref)
SELECT text, count(DISTINCT pair_id)::BIGINT AS n_pairs FROM t GROUP BY 1 HAVING count(DISTINCT pair_id) > 1"""
)
def response_duplicates(s, d):
    return preferences.response_duplicates(b.preferences(s, d)).drop("seen")


@query(
    """, t AS (SELECT ord, 0 AS side, response_a AS text, pair_id FROM pref UNION ALL SELECT ord, 1, response_b, pair_id FROM pref),
g AS (SELECT text, count(DISTINCT pair_id)::BIGINT AS n_pairs, min(ord * 2 + side) AS seen FROM t GROUP BY 1 HAVING count(DISTINCT pair_id) > 1)
SELECT substr(text, 1, 80) AS text_preview, n_pairs FROM g ORDER BY n_pairs DESC, seen LIMIT 10"""
)
def top_response_duplicates(s, d):
    return preferences.top_response_duplicates(b.preferences(s, d))


@query("SELECT judgment_id, pair_id, clip_id, example_id, instruction, chosen, rejected, task, split FROM forced")
def dpo_rows(s, d):
    return preferences.dpo_rows(b.preferences(s, d))


@query("SELECT instruction AS prompt, chosen, rejected, split FROM forced WHERE split <> 'held_out'")
def trainer_rows(s, d):
    return preferences.trainer_rows(b.preferences(s, d).where("split <> 'held_out'"))


@query("SELECT judgment_id, pair_id, clip_id, instruction, response_a, response_b, CASE winner WHEN 'a' THEN 1 WHEN 'b' THEN -1 ELSE 0 END AS label, winner, annotator_id, split FROM pref")
def bt_rows(s, d):
    return preferences.comparison_rows(b.preferences(s, d))


_JSON = """'"' || replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') || '"'"""
_ASCII = """array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN c = '' THEN '' WHEN ord(c) < 128 THEN c WHEN ord(c) < 65536 THEN chr(92) || 'u' || format('{{:04x}}', ord(c))
  ELSE chr(92) || 'u' || format('{{:04x}}', 55296 + (ord(c) - 65536) // 1024) || chr(92) || 'u' || format('{{:04x}}', 56320 + (ord(c) - 65536) % 1024) END), '')"""


@query(
    f""", j AS (SELECT judgment_id, '{{"clip_id":"' || clip_id || '","instruction":"' || instruction || '","response_a":' || {_ASCII.format(_JSON.format('response_a'))}
  || ',"response_b":' || {_ASCII.format(_JSON.format('response_b'))} || ',"task":"' || task || '"}}' AS body FROM pref)
SELECT judgment_id, concat('pref_', substr(sha256(body), 1, 24)) AS pair_id FROM j"""
)
def pair_ids(s, d):
    return b.preferences(s, d).select("judgment_id", preferences.expected_pair_id().alias("pair_id"))


@query(
    """, k AS (SELECT *, concat('judg_', CAST(ord % 900 AS VARCHAR)) AS jid FROM pref),
f AS (SELECT 'error' AS severity, 'duplicate_judgment_id' AS code, count(*) - count(DISTINCT jid) AS n FROM k
  UNION ALL SELECT 'error', 'tie_not_allowed', count_if(winner = 'tie') FROM k UNION ALL SELECT 'error', 'identical_responses', count_if(response_a = response_b) FROM k
  UNION ALL SELECT 'review', 'held_out_preference', count_if(split = 'held_out') FROM k UNION ALL SELECT 'review', 'pair_id_mismatch', count(*) FROM k
  UNION ALL SELECT 'review', 'multiple_annotations', count(*) FROM (SELECT pair_id FROM k GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'review', 'annotator_disagreement', count(*) FROM (SELECT pair_id FROM k GROUP BY 1 HAVING count(DISTINCT winner) > 1))
SELECT severity, code, n::BIGINT AS n FROM f WHERE n > 0"""
)
def preference_findings(s, d):
    p = b.preferences(s, d).withColumn("judgment_id", F.concat(F.lit("judg_"), (F.col("ord") % 900).cast("string")))
    found = preferences.validate(p, preferences.Policy(allow_ties=False))
    return found.groupBy("severity", "code").agg(F.count("*").cast("long").alias("n"))


@query(
    f""", w AS {_part('winner_balance')}, g AS {_part('annotator_agreement')}, l AS {_part('length_bias')}, f AS {_part('format_bias')},
p AS (SELECT count(*) AS n, count(DISTINCT clip_id) AS clips, count_if(response_a = response_b) AS identical FROM pref),
t AS (SELECT count(*) AS judgments FROM (SELECT 1 FROM pref GROUP BY judgment_id HAVING count(*) > 1)), r AS (SELECT count(*) AS responses FROM {_part('response_duplicates')}),
o AS (SELECT w.*, g.* EXCLUDE (n_unique_pairs), l.n AS l_n, l.n_longer, l.frac_longer, f.* EXCLUDE (n), p.n AS p_n, clips, identical, judgments, responses FROM w, g, l, f, p, t, r),
h AS (SELECT unnest([
  {{'severity': 'error', 'code': 'malformed_records', 'n': 2, 'is': true}},
  {{'severity': CASE WHEN least(n_a, n_b) = 0 OR (n_forced >= 4 AND greatest(n_a, n_b) >= 0.75 * n_forced) THEN 'warning' ELSE 'info' END,
    'code': CASE WHEN least(n_a, n_b) = 0 THEN 'winner_one_sided' WHEN n_forced >= 4 AND greatest(n_a, n_b) >= 0.75 * n_forced THEN 'winner_imbalance' ELSE 'winner_mild_imbalance' END,
    'n': n_forced, 'is': n_forced > 0 AND (least(n_a, n_b) = 0 OR (n_forced >= 4 AND greatest(n_a, n_b) >= 0.75 * n_forced) OR NOT balanced)}},
  {{'severity': 'warning', 'code': 'duplicate_pair_ids', 'n': n_repeated, 'is': n_repeated > 0}},
  {{'severity': 'warning', 'code': 'contradictory_labels', 'n': n_contradictory, 'is': n_contradictory > 0}},
  {{'severity': 'error', 'code': 'identical_responses_within_pair', 'n': identical, 'is': identical > 0}},
  {{'severity': 'warning', 'code': 'exact_response_duplicates', 'n': responses, 'is': responses > 0}},
  {{'severity': 'error', 'code': 'pair_id_mismatch', 'n': p_n, 'is': p_n > 0}},
  {{'severity': 'error', 'code': 'duplicate_judgment_ids', 'n': judgments, 'is': judgments > 0}},
  {{'severity': CASE WHEN can_estimate_reliability THEN 'warning' ELSE 'info' END, 'code': CASE WHEN can_estimate_reliability THEN 'repeated_judgment_disagreement' ELSE 'irr_unavailable' END,
    'n': CASE WHEN can_estimate_reliability THEN n_contradictory ELSE n_annotators END, 'is': NOT can_estimate_reliability OR n_contradictory > 0}},
  {{'severity': 'possible_bias', 'code': 'possible_length_bias', 'n': n_longer, 'is': l_n >= 4 AND n_longer >= l_n * 2 / 3}},
  {{'severity': 'possible_bias', 'code': 'possible_confidence_format_bias', 'n': n_prefer_confidence, 'is': n_confidence_differs >= 3 AND frac_confidence >= 0.75}},
  {{'severity': 'possible_bias', 'code': 'possible_markdown_format_bias', 'n': n_prefer_markdown, 'is': n_markdown_differs >= 3 AND frac_markdown >= 0.75}},
  {{'severity': 'warning', 'code': 'single_clip_concentration', 'n': p_n, 'is': clips = 1 AND p_n >= 4}}], recursive := true) FROM o)
SELECT severity, code, n::BIGINT AS n FROM h WHERE "is" """
)
def preference_quality(s, d):
    return preferences.quality_findings(b.preferences(s, d), 2)


@query("SELECT 'clip' AS kind, clip_id AS key, count(*)::BIGINT AS n FROM pref GROUP BY 2 UNION ALL SELECT 'task', task, count(*)::BIGINT FROM pref GROUP BY 2 UNION ALL SELECT 'annotator', annotator_id, count(*)::BIGINT FROM pref GROUP BY 2 UNION ALL SELECT 'winner', winner, count(*)::BIGINT FROM pref GROUP BY 2")
def judgment_counts(s, d):
    return preferences.concentration(b.preferences(s, d))


@query("SELECT DISTINCT pair_id FROM pref q WHERE NOT EXISTS (SELECT 1 FROM pref j WHERE j.annotator_id = 'ann1' AND j.pair_id = q.pair_id AND j.ord % 2 = 0)")
def pending_queue(s, d):
    p = b.preferences(s, d)
    queue = p.select("pair_id").distinct()
    return preferences.pending(queue, p.where("ord % 2 = 0"), "ann1").select("pair_id")


# intervals and sampling


def _judged_spans(s: SparkSession, d: str) -> DataFrame:
    said = intervals.parse_interval(F.col("raw_text"))
    gold = intervals.interval(F.col("gold_start"), F.col("gold_end"), "seconds")
    return b.spans(s, d).select("event_id", gold.alias("gold"), said.alias("said")).select("event_id", "gold", F.col("said.interval").alias("predicted"), "said.reason")


_SPANS = r""", ps AS (SELECT event_id, gold_start AS gs, gold_end AS ge, TRY_CAST(regexp_extract(raw_text, 'start_s=([+-]?[0-9.]+)', 1) AS DOUBLE) AS ps, TRY_CAST(regexp_extract(raw_text, 'end_s=([+-]?[0-9.]+)', 1) AS DOUBLE) AS pe FROM span),
iv AS (SELECT *, greatest(0, least(ge, pe) - greatest(gs, ps)) AS inter FROM ps),
io AS (SELECT *, CASE WHEN gs = ge AND ps = pe THEN (gs = ps)::INT::DOUBLE WHEN (pe - ps) + (ge - gs) - inter <= 0 THEN 0 ELSE inter / ((pe - ps) + (ge - gs) - inter) END AS iou FROM iv)"""


@query(_SPANS + " SELECT event_id, ps AS start_s, pe AS end_s, 'seconds' AS unit FROM ps WHERE ps >= 0 AND pe >= ps")
def interval_parse(s, d):
    return _judged_spans(s, d).where("reason is null").select("event_id", F.col("predicted.start").alias("start_s"), F.col("predicted.end").alias("end_s"), F.col("predicted.unit").alias("unit"))


@query(_SPANS + " SELECT event_id, round(iou, 9) AS iou FROM io WHERE ps >= 0 AND pe >= ps AND gs >= 0")
def interval_iou(s, d):
    rows = _judged_spans(s, d).where("reason is null and gold.start >= 0")
    return rows.select("event_id", F.round(intervals.iou(F.col("predicted"), F.col("gold")), 9).alias("iou"))


@query(_SPANS + " SELECT event_id, (iou >= 0.5)::INT::DOUBLE AS binary_value, round(iou, 9) AS partial_value FROM io WHERE ps >= 0 AND pe >= ps AND gs >= 0")
def temporal_reward(s, d):
    moment = F.struct(F.col("gold_start").alias("start_s"), F.col("gold_end").alias("end_s"), F.lit(None).cast("int").alias("start_frame"), F.lit(None).cast("int").alias("end_frame"))
    causal = F.struct(F.lit("known").alias("status"), F.lit(True).alias("unique_cause"), moment.alias("causal_moment"))
    rows = b.spans(s, d).withColumn("c", causal)
    x = rows.select("event_id", scoring.temporal_reward(F.col("raw_text"), F.col("c"), "partial").alias("x")).where("x.eligible and not x.parse_failed")
    binary = intervals.temporal_value(F.col("x.iou"), F.col("x.eligible"), F.col("x.parse_failed"))
    return x.select("event_id", binary.alias("binary_value"), F.round("x.value", 9).alias("partial_value"))


@query("SELECT example_id, array_to_string(CASE WHEN num_frames = 1 THEN [0] ELSE list_transform(range(least(8, num_frames)), lambda i: round_even(i * (num_frames - 1) / (least(8, num_frames) - 1), 0)::INT) END, ',') AS indices FROM ex WHERE num_frames >= 1")
def frame_indices(s, d):
    ex = b.examples(s, d).where("num_frames >= 1")
    return ex.select("example_id", F.array_join(sampling.frame_indices(F.col("num_frames"), 8), ",").alias("indices"))


@query(
    """SELECT example_id, array_to_string(list_sort(list_distinct(list_concat(list_transform(range(12), lambda i: round_even(i * (num_frames - 1) / 11, 0)::INT), [num_frames // 3, num_frames // 2, least(num_frames - 1, 2 * num_frames // 3), 0, num_frames - 1]))), ',') AS indices
FROM ex WHERE num_frames >= 1"""
)
def review_indices(s, d):
    ex = b.examples(s, d).where("num_frames >= 1")
    return ex.select("example_id", F.array_join(sampling.review_indices(F.col("num_frames")), ",").alias("indices"))


@query(
    """, seeds AS (SELECT doc_id AS id, doc_id % 50 AS seed FROM documents),
s3 AS (SELECT id, (1664525 * seed + 1013904223) & 4294967295 AS st FROM seeds), v3 AS (SELECT id, st, st % 4 AS j FROM s3),
a3 AS (SELECT id, st, list_transform([0, 1, 2, 3], lambda k: CASE WHEN k = 3 THEN j WHEN k = j THEN 3 ELSE k END) AS v FROM v3),
s2 AS (SELECT id, (1664525 * st + 1013904223) & 4294967295 AS st, v FROM a3), v2 AS (SELECT id, st, v, st % 3 AS j FROM s2),
a2 AS (SELECT id, st, list_transform([0, 1, 2, 3], lambda k: CASE WHEN k = 2 THEN v[j + 1] WHEN k = j THEN v[3] ELSE v[k + 1] END) AS v FROM v2),
s1 AS (SELECT id, (1664525 * st + 1013904223) & 4294967295 AS st, v FROM a2), v1 AS (SELECT id, v, st % 2 AS j FROM s1)
SELECT id AS doc_id, array_to_string(list_transform([0, 1, 2, 3], lambda k: CASE WHEN k = 1 THEN v[j + 1] WHEN k = j THEN v[2] ELSE v[k + 1] END), ',') AS shuffled FROM v1"""
)
def lcg_shuffle(s, d):
    docs = b.table(s, d, "documents")
    four = F.array(*[F.lit(i) for i in range(4)])
    return docs.select("doc_id", F.array_join(sampling.shuffled(four, F.col("doc_id") % 50), ",").alias("shuffled"))


# texts and scores


@query(r"SELECT doc_id, lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS label FROM documents")
def normalize_labels(s, d):
    return b.table(s, d, "documents").select("doc_id", text.normalize_label(F.col("text")).alias("label"))


@query(
    """, l AS (SELECT doc_id, list_filter(list_transform(string_split(CASE doc_id % 3 WHEN 0 THEN concat('Answer: ', substr(text, 1, 20), chr(10), text) ELSE text END, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
a AS (SELECT doc_id, ls, list_filter(ls, lambda x: starts_with(lower(x), 'answer:') OR starts_with(lower(x), 'final answer:')) AS an FROM l)
SELECT doc_id, CASE WHEN len(an) > 0 THEN trim(regexp_replace(an[-1], '^(?i)(final )?answer:', '')) WHEN len(ls) > 0 THEN ls[-1] ELSE '' END AS answer FROM a"""
)
def parse_answer(s, d):
    docs = b.table(s, d, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Answer: "), F.substring("text", 1, 20), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    return docs.select("doc_id", text.parse_answer(raw).alias("answer"))


@query("SELECT example_id, method_id, CASE WHEN correct THEN 1.0 ELSE 0.0 END::DOUBLE AS value, correct AS matched, CASE WHEN correct THEN NULL WHEN parse_failed THEN 'parse_failed' ELSE 'label_mismatch' END AS notes FROM scored WHERE parsed_answer IS NOT NULL")
def exact_match_reward(s, d):
    rows = b.predictions(b.examples(s, d)).where("parsed_answer is not null")
    r = scoring.exact_match_reward(F.col("raw_text"), F.col("parsed_answer"), F.col("ground_truth"), F.lit("hidden_state"))
    return rows.select("example_id", "method_id", r.alias("r")).select("example_id", "method_id", "r.value", "r.matched", "r.notes")


@query(
    """, x AS (SELECT example_id, a.rm_score AS w, b.rm_score AS l FROM rm a JOIN rm b USING (example_id) WHERE a.method_id = 'm0' AND b.method_id = 'm1')
SELECT count(*)::BIGINT AS n_pairs, avg((w > l)::INT) AS accuracy, round(avg(ln(1 + exp(l - w))), 9) AS mean_bt_loss FROM x"""
)
def bt_loss(s, d):
    scores = b.model_scores(b.examples(s, d))
    side = lambda m, name: scores.where(F.col("method_id") == m).select("example_id", F.col("rm_score").alias(name))
    out = reward_model.pair_metrics(reward_model.pair_scores(side("m0", "reward_chosen").join(side("m1", "reward_rejected"), "example_id")))
    return out.withColumn("mean_bt_loss", F.round("mean_bt_loss", 9))


@query(
    r""", w AS (SELECT unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS word FROM benchmark), c AS (SELECT word, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 2)
SELECT word, (row_number() OVER (ORDER BY word) + 1)::BIGINT AS id FROM c"""
)
def vocab_ids(s, d):
    return reward_model.vocabulary(b.table(s, d, "benchmark"), "text", 2)


# divergence

_CELLS = """, mg AS (SELECT ground_truth AS label, count(*) AS n, min(ord) AS seen FROM lock_set GROUP BY 1), mj AS (SELECT label FROM mg ORDER BY n DESC, seen LIMIT 1),
cg AS (SELECT camera_id, ground_truth AS label, count(*) AS n, min(ord) AS seen FROM lock_set GROUP BY 1, 2), cm AS (SELECT camera_id, label, n FROM cg QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY n DESC, seen) = 1),
ce AS (SELECT a.*, CASE WHEN NOT a.missing THEN r.rm_score END AS rw, r.rm_score AS rm_all FROM aligned a JOIN rm r USING (example_id, method_id)),
af AS (SELECT list_sort(list(rw)) AS v FROM ce WHERE method_id = 'm1' AND rw IS NOT NULL),
ct AS (SELECT v[round_even(0.75 * (len(v) - 1), 0)::INT + 1] AS high_cut, v[round_even(0.25 * (len(v) - 1), 0)::INT + 1] AS low_cut FROM af),
qd AS (SELECT ce.*, CASE WHEN rw IS NULL OR correct IS NULL THEN 'unscored' WHEN rw >= high_cut AND NOT correct THEN 'high_reward_low_accuracy' WHEN rw <= low_cut AND correct THEN 'low_reward_high_accuracy'
  WHEN rw >= high_cut AND correct THEN 'high_reward_high_accuracy' WHEN rw <= low_cut AND NOT correct THEN 'low_reward_low_accuracy' ELSE 'unscored' END AS quadrant FROM ce, ct),
tg AS (SELECT q.*, CASE WHEN missing THEN [] ELSE list_filter([CASE WHEN NOT correct AND parsed_answer = (SELECT label FROM mj) THEN 'possible_answer_frequency_shortcut' END,
  CASE WHEN NOT correct AND parsed_answer = cm.label THEN 'possible_camera_leakage' END,
  CASE WHEN quadrant = 'high_reward_low_accuracy' THEN 'possible_rm_accuracy_divergence' END], lambda x: x IS NOT NULL) END AS tags FROM qd q LEFT JOIN cm USING (camera_id)),
ba AS (SELECT b.example_id, b.missing AS b_missing, a.missing AS a_missing, b.correct AS bc, a.correct AS ac, b.rw AS br, a.rw AS ar, b.rm_all AS brm, a.rm_all AS arm, b.quadrant AS bq, a.quadrant AS aq, b.tags AS bt, a.tags AS atags
  FROM tg b JOIN tg a USING (example_id) WHERE b.method_id = 'm0' AND a.method_id = 'm1')"""


@query(_CELLS + " SELECT high_cut, low_cut FROM ct")
def reward_cuts(s, d):
    ex = b.examples(s, d)
    return divergence.cuts(divergence.cell_rewards(_aligned(s, d, ex), b.model_scores(ex), SETTINGS), SETTINGS)


@query(_CELLS + " SELECT example_id, method_id, rw AS reward, quadrant, array_to_string(tags, ',') AS tags FROM tg")
def quadrants(s, d):
    return _records(s, d)[0].select("example_id", "method_id", "reward", "quadrant", F.array_join("tags", ",").alias("tags"))


@query(_CELLS + " SELECT method_id, quadrant, count(*)::BIGINT AS n FROM tg WHERE NOT missing GROUP BY 1, 2")
def quadrant_counts(s, d):
    return divergence.quadrant_counts(_records(s, d)[0])


@query(_CELLS + " SELECT camera_id, label, n::BIGINT AS n FROM cm")
def camera_majority(s, d):
    return analysis.majority_gold(align.locked(b.examples(s, d)), "ord", "camera_id")


@query(_CELLS + " SELECT example_id, ac::INT - bc::INT AS correct_delta, round(ar - br, 9) AS reward_delta FROM ba")
def before_after(s, d):
    return _records(s, d)[1].select("example_id", "delta.correct_delta", F.round("delta.reward_delta", 9).alias("reward_delta"))


@query(
    _CELLS
    + """, rt AS (SELECT example_id, list_concat(list_concat(list_concat(list_distinct(list_concat(bt, atags)), CASE WHEN ar > br AND ac::INT <= bc::INT THEN ['possible_reward_up_accuracy_flat_or_down'] ELSE [] END), bt), atags) AS l FROM ba),
u AS (SELECT unnest(l) AS tag FROM rt) SELECT tag, count(*)::BIGINT AS n FROM u GROUP BY 1"""
)
def divergence_tag_counts(s, d):
    return divergence.divergence_tags(_records(s, d)[1])


@query(
    _CELLS
    + """ SELECT count(*)::BIGINT AS n_aligned, round(avg(bc::INT), 9) AS accuracy_before, round(avg(ac::INT), 9) AS accuracy_after, round(avg(br), 9) AS mean_reward_before, round(avg(ar), 9) AS mean_reward_after,
  count_if(aq = 'high_reward_low_accuracy')::BIGINT AS n_high_reward_low_accuracy, count_if(aq = 'low_reward_high_accuracy')::BIGINT AS n_low_reward_high_accuracy, count_if(aq <> 'unscored')::BIGINT AS n_scored_after,
  CASE WHEN count(*) >= 8 THEN 'possible_bias' ELSE 'info_only' END AS claim_strength FROM ba"""
)
def divergence_summary(s, d):
    out = divergence.summary(_records(s, d)[1], SETTINGS)
    r = lambda c: F.round(c, 9).alias(c)
    return out.select("n_aligned", r("accuracy_before"), r("accuracy_after"), r("mean_reward_before"), r("mean_reward_after"), "n_high_reward_low_accuracy", "n_low_reward_high_accuracy", "n_scored_after", "claim_strength")


# selection, eligibility, training rows


@query(
    """, p AS (SELECT *, row_number() OVER (PARTITION BY trick_id ORDER BY trick_id, example_id) AS k FROM scored WHERE method_id = 'm0' AND correct),
f AS (SELECT trick_id, row_number() OVER (ORDER BY min(trick_id), min(example_id)) AS b FROM p GROUP BY 1)
SELECT example_id, trick_id, row_number() OVER (ORDER BY k, b)::INT AS turn FROM p JOIN f USING (trick_id) ORDER BY k, b LIMIT 25"""
)
def round_robin_examples(s, d):
    rows = _scored(s, d).where("method_id = 'm0' and correct")
    return selection.round_robin(rows, "trick_id", ("trick_id", "example_id"), 25).select("example_id", "trick_id", "turn")


@query("SELECT example_id, min_by(method_id, method_id) AS method_id FROM aligned WHERE NOT missing GROUP BY 1")
def first_present_cell(s, d):
    cells = selection.first_present(_aligned(s, d))
    return cells.where("cell is not null").select("example_id", F.col("cell.method_id").alias("method_id"))


@query(
    """, c AS (SELECT CASE doc_id % 4 WHEN 0 THEN concat('toy_', CAST(doc_id AS VARCHAR)) WHEN 1 THEN concat('peerj_', CAST(doc_id AS VARCHAR)) WHEN 2 THEN 'opaque_x' ELSE 'other' END AS candidate,
  CASE quality WHEN 1 THEN 'QUALIFIES' ELSE CASE toxic WHEN 1 THEN 'NOT_SUITABLE' ELSE 'QUALIFIES_WITH_HUMAN_REVIEW' END END AS status FROM labels),
k AS (SELECT *, CASE WHEN starts_with(candidate, 'toy_') THEN 'synthetic_fixtures' WHEN contains(candidate, 'opaque') THEN 'peerj_documented_missing' WHEN starts_with(candidate, 'peerj_') THEN 'wikimedia_controls' ELSE 'given' END AS collection FROM c)
SELECT collection, count(*)::BIGINT AS candidate_count, count_if(status = 'QUALIFIES')::BIGINT AS eligible_count, count_if(status = 'QUALIFIES_WITH_HUMAN_REVIEW')::BIGINT AS pending_human_review, count_if(status = 'NOT_SUITABLE')::BIGINT AS rejected_count FROM k GROUP BY 1"""
)
def inventory_stats(s, d):
    rows = b.table(s, d, "labels")
    i = F.col("doc_id")
    name = F.when(i % 4 == 0, F.concat(F.lit("toy_"), i.cast("string"))).when(i % 4 == 1, F.concat(F.lit("peerj_"), i.cast("string"))).when(i % 4 == 2, "opaque_x").otherwise("other")
    status = F.when(F.col("quality") == 1, "QUALIFIES").when(F.col("toxic") == 1, "NOT_SUITABLE").otherwise("QUALIFIES_WITH_HUMAN_REVIEW")
    return eligibility.inventory_stats(rows.select(eligibility.collection(name, F.lit("given")).alias("collection"), status.alias("status")))


@query("SELECT concat('You are analyzing a short magic or mentalism demonstration.' || chr(10) || 'Question: ', question, chr(10) || 'Answer briefly and concretely.') AS prompt, example_id, ground_truth, split FROM ex WHERE task = 'hidden_state' AND split <> 'held_out'")
def grpo_rows(s, d):
    return guards.grpo_rows(b.examples(s, d), allow_held_out=True)


@query("SELECT high, low, middle FROM (SELECT v[round_even(0.9 * (len(v) - 1), 0)::INT + 1] AS high, v[round_even(0.1 * (len(v) - 1), 0)::INT + 1] AS low, v[round_even(0.5 * (len(v) - 1), 0)::INT + 1] AS middle FROM (SELECT list_sort(list(value)) AS v FROM events))")
def nearest_rank_quantiles(s, d):
    return aggregates.nearest_rank(b.table(s, d, "events"), "value", {"high": 0.9, "low": 0.1, "middle": 0.5})


# records, stages and text functions


def _given(rule: dict[int, str], by: str, modulo: int) -> F.Column:
    """A value by the remainder of a column; null for the others."""
    out = F.lit(None).cast("string")
    for k, v in rule.items():
        out = F.when(F.expr(f"{by} % {modulo} = {k}"), F.lit(v)).otherwise(out)
    return out


def _given_sql(rule: dict[int, str], by: str, modulo: int) -> str:
    return f"CASE {by} % {modulo} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in rule.items()) + " END"


@query("SELECT example_id, split FROM ex WHERE task = 'hidden_state' AND split <> 'held_out'")
def stage_rows(s, d):
    return guards.for_stage(guards.of_task(b.examples(s, d), "hidden_state"), "dpo", allow_held_out=True).select("example_id", "split")


@query("SELECT judgment_id, split AS part FROM pref WHERE split IN ('train', 'val')")
def preference_parts(s, d):
    parts = preferences.train_and_validation(b.preferences(s, d), fallback=False)
    train, val = (p.select("judgment_id", F.lit(n).alias("part")) for p, n in zip(parts, ("train", "val")))
    return train.unionByName(val)


@query("SELECT p.example_id, p.method_id, p.parsed_answer, e.clip_id, e.question_variant, e.duration_s FROM pred p JOIN ex e USING (example_id)")
def manifest_joined(s, d):
    ex = b.examples(s, d)
    rows = b.predictions(ex).select("example_id", "method_id", "parsed_answer")
    return analysis.join_manifest(rows, ex, ("clip_id", "question_variant", "duration_s"))


@query("SELECT ord, example_id, trick_id, parsed_answer FROM pred WHERE method_id = 'm0'")
def positional_rows(s, d):
    ex = guards.of_task(b.examples(s, d), "hidden_state")
    said = b.predictions(ex).where("method_id = 'm0'").select("ord", "example_id", "trick_id", "parsed_answer")
    return analysis.positional(ex, ex.select("ord", "example_id"), said).select("ord", "example_id", "trick_id", "parsed_answer")


@query(
    """, r AS (SELECT *, ord % 3 = 0 AS gone, ord % 3 <> 0 AND split_part(raw_text, 'Answer: ', 2) = ground_truth AS hit FROM pred)
SELECT CASE WHEN gone THEN concat('gone_', example_id) ELSE example_id END AS example_id, method_id, hit::INT::DOUBLE AS reward, hit AS matched, false AS parse_failed FROM r"""
)
def rollout_rewards(s, d):
    ex = b.examples(s, d)
    name = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("gone_"), F.col("example_id"))).otherwise(F.col("example_id"))
    rollouts = b.predictions(ex).select(name.alias("example_id"), "method_id", F.col("raw_text").alias("completion"))
    return guards.rollout_rewards(rollouts, ex).drop("completion")


@query(
    f""", o AS (SELECT e.example_id, s.shuffled, list_transform(range(4), lambda i: round_even(i * (num_frames - 1) / 3, 0)::INT) AS v FROM ex e JOIN {_part('lcg_shuffle')} s ON s.doc_id = e.ord WHERE num_frames >= 4)
SELECT example_id, array_to_string(v, ',') AS ordered_indices, array_to_string(list_transform(string_split(shuffled, ','), lambda k: v[k::INT + 1]), ',') AS shuffled_indices,
  true AS same_frame_set, shuffled <> '0,1,2,3' AS permuted FROM o"""
)
def sample_plans(s, d):
    ex = b.examples(s, d).where("num_frames >= 4")
    plan = ex.select("example_id", sampling.sample_plan(F.col("num_frames"), 4, F.col("ord") % 50).alias("p")).select("example_id", "p.*")
    return plan.withColumns({c: F.array_join(c, ",") for c in ("ordered_indices", "shuffled_indices")})


_LEAKAGE = {0: "PASS", 1: "FAIL", 2: "NONE"}
_APPROVAL = {0: "APPROVE", 1: "REJECT", 2: "APPROVED", 3: "APPROVE"}
_GOLD = f""", g AS (
  SELECT doc_id AS i, concat(CASE WHEN doc_id % 8 = 1 THEN 'peerj_' ELSE 'toy_' END, CAST(doc_id AS VARCHAR)) AS clip_id,
    CASE doc_id % 6 WHEN 0 THEN 'HUMAN_FILL_REQUIRED' WHEN 1 THEN '  ' ELSE lang END AS question, l.quality, source AS provenance_source,
    {_given_sql(_APPROVAL, 'doc_id', 5)} AS human, {_given_sql(_LEAKAGE, 'doc_id', 4)} AS leak
  FROM labels l JOIN documents USING (doc_id)
), errs AS (
  SELECT clip_id, list_filter([
    CASE WHEN starts_with(clip_id, 'peerj_') THEN 'wikimedia control must not enter hidden-state gold' END,
    CASE WHEN trim(question) = '' OR question = 'HUMAN_FILL_REQUIRED' THEN 'question missing' END,
    CASE WHEN quality <> 1 THEN 'ground_truth missing' END,
    CASE WHEN trim(provenance_source) = '' THEN 'provenance.source missing' END,
    CASE WHEN human IS NULL OR human = 'REJECT' THEN 'human approval missing' END,
    CASE WHEN i % 9 = 0 THEN 'unresolved leakage warning' END,
    CASE WHEN leak IS NULL OR leak = 'FAIL' THEN 'answer leakage not resolved' END,
    CASE WHEN i % 11 = 0 THEN 'evaluation clip includes a reveal' END], lambda x: x IS NOT NULL) AS e FROM g
)"""


def _gold(s: SparkSession, d: str) -> DataFrame:
    rows = b.table(s, d, "labels").select("doc_id", "quality").join(b.table(s, d, "documents").select("doc_id", F.col("lang").alias("spoken"), "source"), "doc_id")
    i = F.col("doc_id")
    proposal = F.struct(_given(_LEAKAGE, "doc_id", 4).alias("answer_leakage_status"), F.when(i % 11 == 0, "REVEAL_PRESENT").alias("reveal_status"))
    metadata = F.to_json(F.struct(_given(_APPROVAL, "doc_id", 5).alias("human_decision"), (i % 9 == 0).alias("unresolved_leakage_warning"), proposal.alias("annotation_proposal")))
    return eligibility.gold_errors(
        rows.select(
            F.concat(F.when(i % 8 == 1, "peerj_").otherwise("toy_"), i.cast("string")).alias("clip_id"),
            F.when(i % 6 == 0, eligibility.PLACEHOLDER).when(i % 6 == 1, "  ").otherwise(F.col("spoken")).alias("question"),
            F.when(F.col("quality") == 1, "good").alias("ground_truth"),
            F.col("source").alias("provenance_source"),
            metadata.alias("metadata"),
        )
    )


@query(_GOLD + " SELECT clip_id, len(e) = 0 AS passed, array_to_string(e, '; ') AS errors FROM errs")
def gold_errors(s, d):
    return _gold(s, d).withColumn("errors", F.array_join("errors", "; "))


@query(_GOLD + " SELECT count(*)::BIGINT AS n, coalesce(bool_and(len(e) = 0), false) AS passed FROM errs")
def gold_manifest(s, d):
    return eligibility.gold_manifest(_gold(s, d))


@query(
    """, k AS (SELECT CASE quality WHEN 1 THEN 'QUALIFIES' ELSE CASE toxic WHEN 1 THEN 'NOT_SUITABLE' ELSE 'QUALIFIES_WITH_HUMAN_REVIEW' END END AS status FROM labels)
SELECT count(*)::BIGINT AS candidate_count, count_if(status = 'QUALIFIES')::BIGINT AS eligible_count, count_if(status = 'QUALIFIES_WITH_HUMAN_REVIEW')::BIGINT AS pending_human_review,
  count_if(status = 'NOT_SUITABLE')::BIGINT AS rejected_count, greatest(0, 5000 - count_if(status = 'QUALIFIES'))::BIGINT AS still_needed FROM k"""
)
def readiness(s, d):
    status = F.when(F.col("quality") == 1, "QUALIFIES").when(F.col("toxic") == 1, "NOT_SUITABLE").otherwise("QUALIFIES_WITH_HUMAN_REVIEW")
    return eligibility.readiness(b.table(s, d, "labels").select(status.alias("status")), target=5000)


@query("SELECT concat('c_', CAST(doc_id AS VARCHAR)) AS clip_id, quality, n_chars::BIGINT AS frames FROM labels JOIN documents USING (doc_id)")
def proposals_with_provenance(s, d):
    clip = F.concat(F.lit("c_"), F.col("doc_id").cast("string")).alias("clip_id")
    technical = b.table(s, d, "documents").select(clip, F.col("n_chars").cast("long").alias("frames"))
    return eligibility.with_provenance(b.table(s, d, "labels").select(clip, "quality"), technical)


_SAID = {0: "Answer: ", 1: "it clearly proves that this is unclear: ", 2: "the palm and the load, reasoning improved "}


def _listed(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


@query(
    f""", t AS (SELECT doc_id, concat({_given_sql(_SAID, 'doc_id', 3)}, text) AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_filter({_listed(text.CONFIDENCE_MARKERS)}, lambda w: contains(lower(x), w)), ',') AS confidence,
  array_to_string(list_filter({_listed(text.KEYWORDS)}, lambda w: contains(lower(x), w)), ',') AS keywords,
  len(list_filter({_listed(text.AMBIGUITY_HINTS)}, lambda w: contains(lower(x), w))) > 0 AS ambiguous,
  regexp_matches(x, '{text.LABEL_LIKE}') AS label_like,
  {' OR '.join(f"regexp_matches(x, '{p}')" for p in text.FORBIDDEN_CLAIMS)} AS forbidden FROM t"""
)
def text_markers(s, d):
    x = F.col("x")
    said = b.table(s, d, "documents").where("text is not null").select("doc_id", F.concat(_given(_SAID, "doc_id", 3), F.col("text")).alias("x"))
    return said.select(
        "doc_id",
        F.array_join(text.confidence_hits(x), ",").alias("confidence"),
        F.array_join(text.keyword_hits(x), ",").alias("keywords"),
        text.suggests_ambiguity(x).alias("ambiguous"),
        text.label_like(x).alias("label_like"),
        text.makes_forbidden_claim(x).alias("forbidden"),
    )


@query("SELECT judgment_id, concat('[TASK] ', task, chr(10), '[CLIP] ', clip_id, chr(10), '[INSTRUCTION] ', instruction, chr(10), '[RESPONSE] ', response_b) AS body, length(response_b)::BIGINT AS n_chars FROM pref")
def reward_contexts(s, d):
    context = text.context_text(F.col("task"), F.col("clip_id"), F.col("instruction"))
    return b.preferences(s, d).select("judgment_id", text.pair_text(context, F.col("response_b")).alias("body"), text.char_length(F.col("response_b")).alias("n_chars"))


@query("SELECT judgment_id, round(1.0 - 0.5 * least(length(response_a) / 200.0, 1.0), 9)::DOUBLE AS score FROM pref")
def length_penalties(s, d):
    return b.preferences(s, d).select("judgment_id", F.round(scoring.length_penalty(F.lit(1.0), F.col("response_a")), 9).alias("score"))


_TYPED = {0: " A ", 1: "response_b", 2: "Tie", 3: "2", 4: "neither", 5: "1"}


@query("SELECT judgment_id, CASE ord % 7 WHEN 0 THEN 'a' WHEN 5 THEN 'a' WHEN 1 THEN 'b' WHEN 3 THEN 'b' WHEN 2 THEN 'tie' END AS side FROM pref")
def judged_sides(s, d):
    return b.preferences(s, d).select("judgment_id", preferences.judged_side(_given(_TYPED, "ord", 7)).alias("side"))


@query(
    """SELECT judgment_id AS row, concat('judg_', substr(sha256('{"annotator_id":"' || annotator_id || '","pair_id":"' || pair_id || '","timestamp":"t' || CAST(ord AS VARCHAR) || '"}'), 1, 24)) AS judgment_id FROM pref"""
)
def judgment_ids(s, d):
    at = F.concat(F.lit("t"), F.col("ord").cast("string"))
    return b.preferences(s, d).select(F.col("judgment_id").alias("row"), text.judgment_id(F.col("pair_id"), F.col("annotator_id"), at).alias("judgment_id"))


@query(
    r"""SELECT doc_id, concat('20240506T070809Z_', regexp_replace(regexp_replace(concat('.', lang, ' / ', source, '_', CAST(doc_id AS VARCHAR), '!'), '[^\p{L}\p{N}_-]', '-', 'g'), '^-+|-+$', '', 'g')) AS run_id FROM documents"""
)
def run_ids(s, d):
    name = F.concat(F.lit("."), F.col("lang"), F.lit(" / "), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("!"))
    return b.table(s, d, "documents").select("doc_id", text.run_id(name, F.to_timestamp(F.lit("2024-05-06 07:08:09"))).alias("run_id"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE printf('%.4f', value / 3) END AS shown FROM events WHERE value IS NOT NULL")
def four_decimals(s, d):
    rows = b.table(s, d, "events").where("value is not null")
    return rows.select("event_id", text.four_decimals(F.when(F.col("event_id") % 5 != 0, F.col("value") / 3)).alias("shown"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN source ELSE concat(lang, chr(10), source) END AS said FROM documents""")
def completion_texts(s, d):
    lang, source, i = F.col("lang"), F.col("source"), F.col("doc_id")
    message = lambda x: F.to_json(F.struct(F.lit("assistant").alias("role"), x.alias("content")))
    payload = F.when(i % 3 == 0, text.json_string(lang)).when(i % 3 == 1, message(source)).otherwise(F.concat(F.lit("["), message(lang), F.lit(","), text.json_string(source), F.lit("]")))
    return b.table(s, d, "documents").select("doc_id", text.completion_text(payload).alias("said"))


@query(
    f"""SELECT example_id, md5(concat('STUB_RESPONSE images=0 videos=0 frames=', CAST(num_frames AS VARCHAR), ' :: ', replace('{text.PROMPT}', '{{question}}', question))) AS digest FROM ex WHERE question IS NOT NULL"""
)
def stub_responses(s, d):
    ex = b.examples(s, d).where("question is not null")
    said = text.stub_response(text.prompt(F.col("question")), frames=F.col("num_frames"))
    return ex.select("example_id", F.md5(said.cast("binary")).alias("digest"))


@query(
    """, e AS (SELECT event_id % 20 AS epoch, max(value) AS val_accuracy, min(value) AS train_accuracy FROM events GROUP BY 1)
SELECT epoch, val_accuracy, train_accuracy - val_accuracy AS overfit_gap FROM e ORDER BY val_accuracy DESC, epoch DESC LIMIT 1"""
)
def best_epoch(s, d):
    epochs = b.table(s, d, "events").groupBy((F.col("event_id") % 20).alias("epoch")).agg(F.max("value").alias("val_accuracy"), F.min("value").alias("train_accuracy"))
    return analysis.best_epoch(epochs)


@query('SELECT judgment_id, (row_number() OVER (ORDER BY ord))::INT AS "index", count(*) OVER () AS total FROM pref')
def queue_positions(s, d):
    return preferences.queue_positions(b.preferences(s, d).select("judgment_id", "ord")).drop("ord")


@query(
    """SELECT epoch_us(time_bucket(INTERVAL '10 minutes', ts))::BIGINT AS start_us, count(*)::BIGINT AS n, round(avg(value), 6) AS mean_reward, count_if(event_id % 9 = 0)::BIGINT AS n_parse_failed FROM events GROUP BY 1"""
)
def rollout_windows(s, d):
    rows = b.table(s, d, "events").select("ts", F.col("value").alias("reward"), (F.col("event_id") % 9 == 0).alias("parse_failed"))
    start = F.unix_micros(F.col("window.start").cast("timestamp")).alias("start_us")
    return judgments.rollout_metrics(rows).select(start, "n", F.round("mean_reward", 6).alias("mean_reward"), "n_parse_failed")


_STATUS = {0: "known", 1: "ambiguous", 2: "researcher_annotated", 3: "known"}


@query(
    f""", g AS (SELECT event_id, gold_start, gold_end, {_given_sql(_STATUS, 'event_id', 4)} AS status, event_id % 4 <> 3 AS moment FROM span WHERE gold_start >= 0)
SELECT event_id, status <> 'ambiguous' AND moment AS eligible, CASE WHEN status = 'ambiguous' THEN 'ambiguous_annotation' WHEN NOT moment THEN 'missing_causal_moment' END AS reason,
  CASE status WHEN 'known' THEN 'objectively_established' ELSE status END AS status_label, CASE WHEN moment THEN gold_start END AS start_s, CASE WHEN moment THEN gold_end END AS end_s FROM g"""
)
def gold_intervals(s, d):
    moment = F.struct(F.col("gold_start").alias("start_s"), F.col("gold_end").alias("end_s"), F.lit(None).cast("int").alias("start_frame"), F.lit(None).cast("int").alias("end_frame"))
    causal = F.struct(_given(_STATUS, "event_id", 4).alias("status"), F.lit(True).alias("unique_cause"), F.when(F.col("event_id") % 4 != 3, moment).alias("causal_moment"))
    rows = b.spans(s, d).where("gold_start >= 0").select("event_id", intervals.gold_interval(causal).alias("g"))
    return rows.select("event_id", "g.eligible", "g.reason", "g.status_label", F.col("g.interval.start").alias("start_s"), F.col("g.interval.end").alias("end_s"))


@query("SELECT doc_id, doc_id % 3 = 0 OR (doc_id % 3 = 2 AND lower(source) = lower(lang)) AS same FROM documents WHERE trim(source) <> ''")
def exact_matches(s, d):
    said = F.concat(F.lit("  "), F.upper("source"), F.lit(" \n"))
    gold = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, " ").otherwise(F.col("lang"))
    return b.table(s, d, "documents").where("trim(source) <> ''").select("doc_id", text.exact_match(said, gold).alias("same"))


# record files


def _example_lines(s: SparkSession, d: str) -> DataFrame:
    """The examples as a file of JSON lines, some of them broken, read back by the scanner."""
    ex = b.examples(s, d)
    null = F.lit(None).cast("string")
    video = F.struct(F.col("video_path").alias("path"), "fps", F.greatest("num_frames", F.lit(1)).alias("num_frames"))
    split = F.when(F.col("ord") % 13 == 1, "test").otherwise(F.col("split"))
    provenance = F.struct(F.lit("tables").alias("source"), null.alias("license"))
    body = F.to_json(
        F.struct(
            "example_id", "clip_id", "trick_id", "performer_id", "camera_id", "task", video.alias("video"), F.col("example_id").alias("question"),
            F.when(F.col("ord") % 2 == 0, F.col("ground_truth")).alias("ground_truth"), F.when(F.col("ord") % 2 == 1, F.col("ground_truth")).alias("answer"),
            split.alias("split"), provenance.alias("provenance"),
        )
    )
    line = F.when(F.col("ord") % 13 == 0, F.substring(body, 1, 20)).otherwise(F.concat(F.lit("  "), body))
    path = sinks.scratch(s)
    ex.select(line.alias("value")).write.text(path)
    return jsonl.examples(s, path)


_REFUSED = "ord % 13 IN (0, 1)"


@query(f"SELECT example_id, clip_id, task, split, ground_truth, video_path, fps FROM ex WHERE NOT {_REFUSED}")
def example_lines_read(s, d):
    good, _ = jsonl.permissive(_example_lines(s, d))
    return jsonl.flat_examples(good).select("example_id", "clip_id", "task", "split", "ground_truth", "video_path", "fps")


@query(f"SELECT CASE ord % 13 WHEN 0 THEN 'not a JSON object' ELSE 'split is unknown' END AS error, count(*)::BIGINT AS n FROM ex WHERE {_REFUSED} GROUP BY 1")
def example_lines_refused(s, d):
    _, bad = jsonl.permissive(_example_lines(s, d))
    return bad.groupBy("error").agg(F.count("*").alias("n"))


# streams


@query(
    """, one AS (SELECT *, row_number() OVER (PARTITION BY judgment_id ORDER BY ord) AS a FROM pref),
two AS (SELECT *, row_number() OVER (PARTITION BY annotator_id, pair_id ORDER BY ord, judgment_id) AS b FROM one WHERE a = 1)
SELECT judgment_id, annotator_id, pair_id, winner FROM two WHERE b = 1"""
)
def judgment_log(s, d):
    """The judgments in three parts, the log being stopped after each and started again; the first part comes again with the last."""
    rows = b.preferences(s, d).select("judgment_id", "annotator_id", "pair_id", "ord", "winner")
    where = sinks.scratch(s)
    bounds = rows.stat.approxQuantile("ord", [1 / 3, 2 / 3], 0.01) or [0, 0]
    parts = ["ord <= {0}", "ord > {0} and ord <= {1}", "ord > {1} or ord <= {0}"]
    for part in parts:
        rows.where(part.format(*bounds)).write.mode("append").parquet(f"{where}/in")
        judgments.log_judgments(s.readStream.schema(rows.schema).parquet(f"{where}/in"), f"{where}/log", f"{where}/state").awaitTermination()
    return s.read.schema(rows.schema).parquet(f"{where}/log").drop("ord")


# reward model


@query(
    """, f AS (SELECT judgment_id FROM pref WHERE winner IN ('a', 'b') AND split = 'train'), n AS (SELECT count(*) AS n FROM f),
r AS (SELECT judgment_id, row_number() OVER (ORDER BY ('0x' || substr(md5('7:' || judgment_id), 1, 15))::BIGINT, judgment_id) AS k FROM f)
SELECT judgment_id, CASE WHEN n > 1 AND k <= greatest(1, round_even(n * 0.25, 0)) THEN 'val' ELSE 'train' END AS part FROM r, n"""
)
def preference_split(s, d):
    rows = preferences.dpo_rows(b.preferences(s, d)).where("split = 'train'")
    return preferences.seeded_split(rows, "judgment_id", 7, 0.25).select("judgment_id", "part")


def _state_model(names: DataFrame, path: str) -> None:
    """Store weights by rule for the words (word, id), so that SQL can say what they give."""
    layers = {"w1": [[0.5, -0.25], [0.75, 1.0]], "b1": [0.1, 0.0], "w2": [[1.0, 0.5], [-0.5, 1.0]], "b2": [0.0, 0.05], "w3": [[0.8], [-0.6]], "b3": [0.2]}
    rows = names.select("id", "word").union(names.sparkSession.createDataFrame([(0, "<pad>"), (1, "<unk>")], "id long, word string"))
    vector = F.array((F.col("id") * 7 % 11 - 5) / 5, (F.col("id") * 5 % 13 - 6) / 6)
    embedding_reward.save_tables(rows.withColumn("vector", vector), {k: np.array(v) for k, v in layers.items()}, 256, path)


@query(
    r""", t AS (SELECT judgment_id, '[TASK] ' || task || chr(10) || '[CLIP] ' || clip_id || chr(10) || '[INSTRUCTION] ' || instruction || chr(10) || '[RESPONSE] ' AS c,
  CASE winner WHEN 'a' THEN response_a ELSE response_b END AS x, CASE winner WHEN 'a' THEN response_b ELSE response_a END AS y FROM pref WHERE winner IN ('a', 'b')),
sides AS (SELECT judgment_id, 'x' AS side, c || x AS txt FROM t UNION ALL SELECT judgment_id, 'y', c || y FROM t),
w AS (SELECT judgment_id, side, list_filter(string_split_regex(lower(txt), '\s+'), lambda x: x <> '') AS w FROM sides),
voc AS (SELECT word, row_number() OVER (ORDER BY word) + 1 AS id FROM (SELECT DISTINCT unnest(w) AS word FROM w)),
u AS (SELECT judgment_id, side, unnest(w[1:256]) AS word FROM w),
p AS (SELECT judgment_id, side, avg((id * 7 % 11 - 5) / 5.0) AS p1, avg((id * 5 % 13 - 6) / 6.0) AS p2 FROM u JOIN voc USING (word) GROUP BY 1, 2),
h AS (SELECT judgment_id, side, greatest(0.5 * p1 + 0.75 * p2 + 0.1, 0) AS h1, greatest(p2 - 0.25 * p1, 0) AS h2 FROM p),
g AS (SELECT judgment_id, side, 0.8 * greatest(h1 - 0.5 * h2, 0) - 0.6 * greatest(0.5 * h1 + h2 + 0.05, 0) + 0.2 AS score FROM h),
o AS (SELECT judgment_id, max(score) FILTER (side = 'x') AS cs, max(score) FILTER (side = 'y') AS rs FROM g GROUP BY 1)
SELECT judgment_id, round(cs, 9) AS reward_chosen, round(rs, 9) AS reward_rejected, round(ln(1 + exp(rs - cs)), 9) AS bt_loss FROM o"""
)
def embedding_rewards(s, d):
    rows = preferences.dpo_rows(b.preferences(s, d))
    where = sinks.scratch(s)
    _state_model(reward_model.numbered(embedding_reward.each_word(embedding_reward.texts(rows))), where)
    out = embedding_reward.score_stored(s, where, rows)
    return out.select("judgment_id", *(F.round(c, 9).alias(c) for c in ("reward_chosen", "reward_rejected", "bt_loss")))


# content ids of nested objects and of files


@query(
    """, o AS (SELECT doc_id, '{"id":' || doc_id || ',"meta":{"lang":' || coalesce('"' || lang || '"', 'null') || ',"sizes":[' || n_chars || ',{"k":' || n_chars % 7 || ',"z":null}],"source":' || coalesce('"' || source || '"', 'null') || '},"share":' || CAST(n_chars / 4.0::DOUBLE AS VARCHAR) || '}' AS j FROM documents)
SELECT doc_id, j AS canonical, substr(sha256(j), 1, 16) AS fingerprint FROM o"""
)
def nested_fingerprints(s, d):
    sizes = F.to_json(F.array(F.struct(F.lit(None).cast("string").alias("z"), (F.col("n_chars") % 7).alias("k"))), {"ignoreNullFields": "false"})
    meta = F.to_json(F.struct("source", "lang"), {"ignoreNullFields": "false"})
    text_of = F.concat(F.lit('{ "share" : '), (F.col("n_chars") / 4).cast("string"), F.lit(', "id":'), F.col("doc_id").cast("string"), F.lit(', "meta": '), F.regexp_replace(meta, r"\}$", ""), F.lit(',\n"sizes": ['), F.col("n_chars").cast("string"), F.lit(", "), F.substring(sizes, F.lit(2), F.length(sizes) - 2), F.lit("]}}"))
    rows = b.table(s, d, "documents").select("doc_id", text_of.alias("payload"))
    return rows.select("doc_id", canonical.canonical_object(F.col("payload")).alias("canonical"), canonical.config_fingerprint(F.col("payload")).alias("fingerprint"))


@query("SELECT item_id, strlen(text || chr(10))::BIGINT AS length, sha256(text || chr(10)) AS digest FROM benchmark WHERE text IS NOT NULL")
def item_file_digests(s, d):
    where = sinks.scratch(s)
    items = b.table(s, d, "benchmark").where("text is not null").select("item_id", F.col("text").alias("value"))
    items.repartition("item_id").write.partitionBy("item_id").text(where)
    kind = items.schema["item_id"].dataType
    found = files.file_digests(s, where, "*.txt")
    return found.select(F.url_decode(F.regexp_extract("path", "item_id=([^/]*)/", 1)).cast(kind).alias("item_id"), "length", "digest")


# tables of runs


@query(
    """SELECT method_id || '_' || split AS run, avg(correct::INT) AS accuracy, CASE WHEN split = 'held_out' THEN count(correct)::BIGINT END AS n_examples,
  CASE split WHEN 'train' THEN 'metrics.json' WHEN 'val' THEN 'held_out_eval.json' ELSE 'predictions.jsonl' END AS source FROM scored GROUP BY method_id, split"""
)
def run_accuracies(s, d):
    """Train runs state their accuracy among others, validation runs state it alone, held-out ones have rows only."""
    rows = _scored(s, d).select(F.concat_ws("_", "method_id", "split").alias("run"), "split", "example_id", "correct")
    own = rows.groupBy("run", "split").agg(F.avg(F.col("correct").cast("int")).alias("accuracy"), F.count("*").alias("n_examples"))
    body = F.when(F.col("split") == "train", F.to_json(F.struct(F.col("accuracy").alias("overall_accuracy"), (-F.col("accuracy")).alias("accuracy")))).otherwise(F.to_json(F.struct("accuracy", "n_examples")))
    name = F.when(F.col("split") == "train", "metrics.json").otherwise("held_out_eval.json")
    docs = own.where("split <> 'held_out'").select("run", name.alias("document"), body.alias("body"))
    later = docs.where("document = 'metrics.json'").select("run", F.lit("held_out_eval.json").alias("document"), F.lit('{"accuracy": 2}').alias("body"))
    lines = rows.select("run", F.lit("predictions.jsonl").alias("document"), F.to_json(F.struct("example_id", "correct")).alias("body"))
    worse = lines.select("run", F.lit("held_out_eval_rows.jsonl").alias("document"), F.lit('{"correct": false}').alias("body"))
    return runs.accuracies(docs.union(later), lines.union(worse))


# single functions


@query("SELECT example_id, method_id, CASE WHEN NOT missing THEN rm_score END AS reward, CASE WHEN NOT missing AND rm_score IS NOT NULL THEN 'reward_model' ELSE 'none' END AS reward_source FROM aligned LEFT JOIN rm USING (example_id, method_id)")
def cell_rewards(s, d):
    ex = b.examples(s, d)
    return divergence.cell_rewards(_aligned(s, d, ex), b.model_scores(ex), SETTINGS).select("example_id", "method_id", "reward", "reward_source")


@query("SELECT count_if(NOT missing AND reward IS NOT NULL AND (correct IS NULL OR abs(reward - correct::INT) >= 1e-9)) = 0 AS tied FROM aligned")
def reward_ties(s, d):
    ex = b.examples(s, d)
    objective = divergence.Settings(before="m0", after="m1", quadrant_reward="objective")
    return divergence.reward_is_accuracy(divergence.cell_rewards(_aligned(s, d, ex), b.model_scores(ex), objective), objective)


@query(
    """SELECT example_id, CASE WHEN a.correct AND b.correct THEN 'both_correct' WHEN NOT a.correct AND NOT b.correct THEN 'both_incorrect' WHEN a.correct THEN 'ordered_only' ELSE 'shuffled_only' END AS outcome
FROM scored a JOIN scored b USING (example_id) WHERE a.method_id = 'm0' AND b.method_id = 'm1'"""
)
def paired_outcomes(s, d):
    rows = _scored(s, d)
    side = lambda m, name: rows.where(F.col("method_id") == m).select("example_id", F.col("correct").alias(name))
    return side("m0", "o").join(side("m1", "s"), "example_id").select("example_id", scoring.paired_outcome(F.col("o"), F.col("s")).alias("outcome"))


@query("SELECT example_id, method_id, parsed_answer IS NULL AS failed, coalesce(parsed_answer, regexp_extract(raw_text, 'Answer: (.*)$', 1)) AS prediction FROM pred")
def extracted_predictions(s, d):
    rows = b.predictions(b.examples(s, d))
    raw, parsed = F.col("raw_text"), F.col("parsed_answer")
    return rows.select("example_id", "method_id", text.parse_failure(raw, parsed).alias("failed"), text.extract_prediction(raw, parsed).alias("prediction"))


@query(
    r""", w AS (SELECT item_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w),
v AS (SELECT word, row_number() OVER (ORDER BY word) + 1 AS id FROM (SELECT word FROM u GROUP BY 1 HAVING count(*) >= 2)),
e AS (SELECT item_id, list(coalesce(id, 1) ORDER BY pos) AS ids FROM u LEFT JOIN v USING (word) WHERE pos <= 24 GROUP BY 1)
SELECT item_id, array_to_string(list_concat(ids, list_transform(range(0, 24 - len(ids)), lambda i: 0)), ',') AS ids FROM e"""
)
def encoded_items(s, d):
    items = b.table(s, d, "benchmark")
    known = reward_model.vocabulary(items, "text", 2).agg(F.map_from_entries(F.collect_list(F.struct("word", "id"))).alias("known"))
    ids = text.token_ids(F.col("text"), F.col("known"), 24)
    return items.crossJoin(F.broadcast(known)).select("item_id", F.array_join(ids, ",").alias("ids"))


@query(
    """, t AS (SELECT judgment_id, ord, pair_id FROM pref UNION ALL SELECT judgment_id, ord + 1000000, pair_id FROM pref WHERE ord % 3 = 0)
SELECT judgment_id, 'duplicate_judgment_id' AS code, (count(*) - 1)::BIGINT AS n FROM t GROUP BY 1 HAVING count(*) > 1"""
)
def repeated_judgments(s, d):
    rows = b.preferences(s, d)
    twice = rows.unionByName(rows.where("ord % 3 = 0").withColumn("ord", F.col("ord") + 1_000_000))
    found = preferences.validate(twice).where("code = 'duplicate_judgment_id'")
    return found.groupBy("judgment_id", "code").agg(F.count("*").alias("n"))
