"""Operators against hand-calculated tables."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import align, analysis, divergence, eligibility, guards, preferences, reward_model, selection, validation

EX = "example_id string, ord int, clip_id string, trick_id string, performer_id string, camera_id string, prop_id string, question_variant string, video_path string, content_hash string, duration_s double, fps double, num_frames int, task string, question string, ground_truth string, split string"


def examples(spark, *changes):
    base = {
        "example_id": "e", "ord": 0, "clip_id": "c", "trick_id": "t", "performer_id": "p", "camera_id": "k", "prop_id": None, "question_variant": None, "video_path": "v.mp4",
        "content_hash": None, "duration_s": 2.0, "fps": 30.0, "num_frames": 60, "task": "hidden_state", "question": "where?", "ground_truth": "left", "split": "train",
    }
    rows = [tuple((base | {"ord": i, "example_id": f"e{i}"} | c).values()) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, EX)


def codes(df):
    return sorted(r.code for r in df.collect())


def test_five_row_analysis(spark):
    rows = spark.createDataFrame(
        [("e0", 0, "cups_a", "A", "left", "left", "left"), ("e1", 1, "cups_a", "B", "left", "right", "right"), ("e2", 2, "cups_a", "B", "left", None, ""), ("e3", 3, "cups_b", "A", "right", "left", "left"), ("e4", 4, "cups_b", "B", "center", "center", "center")],
        "example_id string, ord int, trick_id string, performer_id string, ground_truth string, parsed_answer string, raw_text string",
    )
    scored = analysis.scored(rows).withColumn("latency_s", F.lit(1.0)).withColumn("split", F.lit("held_out"))
    s = analysis.run_summary(scored).first()
    assert (s.overall_accuracy, s.parse_failure_rate, s.n_examples) == (0.4, 0.2, 5)
    stats = {r.key: r.accuracy for r in align.group_stats(scored, "trick_id").collect()}
    assert stats == {"cups_a": pytest.approx(1 / 3), "cups_b": 0.5}
    d = analysis.distribution_summary(scored).first()
    assert (d.majority_label, d.majority_count, d.majority_fraction) == ("left", 3, 0.6)
    check = analysis.integrity(scored).first()
    assert check.groups_match and check.counts_match
    tags = analysis.diagnostic_tags(F.col("correct"), F.col("parse_failed"), F.col("raw_text"), F.col("parsed_answer"), F.lit(None).cast("string"), F.lit("indices_only"), F.lit("left"), F.lit("label unclear"))
    got = {r.example_id: r.t for r in scored.select("example_id", tags.alias("t")).collect()}
    assert got["e0"] == ["correct"]
    assert got["e2"] == ["empty_raw_response", "parse_failure", "visual_input_missing", "ambiguity_or_task_design_note"]
    assert got["e3"] == ["wrong_label", "visual_input_missing", "possible_answer_frequency_shortcut", "ambiguity_or_task_design_note"]
    assert analysis.score_summary(scored.limit(0)).first().accuracy == 0.0
    assert analysis.accuracy_by_split(scored.limit(0)).first().accuracy is None


def test_alignment_keeps_missing_cells(spark):
    ex = examples(spark, {"split": "held_out"}, {"split": "held_out", "trick_id": "new"}, {"split": "train", "trick_id": "t"})
    preds = spark.createDataFrame([("e0", "a", "left", "left"), ("e0", "b", "x", "right"), ("e1", "b", "left", "left"), ("e9", "b", "q", "q")], "example_id string, method_id string, raw_text string, parsed_answer string")
    lock = align.axis_flags(align.locked(ex), align.seen_values(ex))
    aligned = align.align(lock, spark.createDataFrame([("a",), ("b",)], "method_id string"), preds)
    m = {r.method_id: r for r in align.method_metrics(aligned).collect()}
    assert (m["a"].n_scored, m["a"].n_missing, m["a"].accuracy) == (1, 1, 1.0)
    assert (m["b"].n_scored, m["b"].accuracy) == (2, 0.5)
    d = align.deltas(align.method_metrics(aligned), "a").first()
    assert (d.method_id, d.accuracy_delta, d.mean_reward_delta) == ("b", -0.5, None)  # no gold in the source, so no reward
    assert [tuple(r) for r in align.missing_ids(aligned).collect()] == [("a", "e1")]
    assert [tuple(r) for r in align.extra_ids(lock, preds).collect()] == [("b", "e9")]
    s = {(r.slice, r.method_id): r.n for r in align.slice_accuracy(aligned).collect()}
    assert s == {("all_locked", "a"): 1, ("all_locked", "b"): 2, ("unseen_trick", "b"): 1}
    assert len(align.nested(aligned).first().methods) == 2
    with pytest.raises(Exception, match="lacks locked example"):
        align.require_full_coverage(aligned).collect()


def test_positional_join_needs_equal_order(spark):
    ex = examples(spark, {}, {})
    preds = spark.createDataFrame([("e0", 0, True), ("e1", 1, False)], "example_id string, ord int, correct boolean")
    assert analysis.positional(ex, preds, preds).count() == 2
    swapped = spark.createDataFrame([("e1", 0, True), ("e0", 1, False)], "example_id string, ord int, correct boolean")
    for bad in (swapped, preds.limit(1)):
        with pytest.raises(Exception, match="rows differ at position"):
            analysis.positional(ex, preds, bad).collect()


def test_prediction_columns_count_as_given_when_there(spark):
    with_null = spark.createDataFrame([("e", "m", "x", "x", "x", None)], "example_id string, method_id string, raw_text string, parsed_answer string, ground_truth string, correct boolean")
    assert align.normalized_predictions(with_null).first().correct is False
    assert align.normalized_predictions(with_null.drop("correct")).first().correct is True
    assert align.normalized_predictions(with_null.drop("correct", "ground_truth")).first().correct is None


def test_validation_rules(spark):
    assert codes(validation.duplicate_ids(examples(spark, {"example_id": "x"}, {"example_id": "x"}))) == ["duplicate_example_id"]
    golds = examples(spark, {"ground_truth": None}, {"ground_truth": "  "}, {"ground_truth": "up"}, {"ground_truth": " left"}, {"ground_truth": None, "task": "explanation"})
    assert codes(validation.ground_truth(golds, ("left", " left"))) == ["ground_truth_peripheral_whitespace", "invalid_answer_not_in_vocab", "invalid_ground_truth_whitespace", "missing_ground_truth"]
    clips = examples(spark, {}, {"trick_id": "z", "split": "val", "ground_truth": None})
    assert codes(validation.clip_consistency(clips)) == ["inconsistent_clip_ground_truth", "inconsistent_clip_metadata", "inconsistent_clip_path_or_split"]
    assert codes(validation.duplicate_video_path(examples(spark, {}, {"clip_id": "d"}))) == ["duplicate_video_path"]
    fps = examples(spark, {"fps": None}, {"fps": 500.0}, {"fps": 25.0}, {"duration_s": 9.0})
    assert codes(validation.fps_and_spans(fps, 30.0)) == ["fps_deviates_from_expected", "fps_deviates_from_expected", "fps_duration_inconsistency", "fps_duration_inconsistency", "missing_fps", "unexpected_fps"]
    assert codes(validation.shared_content_hash(examples(spark, {"content_hash": "h"}, {"content_hash": "h", "clip_id": "d"}))) == ["near_duplicate_content_hash"]
    assert codes(validation.duplicate_questions(examples(spark, {"question": " Where? "}, {"question": "where?"}))) == ["duplicate_question_phrasing"]
    assert codes(validation.dense_combos(examples(spark, *[{"clip_id": f"c{i}"} for i in range(4)]))) == ["repeated_trick_performer_combo"]
    leak = examples(spark, {}, {"split": "held_out", "clip_id": "d", "video_path": "w.mp4", "performer_id": "q"})
    assert codes(validation.split_leakage(leak)) == ["leakage_trick_id"]
    assert codes(validation.split_presence(examples(spark, {}))) == ["no_held_out_split"]
    assert codes(validation.split_presence(examples(spark, {"split": "held_out"}))) == ["only_held_out_present"]
    assert [tuple(r)[1:3] for r in validation.first_violation(examples(spark, {}, {"video_path": "w"}, {"split": "val"})).collect()] == [("manifest_integrity", "c")]
    files = spark.createDataFrame([("v.mp4", 0)], "path string, length bigint")
    assert codes(validation.media(examples(spark, {}, {"video_path": "gone"}), files)) == ["missing_video", "unreadable_video_empty"]
    clean = examples(spark, {}, {"split": "held_out", "clip_id": "d", "trick_id": "u", "performer_id": "q", "video_path": "w.mp4"})
    assert validation.report(clean, validation.findings(clean)).first().passed
    assert not validation.report(leak, validation.findings(leak)).first().passed
    assert validation.report(leak, validation.findings(leak), fail_on_leakage=False).first().passed
    empty = examples(spark, {}).limit(0)
    assert validation.findings(empty).count() == 0


def test_findings_are_ordered_by_severity_code_and_subject(spark):
    rows = [("review", "a", "1"), ("error", "z", "2"), ("leakage", "b", "3"), ("error", "a", "9"), ("error", "a", "1")]
    found = spark.createDataFrame(rows, "severity string, code string, subject string").repartition(3)
    assert [tuple(r) for r in validation.ordered(found).collect()] == [("error", "a", "1"), ("error", "a", "9"), ("error", "z", "2"), ("leakage", "b", "3"), ("review", "a", "1")]


PAIR = "judgment_id string, pair_id string, ord int, clip_id string, example_id string, instruction string, response_a string, response_b string, winner string, annotator_id string, task string, split string"


def pairs(spark):
    """13 judgments on 11 contents: one contradicted, one unanimous, long and confident winners, one identical pair."""
    long, short = "x" * 200, "y" * 4
    rows = [("c1", "p q", "r s", "a", "ann1"), ("c1", "p q", "r s", "b", "ann2"), ("c2", "m", "n", "a", "ann1"), ("c2", "m", "n", "a", "ann2")]
    rows += [(f"c{i}", long + str(i), short + str(i), "a", "ann1") for i in (3, 4, 5)]
    rows += [("c6", "clearly it is 6", "it is 6", "a", "ann1"), ("c7", "obviously it is 7", "it is 7", "a", "ann1"), ("c8", "same", "same", "a", "ann1")]
    rows += [("c9", "u", "w", "a", "ann1"), ("c10", "k", "l", "b", "ann1"), ("c11", "g", "h", "a", "ann1")]
    df = spark.createDataFrame([(f"j{i}", "?", i, c, None, "why", a, b, w, n, "explanation", "train") for i, (c, a, b, w, n) in enumerate(rows)], PAIR)
    return df.withColumn("pair_id", preferences.expected_pair_id())


def test_thirteen_judgments(spark):
    p = pairs(spark)
    w = preferences.winner_balance(p).first()
    assert (w.n_a, w.n_b, w.abs_imbalance, w.balanced) == (11, 2, 9, False)
    g = preferences.agreement(p).first()
    assert (g.n_unique_pairs, g.n_repeated, g.n_contradictory, g.agreement_rate, g.n_annotators) == (11, 2, 1, 0.5, 2)
    found = {r.code for r in preferences.quality_findings(p, 2).collect()}
    assert {"malformed_records", "winner_imbalance", "duplicate_pair_ids", "contradictory_labels", "identical_responses_within_pair", "repeated_judgment_disagreement"} <= found
    assert "pair_id_mismatch" not in found
    assert preferences.dpo_rows(p).count() == 13 and preferences.comparison_rows(p).where("label = -1").count() == 2
    v = {r.code for r in preferences.validate(p).collect()}
    assert v == {"identical_responses", "multiple_annotations", "annotator_disagreement"}
    strict = preferences.Policy(allow_ties=False, require_rationale=True, allow_multiple_annotations=False)
    again = p.withColumn("rationale", F.lit(" ")).withColumn("winner", F.when(F.col("judgment_id") == "j3", "tie").otherwise(F.col("winner")))
    v = {r.code for r in preferences.validate(again.union(again.where("judgment_id = 'j0'")), strict).collect()}
    assert {"missing_rationale", "tie_not_allowed", "duplicate_judgment_id", "duplicate_pair_id"} <= v
    assert not preferences.passes(preferences.validate(p)).first().passed


def test_length_and_format_bias(spark):
    p = pairs(spark)
    long = preferences.length_stats(p.where("clip_id in ('c3', 'c4', 'c5')")).first()
    assert (long.n, long.frac_longer, long.mean_delta) == (3, 1.0, 196.0)
    f = preferences.format_stats(p).first()
    assert (f.n_confidence_differs, f.n_prefer_confidence, f.frac_confidence, f.frac_markdown) == (2, 2, 1.0, None)
    assert preferences.length_stats(p.limit(0)).first().mean_chars_a is None


def test_training_rows_refuse_held_out(spark):
    p = pairs(spark).withColumn("split", F.lit("held_out"))
    with pytest.raises(Exception, match="held-out"):
        preferences.trainer_rows(p).collect()
    assert preferences.trainer_rows(p, allow_held_out=True).count() == 13
    rows = spark.createDataFrame([("val",), ("other",)], "split string")
    assert preferences.train_and_validation(rows, True)[0].count() == 1
    with pytest.raises(ValueError):
        preferences.train_and_validation(rows, False)
    ex = examples(spark, {"split": "held_out"}, {})
    assert guards.for_stage(ex, "baseline").count() == 2 and guards.for_stage(ex, "DPO", allow_held_out=True).count() == 1
    with pytest.raises(ValueError, match="e0"):
        guards.for_stage(ex, "grpo")
    with pytest.raises(Exception, match="no gold label"):
        guards.grpo_rows(examples(spark, {"ground_truth": " "})).collect()


def test_rollouts_without_example_score_zero(spark):
    ex = examples(spark, {})
    logs = spark.createDataFrame([("e0", "Answer: left"), ("zz", "left"), ("e0", "no")], "example_id string, completion string")
    scored = guards.rollout_rewards(logs, ex)
    assert sorted(r.reward for r in scored.collect()) == [0.0, 0.0, 1.0]
    assert analysis.reward_stats(scored).first().n_rollouts == 3


def test_queue(spark):
    q = spark.createDataFrame([("p1", 1), ("p2", 2)], "pair_id string, ord int")
    j = spark.createDataFrame([("a", "p1")], "annotator_id string, pair_id string")
    assert [r.pair_id for r in preferences.pending(q, j, "a").collect()] == ["p2"]
    assert [(r["index"], r.total) for r in preferences.queue_positions(q).collect()] == [(1, 2), (2, 2)]
    sides = spark.createDataFrame([(x,) for x in (" A", "response_b", "2", "TIE", "left")], "x string").select(preferences.judged_side(F.col("x")).alias("s"))
    assert [r.s for r in sides.collect()] == ["a", "b", "b", "tie", None]


def test_divergence(spark):
    lock = examples(spark, *[{"split": "held_out", "ground_truth": g, "camera_id": "k"} for g in ("center", "right", "left", "center")])
    rows = [(f"e{i}", "before", g, g) for i, g in enumerate(("center", "right", "left", "center"))] + [(f"e{i}", "after", "Answer: wrong", "wrong") for i in range(4)]
    preds = spark.createDataFrame(rows, "example_id string, method_id string, raw_text string, parsed_answer string")
    aligned = align.align(lock, spark.createDataFrame([("before",), ("after",)], "method_id string"), preds)
    scores = spark.createDataFrame([(f"e{i}", m, 0.2 if m == "before" else 0.95 + i / 100) for i in range(4) for m in ("before", "after")], "example_id string, method_id string, rm_score double")
    s = divergence.Settings("before", "after", high_cut=0.8, low_cut=0.4)
    cells = divergence.diagnosed(aligned, scores, lock, s)
    records = divergence.before_after(cells, s)
    one = divergence.summary(records, s).first()
    assert (one.accuracy_before, one.accuracy_after, one.n_high_reward_low_accuracy, one.claim_strength) == (1.0, 0.0, 4, "info_only")
    tags = {r.tag: r.n for r in divergence.divergence_tags(records).collect()}
    assert tags["possible_rm_accuracy_divergence"] == 8 and tags["possible_reward_up_accuracy_flat_or_down"] == 4
    assert tags["possible_parser_exploitation"] == 8
    found = codes(divergence.summary_findings(divergence.summary(records, s), s, False, False))
    assert found == ["high_reward_low_accuracy", "human_evaluation_unavailable", "possible_reward_up_accuracy_flat_or_down"]
    tied = divergence.Settings("before", "after", "objective")
    cells = divergence.cell_rewards(align.align(lock, spark.createDataFrame([("before",), ("after",)], "method_id string"), preds.withColumn("ground_truth", F.lit("center"))), scores, tied)
    assert divergence.reward_is_accuracy(cells, tied).first().tied


def test_round_robin(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("b", "4"), (None, "5")], "trick_id string, example_id string")
    got = [(r.trick_id, r.example_id) for r in selection.round_robin(rows, "trick_id", ("trick_id", "example_id"), 4).orderBy("turn").collect()]
    assert got == [(None, "5"), ("a", "1"), ("b", "4"), ("a", "2")]
    assert selection.round_robin(rows, "trick_id", ("trick_id",), 0).count() == 0


def test_eligibility(spark):
    good = '{"human_approval": "", "human_decision": "APPROVE", "answer_leakage_status": "PASS"}'
    rows = spark.createDataFrame([("c", "q", "left", "src", good), ("peerj_1", "", " ", None, '{"reveal_status": "REVEAL_PRESENT", "unresolved_leakage_warning": true}')], "clip_id string, question string, ground_truth string, provenance_source string, metadata string")
    got = {r.clip_id: r for r in eligibility.gold_errors(rows).collect()}
    assert got["c"].passed and len(got["peerj_1"].errors) == 8
    assert not eligibility.gold_manifest(eligibility.gold_errors(rows)).first().passed
    assert not eligibility.gold_manifest(eligibility.gold_errors(rows.limit(0))).first().passed
    names = spark.createDataFrame([("toy_1", "QUALIFIES"), ("peerj_2", "NOT_SUITABLE"), ("x_opaque", "QUALIFIES_WITH_HUMAN_REVIEW")], "candidate string, status string")
    stats = eligibility.inventory_stats(names.withColumn("collection", eligibility.collection(F.col("candidate"), F.lit("?"))))
    assert {r.collection: r.eligible_count for r in stats.collect()} == {"synthetic_fixtures": 1, "wikimedia_controls": 0, "peerj_documented_missing": 0}
    assert eligibility.readiness(names).first().still_needed == 4


def test_reward_model(spark):
    words = [("good answer", "bad reply", "a"), ("good text", "bad text", "a"), ("bad idea", "good idea", "b"), ("good x", "bad y", "a")] * 3
    df = spark.createDataFrame([(f"j{i}", f"p{i}", i, "c", None, "why", a, b, w, "n", "explanation", "train") for i, (a, b, w) in enumerate(words)], PAIR)
    m = reward_model.pair_metrics(reward_model.score(reward_model.train(df), df)).first()
    assert m.n_pairs == 12 and m.accuracy == 1.0 and m.mean_bt_loss < 0.69
    none = reward_model.pair_metrics(reward_model.pair_scores(spark.createDataFrame([], "reward_chosen double, reward_rejected double"))).first()
    assert none.accuracy != none.accuracy  # NaN
    vocab = reward_model.vocabulary(spark.createDataFrame([("b A a",), ("c B",)], "t string"), "t")
    assert {r.word: r.id for r in vocab.collect()} == {"a": 2, "b": 3, "c": 4}
