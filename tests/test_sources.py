"""Scans, sinks, streams and experiments on small files."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.plans import dispatch, inference, report
from tessera.sources import jsonl, schemas, sinks
from tessera.streaming import judgments


def example(**change):
    row = {
        "example_id": "e1", "clip_id": "c1", "trick_id": "t1", "performer_id": "p1", "camera_id": "k1", "video": {"path": "v/c1.mp4", "fps": 30.0, "num_frames": 60, "duration_s": 2.0},
        "question": "Which hand?", "ground_truth": "left", "split": "held_out", "provenance": {"source": "own"},
    }
    return row | change


def write(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


def test_permissive_scan_loses_nothing(spark, tmp_path):
    rows = [example(), "", "not json", {"not": "an example"}, example(example_id="e2", answer="right", ground_truth=None), example(example_id="e3", split="test"), '{"example_id": 5', example(example_id="e4", video={"path": "x", "fps": -1.0})]
    del rows[4]["ground_truth"]
    path = write(tmp_path / "m.jsonl", rows)
    good, bad = jsonl.permissive(jsonl.examples(spark, path))
    assert {r.example_id: r.ground_truth for r in good.collect()} == {"e1": "left", "e2": "right"}
    assert {r.line_no: r.error for r in bad.collect()} == {3: "not a JSON object", 4: "example_id is missing", 6: "split is unknown", 7: "not a JSON object", 8: "video.fps is not positive"}
    with pytest.raises(Exception, match=r"m.jsonl:\d+: "):
        jsonl.strict(jsonl.examples(spark, path)).collect()


def test_null_gold_hides_the_legacy_name(spark, tmp_path):
    path = write(tmp_path / "m.jsonl", [example(ground_truth=None, answer="left", task="explanation")])
    assert jsonl.strict(jsonl.examples(spark, path)).first().ground_truth is None


def test_line_numbers_over_many_blocks(spark, tmp_path):
    path = write(tmp_path / "big.txt", [f"line {i}" for i in range(1, 5001)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r.line_no: r.text for r in jsonl.lines(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: f"line {i}" for i in range(1, 5001)}


def test_preferences_in_both_layouts(spark, tmp_path):
    flat = {"pair_id": "p", "judgment_id": "j1", "clip_id": "c", "question": "why", "response_a": "x", "response_b": "y", "annotator_id": "a", "winner": "a"}
    nested = {k: v for k, v in flat.items() if k not in ("annotator_id", "winner")} | {"judgment_id": "j2", "annotation": {"annotator_id": "b", "winner": "tie", "allow_ties": True}}
    path = write(tmp_path / "p.jsonl", [flat, nested, flat | {"winner": "tie"}, "oops"])
    good, bad = jsonl.permissive(jsonl.preferences(spark, path))
    assert {r.judgment_id: (r.winner, r.instruction, r.split, r.task) for r in good.collect()} == {"j1": ("a", "why", "train", "explanation"), "j2": ("tie", "why", "train", "explanation")}
    assert {r.line_no: r.error for r in bad.collect()} == {3: "ties are not allowed", 4: "not a JSON object"}
    assert dispatch.preference_quality(spark, path)[1].count() == 2


def test_optional_and_keyed_tables(spark, tmp_path):
    assert jsonl.optional_table(spark, str(tmp_path / "none.jsonl"), schemas.RM_SCORE).count() == 0
    path = write(tmp_path / "s.jsonl", [{"example_id": "e", "method_id": "m", "rm_score": 0.1}, {"example_id": "e", "method_id": "m", "rm_score": 0.9}])
    assert [r.rm_score for r in jsonl.keyed_table(spark, path, schemas.RM_SCORE, "rm_score").collect()] == [0.9]
    twice = write(tmp_path / "twice.jsonl", [{"example_id": "e"}, {"example_id": "e"}])
    with pytest.raises(ValueError, match="more than once"):
        jsonl.predictions(spark, twice, "m")
    assert report.read_document(spark, write(tmp_path / "d.json", ["[1]"])) is None
    assert report.read_document(spark, write(tmp_path / "d2.json", [{"a": {"b": 1}}])) == {"a": {"b": 1}}
    (tmp_path / "media").mkdir()
    (tmp_path / "media/a.mp4").write_bytes(b"x")
    (tmp_path / "media/b.mp4").write_bytes(b"")
    assert jsonl.count_media(spark, str(tmp_path / "media")) == 1


def test_runs_are_never_overwritten(spark, tmp_path):
    where = sinks.run_directory(spark, str(tmp_path), "r1")
    sinks.write_json(spark, f"{where}/x.json", {"b": 1, "a": None})
    assert json.loads((tmp_path / "r1/x.json").read_text()) == {"a": None, "b": 1}
    with pytest.raises(FileExistsError):
        sinks.run_directory(spark, str(tmp_path), "r1")
    with pytest.raises(ValueError):
        sinks.run_directory(spark, str(tmp_path), " ")
    sinks.mark_immutable(spark, where)
    with pytest.raises(ValueError):
        sinks.protect_baseline(spark, None, where)
    rows = spark.createDataFrame([(True, None), (False, "x")], "correct boolean, note string")
    paths = sinks.fan_out(rows, where, sinks.ANALYSIS_PARTS)
    assert {n: spark.read.text(p).count() for n, p in paths.items()} == {"inspectable": 2, "errors": 1, "successes": 1}
    assert sinks.make_run_id("a b/") .endswith("Z_a-b")


def test_judgment_store(spark, tmp_path):
    store = str(tmp_path / "store")
    j = spark.createDataFrame([("j1", "a", "p1", 1), ("j1", "a", "p2", 2), ("j2", "a", "p1", 3), ("j3", "b", "p1", 4)], "judgment_id string, annotator_id string, pair_id string, ord int")
    assert sinks.append_judgments(j, store) == 2
    assert sinks.append_judgments(j, store) == 0
    assert sorted(r.judgment_id for r in spark.read.parquet(store).collect()) == ["j1", "j3"]


def test_streams(spark, tmp_path):
    schema = "judgment_id string, annotator_id string, pair_id string, ord int, ts timestamp, reward double, parse_failed boolean"
    rows = spark.createDataFrame([("j1", "a", "p1", 1, 0.5, False), ("j1", "a", "p1", 2, 1.0, False), ("j2", "b", "p1", 3, 0.0, True)], "judgment_id string, annotator_id string, pair_id string, ord int, reward double, parse_failed boolean")
    rows.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("ord"))).select("judgment_id", "annotator_id", "pair_id", "ord", "ts", "reward", "parse_failed").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart adds nothing
        judgments.log_judgments(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    judgments.log_rollouts(judgments.deduplicated(stream), str(tmp_path / "once"), str(tmp_path / "cp2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "once")).count() == 2
    q = judgments.rollout_metrics(stream).writeStream.outputMode("complete").format("memory").queryName("metrics").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("metrics").first().n == 3


def test_experiments(spark, tmp_path):
    rows = [example(example_id=f"e{i}", clip_id=f"c{i}", ground_truth=g, split="held_out" if i < 4 else "train") for i, g in enumerate(("center", "right", "left", "center", "left"))]
    manifest = write(tmp_path / "m.jsonl", rows)
    before = write(tmp_path / "b.jsonl", [{"example_id": f"e{i}", "raw_text": r["ground_truth"], "parsed_answer": r["ground_truth"], "ground_truth": r["ground_truth"], "correct": True} for i, r in enumerate(rows[:4])])
    after = write(tmp_path / "a.jsonl", [{"example_id": f"e{i}", "raw_text": "up", "parsed_answer": "up", "ground_truth": r["ground_truth"], "matched": False} for i, r in enumerate(rows[:4])])
    methods = [{"method_id": "before", "predictions_path": before}, {"method_id": "after", "predictions_path": after}]
    done = dispatch.run(spark, {"methods": methods, "protocol": {"manifest": manifest}, "reference_method_id": "before", "output_dir": str(tmp_path / "runs")}, "cmp")
    acc = {m["method_id"]: m["accuracy"] for m in done.report["methods"]}
    assert acc == {"before": 1.0, "after": 0.0} and done.report["deltas"][0]["accuracy_delta"] == -1.0
    assert report.detect_kind(spark, done.run_dir) == "comparison"
    scores = write(tmp_path / "rm.jsonl", [{"example_id": f"e{i}", "method_id": m, "rm_score": 0.2 if m == "before" else 0.9} for i in range(4) for m in ("before", "after")])
    config = {"manifest": manifest, "before": methods[0], "after": methods[1], "quadrant_reward": "rm", "rm_scores_path": scores, "reward_high_abs": 0.8, "reward_low_abs": 0.4, "output_dir": str(tmp_path / "runs")}
    hack = dispatch.run(spark, config, "rh")
    assert hack.report["summary"]["n_high_reward_low_accuracy"] == 4
    assert len((tmp_path / "runs/rh/high_reward_low_accuracy/_SUCCESS").read_bytes()) == 0
    base = dispatch.run(spark, {"experiment_type": "baseline", "manifest": manifest, "output_dir": str(tmp_path / "runs")}, "base", lambda p, f: ["Answer: center"] * len(p))
    assert base.report["evaluation"]["overall_accuracy"] == 0.5
    with pytest.raises(FileExistsError):
        dispatch.run(spark, {"experiment_type": "baseline", "manifest": manifest, "output_dir": str(tmp_path / "runs")}, "base")
    shuffled = dispatch.run(spark, {"experiment_type": "temporal_shuffle", "manifest": manifest, "output_dir": str(tmp_path / "runs"), "shuffle_seed": 7}, "ts")
    assert shuffled.report["temporal"]["n_pairs"] == 4
    with pytest.raises(Exception, match="lacks locked example"):
        dispatch.run(spark, {"methods": [methods[0], {"method_id": "x", "predictions_path": write(tmp_path / "x.jsonl", [{"example_id": "e0", "raw_text": "a"}])}], "protocol": {"manifest": manifest}, "output_dir": str(tmp_path / "runs")}, "bad")
    assert json.loads((tmp_path / "runs/bad/dispatch_status.json").read_text())["status"] == "failed"
    found, verdict = dispatch.validate_manifest(spark, manifest)
    assert not verdict.first().passed and "leakage_trick_id" in {r.code for r in found.collect()}
    assert [r.code for r in dispatch.validate_manifest(spark, str(tmp_path / "none"))[0].collect()] == ["manifest_missing"]


def test_types_are_inferred():
    assert dispatch.experiment_type({"prefs_path": 1, "beta": 1, "model_id": 1}) == "dpo"
    assert dispatch.experiment_type({"prefs_path": 1, "embedding_dim": 1}) == "reward_model"
    assert dispatch.experiment_type({"name": "temporal_shuffle_x"}) == "temporal_shuffle"
    with pytest.raises(dispatch.DispatchError):
        dispatch.experiment_type({"experiment_type": "nope"})
    with pytest.raises(dispatch.DispatchError):
        dispatch.experiment_type({})


def test_model_errors_stay_with_their_row(spark):
    ex = spark.createDataFrame([("e1", "ok?", 8), ("e2", "bad?", None)], "example_id string, question string, num_frames int")

    def generate(prompts, frames):
        if any("bad" in p for p in prompts):
            raise ValueError("no")
        return ["x"] * len(prompts)

    got = {r.example_id: (r.raw_text, r.error) for r in inference.run(inference.prepared(ex), generate).collect()}
    assert got == {"e1": ("x", None), "e2": ("", "ValueError: no")}
    with pytest.raises(Exception, match="no"):
        inference.run(inference.prepared(ex), generate, continue_on_error=False).collect()


def test_reports_do_not_overclaim():
    with pytest.raises(ValueError):
        report.check_claims({"x": "This proves  reward hacking"})
    built = report.build({"metrics.json": {"accuracy": 0.5}}, "baseline")
    assert built["evaluation"] == {"accuracy": 0.5} and built["training"] == report.UNAVAILABLE
    assert "| accuracy | 0.5000 |" in report.markdown("run", built)
    assert report.overall_status({"a": "pass", "b": "warn"}) == {"overall": "warn", "counts": {"pass": 1, "warn": 1}}


def test_presence_of_keys_is_decided_row_by_row(spark, tmp_path):
    from tessera.operators.align import normalized_predictions

    base = {"raw_text": "Answer: good", "parsed_answer": "good", "ground_truth": "good"}
    rows = [
        {**base, "correct": False}, {**base, "correct": None}, {**base, "matched": True, "parse_failed": True}, base, {**base, "parsed_answer": None, "raw_text": ""},
        {**base, "parse_failed": True}, {**base, "correct": True, "matched": False, "reward": 0.25}, {"raw_text": "x", "parsed_answer": "x"},
    ]
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps({"example_id": f"e{i}", **r}) for i, r in enumerate(rows)))
    got = {r.example_id: (r.correct, r.parse_failed, r.reward) for r in normalized_predictions(jsonl.predictions(spark, f"{tmp_path}/p.jsonl", "m")).collect()}
    assert [got[f"e{i}"] for i in range(8)] == [
        (False, False, 0.0), (False, False, 0.0), (True, True, 1.0), (True, False, 1.0), (False, True, 0.0), (False, True, 0.0), (True, False, 0.25), (None, False, None),
    ]


def test_keyed_table_refuses_broken_lines(spark, tmp_path):
    for bad in ('{"example_id": "a"', '{"example_id": "a", "rm_score": 1.0}'):
        (tmp_path / "k.jsonl").write_text('{"example_id": "a", "method_id": "m", "rm_score": 1.0}\n' + bad)
        with pytest.raises(Exception, match="k.jsonl:2"):
            jsonl.keyed_table(spark, f"{tmp_path}/k.jsonl", "example_id string, method_id string, rm_score double", "rm_score").collect()
