"""Tables of run folders against plain loops over the same files."""

import json
import random

import pytest

from tessera.plans import runs

NOTHING = (None, "", 0, False, {}, [])


def made(r, root):
    """A folder of runs with documents that hold a random part of what a report looks for."""
    some = lambda d: {k: v for k, v in d.items() if r.random() < 0.6}
    kinds = {"grpo": "grpo_train_records.jsonl", "dpo": "dpo_train_records.jsonl", "baseline": "predictions.jsonl", "reward_model": "checkpoint_best.pt", "temporal": "temporal_shuffle_summary.json"}
    out = {}
    for i, (kind, mark) in enumerate(kinds.items()):
        if r.random() < 0.3:
            continue
        where = root / f"run {i}"
        where.mkdir(parents=True)
        (where / mark).write_text('{"x": 1}\n')
        docs = {"train_metadata.json": some({"base_checkpoint": r.choice(["", "c1"]), "base_model_id": "m1", "hardware": {"device": "cpu"}, "seed": r.choice([None, 0, 5]), "manifest": r.choice(["", "a.jsonl"]), "dataset_version": r.choice([None, "v1"])})}
        docs["config.json"] = some({"model_id": r.choice([None, "m2"]), "model": {"model_id": "m3"}, "seed": 9})
        docs["run_metadata.json"] = some({"identity": {"model_id": "m4"}})
        docs["stack_probe.json"] = some({"gpu": "none"})
        if kind == "reward_model":
            docs["train_metadata.json"]["epochs"] = 1
        held = {k: v for k, v in docs.items() if r.random() < 0.8 or (kind == "reward_model" and k == "train_metadata.json")}
        for name, body in held.items():
            (where / name).write_text(json.dumps(body))
        if r.random() < 0.3:
            (where / "broken.json").write_text("{no")
        (where / "deep").mkdir()
        (where / "deep" / "config.json").write_text('{"model_id": "wrong"}')
        out[where.name] = (kind, {k: v for k, v in held.items() if v})
    return out


def looked_up(all_runs):
    out = {}
    for w in runs.VALUES:
        found = None
        for kind in w.kinds:
            for name, (k, docs) in sorted(all_runs.items()):
                if k != kind or found or not any(d in docs for d, _ in w.sources):
                    continue
                for d, path in w.sources:
                    at = docs.get(d)
                    for step in path.split(".")[1:]:
                        at = at.get(step) if isinstance(at, dict) else None
                    if found is None and (at not in NOTHING if w.truthy else at is not None):
                        found = (at, kind, name, d)
                if w.one_run:
                    found = found or ()
        if found:
            out[w.name] = found
    return out


@pytest.mark.parametrize("seed", range(4))
def test_values_equal_plain_lookup(spark, tmp_path, seed):
    all_runs = made(random.Random(seed), tmp_path)
    docs = runs.documents(spark, str(tmp_path))
    kinds = runs.kinds(runs.files(spark, str(tmp_path)), docs)
    assert {r["run"]: r["kind"] for r in kinds.collect()} == {k: v[0] for k, v in all_runs.items()}
    read = lambda x: json.loads(x) if x[:1] in "{[" else x
    got = {r["field"]: (read(r["value"]), r["kind"], r["run"], r["document"]) for r in runs.values(docs, kinds).collect()}
    assert got == {k: ((v[0] if isinstance(v[0], dict) else str(v[0])), *v[1:]) for k, v in looked_up(all_runs).items()}
    entries = {(r["run"], r["document"], r["field"]) for r in runs.fields(docs).collect()}
    assert {e for e in entries if e[1] != "temporal_shuffle_summary.json"} == {(n, d, k) for n, (_, held) in all_runs.items() for d, body in held.items() for k in body}


def test_accuracies(spark, tmp_path):
    def run(name, **files):
        (tmp_path / name).mkdir()
        for k, v in files.items():
            (tmp_path / name / k.replace("__", ".")).write_text(v)

    lines = lambda *x: "\n".join(json.dumps(v) for v in x) + "\n\n"
    run("a", metrics__json='{"overall_accuracy": 0.25, "accuracy": 0.5}', held_out_eval__json='{"accuracy": 0.9}')
    run("b", metrics__json="{}", held_out_eval__json='{"accuracy": 0.9}', predictions__jsonl=lines({"correct": True}))
    run("c", predictions__jsonl=lines({"correct": True}, {"correct": False}, {"correct": None}, {"matched": True}), held_out_eval_rows__jsonl=lines({"correct": False}))
    run("d", aligned_examples__jsonl=lines({"methods": {"z": {"missing": True, "correct": False}, "m": {"missing": False, "correct": True}, "a": {"correct": False}}}), predictions__jsonl=lines({"correct": False}))
    run("e", examples_inspectable__jsonl=lines({"before": {"correct": True}, "after": {"correct": False}}, {"before": {}, "after": {}}))
    run("f", config__json="{}", predictions__jsonl=lines({"x": 1}))
    run("g", metrics__json='{"overall_accuracy": null, "accuracy": 0.5}', predictions__jsonl=lines({"correct": True}))
    got = {r["run"]: (r["accuracy"], r["n_examples"], r["source"]) for r in runs.accuracies(runs.documents(spark, str(tmp_path)), runs.rows(spark, str(tmp_path))).collect()}
    assert got == {"a": (0.25, None, "metrics.json"), "b": (0.9, None, "held_out_eval.json"), "c": (2 / 3, 3, "predictions.jsonl"), "d": (1.0, 1, "aligned_examples.jsonl"), "e": (0.0, 1, "examples_inspectable.jsonl")}
