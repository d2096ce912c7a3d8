"""Experiments from configuration: type, checks, run folder, pipeline, documents.

A configuration is a mapping (read it from YAML or JSON). Model training is not
part of the engine; its row adapters and statistics are.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import align, analysis, divergence, embedding_reward, guards, preferences, reward_model, selection, validation
from tessera.plans import inference, report
from tessera.sources import jsonl, sinks

#: Experiment types and what each does.
TYPES = {
    "baseline": "zero-shot run on one split, scored and analysed",
    "temporal_shuffle": "ordered against shuffled frames on the same sample",
    "dpo": "chosen and rejected rows for a preference trainer",
    "grpo": "prompt rows and reward statistics for a policy trainer",
    "reward_model": "linear Bradley-Terry model on preference pairs",
    "comparison": "methods on a locked evaluation set",
    "reward_hacking": "reward against accuracy before and after training",
}


class DispatchError(ValueError):
    """A configuration that cannot be run."""


def load_config(text: str) -> dict:
    """A mapping from YAML, or from JSON where YAML is not installed."""
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:
        raw = json.loads(text)
    if not isinstance(raw, dict):
        raise DispatchError("a configuration must be a mapping")
    return raw


def fingerprint(config: dict) -> str:
    body = json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    return hashlib.sha256(body.encode()).hexdigest()[:16]


def experiment_type(c: dict) -> str:
    """The stated type, else the first whose keys are there."""
    stated = c.get("experiment_type")
    if stated not in (None, "", "null"):
        if str(stated).strip() not in TYPES:
            raise DispatchError(f"unknown experiment type {stated!r}; known: {sorted(TYPES)}")
        return str(stated).strip()
    has = lambda *keys: all(k in c for k in keys)
    signs = (
        ("dpo", has("prefs_path", "beta", "model_id")),
        ("grpo", bool(c.get("reward_id")) and has("num_generations", "model_id", "manifest")),
        ("comparison", has("methods", "protocol")),
        ("reward_hacking", has("before", "after", "quadrant_reward")),
        ("reward_model", has("prefs_path", "embedding_dim")),
        ("temporal_shuffle", c.get("stage") == "diagnostic" or str(c.get("name") or "").startswith("temporal_shuffle")),
        ("baseline", str(c.get("training_method") or "none") == "none" and has("model", "dataset")),
    )
    for kind, sign in signs:
        if sign:
            return kind
    raise DispatchError(f"set experiment_type to one of {sorted(TYPES)}")


#: Keys that each type needs.
NEEDED = {
    "baseline": ("manifest",), "temporal_shuffle": ("manifest",), "dpo": ("prefs_path",), "grpo": ("manifest",),
    "reward_model": ("prefs_path",), "comparison": ("manifest", "methods"), "reward_hacking": ("manifest", "before", "after"),
}


def check(c: dict, kind: str) -> None:
    lacking = [k for k in NEEDED[kind] if not (c.get(k) or (c.get("dataset") or {}).get(k) or (c.get("protocol") or {}).get(k))]
    if lacking:
        raise DispatchError(f"{kind}: {', '.join(lacking)} missing")
    if kind == "baseline" and str(c.get("training_method") or "none") != "none":
        raise DispatchError("a baseline has no training")
    if kind == "comparison":
        ids = [m.get("method_id") for m in c["methods"]]
        if len(set(ids)) != len(ids) or not all(ids):
            raise DispatchError("method ids must be there and unique")


def _manifest(spark: SparkSession, c: dict) -> DataFrame:
    path = c.get("manifest") or (c.get("protocol") or {}).get("manifest") or (c.get("dataset") or {}).get("manifest")
    return jsonl.flat_examples(jsonl.strict(jsonl.examples(spark, path)))


def _predictions(spark: SparkSession, methods: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Methods, and the predictions of all of them in normal form."""
    names = spark.createDataFrame([(m["method_id"],) for m in methods], "method_id string")
    out = None
    for m in methods:
        folder = m.get("run_dir")
        path = jsonl.first_existing(spark, m.get("predictions_path"), *([f"{folder}/{n}" for n in ("predictions.jsonl", "held_out_eval_rows.jsonl", "examples_inspectable.jsonl")] if folder else []))
        if path is None:
            raise DispatchError(f"method {m['method_id']!r} has no predictions")
        raw = align.normalized_predictions(jsonl.predictions(spark, path, m["method_id"]))
        gold = F.col("ground_truth") if "ground_truth" in raw.columns else F.lit(None).cast("string")
        one = raw.select("example_id", "method_id", "raw_text", "parsed_answer", "parse_failed", "correct", "reward", gold.alias("ground_truth"))
        out = one if out is None else out.unionByName(one)
    return names, out


@dataclass
class Result:
    experiment_type: str
    run_dir: str
    config_fingerprint: str
    status: str = "completed"
    report: dict = field(default_factory=dict)


def run(spark: SparkSession, config: dict, run_id: str | None = None, generate: inference.Generate = inference.echo) -> Result:
    """Check, run and write one experiment. A failure leaves its reason in the run folder and is raised."""
    kind = experiment_type(config)
    check(config, kind)
    where = sinks.run_directory(spark, sinks.output_dir(config, kind), sinks.resolve_run_id(config, run_id, kind))
    sinks.protect_baseline(spark, config.get("baseline_run_dir"), where)
    sinks.write_json(spark, f"{where}/dispatch_config.json", {"experiment_type": kind, "config": config, "fingerprint": fingerprint(config)})
    result = Result(kind, where, fingerprint(config))
    try:
        result.report = RUNNERS[kind](spark, config, where, generate)
        report.check_claims(result.report)
    except Exception as x:
        sinks.write_json(spark, f"{where}/dispatch_status.json", {"status": "failed", "error": f"{type(x).__name__}: {str(x)[:2000]}"})
        raise
    sinks.write_json(spark, f"{where}/report.json", result.report)
    sinks.write_text(spark, f"{where}/report.md", report.markdown(kind.replace("_", " "), result.report))
    sinks.write_json(spark, f"{where}/dispatch_status.json", {k: v for k, v in asdict(result).items() if k != "report"})
    return result


def _baseline(spark, c, where, generate) -> dict:
    split = str(c.get("split") or "held_out")
    ex = guards.require_rows(guards.of_split(_manifest(spark, c), split), f"{split} examples")
    rows = inference.scored(inference.run(inference.prepared(ex, int(c.get("max_frames") or 8)), generate), ex).withColumn("latency_s", F.lit(None).cast("double")).persist()
    sinks.fan_out(rows, where, sinks.ANALYSIS_PARTS)
    sinks.mark_immutable(spark, where)
    out = {"evaluation": analysis.run_summary(rows).first().asDict(), "per_trick": report.table(align.group_stats(rows, "trick_id")), "answers": report.table(analysis.label_counts(rows).drop("seen"))}
    chosen = selection.representative(rows).select("kind", "example_id", "trick_id", "correct", "parsed_answer", "ground_truth")
    return out | {"examples": report.table(chosen), "disclaimer": report.DISCLAIMER}


def _temporal(spark, c, where, generate) -> dict:
    ex = guards.of_split(_manifest(spark, c), str(c.get("split") or "held_out"))
    seed = int(c.get("shuffle_seed") or 0)

    def side(shuffle: bool) -> DataFrame:
        ready = inference.prepared(ex, int(c.get("max_frames") or 8), seed, shuffle)
        return inference.scored(inference.run(ready, generate), ex).join(ready.select("example_id", "frame_indices"), "example_id")

    pairs = analysis.temporal_pairs(side(False), side(True)).persist()
    sinks.write_rows(pairs, f"{where}/temporal_pairs")
    summary = analysis.pair_summary(pairs).first().asDict() | {"shuffle_seed": seed}
    sinks.write_json(spark, f"{where}/temporal_shuffle_summary.json", summary)
    return {"temporal": summary, "disclaimer": report.DISCLAIMER}


def _comparison(spark, c, where, generate) -> dict:
    protocol = c.get("protocol") or {}
    policies = align.protocol_report({m["method_id"]: fingerprint(m.get("generation_policy") or {}) for m in c["methods"]})
    if not policies["compatible"] and not protocol.get("allow_incompatible_protocols"):
        raise DispatchError("methods have different generation policies")
    ex = _manifest(spark, c)
    lock = guards.require_rows(align.locked(ex, protocol.get("split", "held_out"), protocol.get("task", "hidden_state")), "locked examples")
    names, preds = _predictions(spark, c["methods"])
    aligned = align.align(align.axis_flags(lock, align.seen_values(ex)), names, preds)
    if protocol.get("require_full_coverage", True):
        aligned = align.require_full_coverage(aligned)
    aligned = aligned.persist()
    sinks.write_rows(align.nested(aligned), f"{where}/aligned")
    metrics = align.method_metrics(aligned)
    out = {
        "protocol": policies, "methods": report.table(metrics), "coverage": report.table(align.coverage(aligned)), "extra": report.table(align.extra_ids(lock, preds), 20),
        "groups": report.table(align.identity_metrics(aligned), 1000), "generalization": report.table(align.slice_accuracy(aligned)),
    }
    reference = c.get("reference_method_id")
    if reference:
        if reference not in {m["method_id"] for m in c["methods"]}:
            raise DispatchError(f"the reference {reference!r} is no method")
        out["deltas"] = report.table(align.deltas(metrics, reference))
    sinks.write_json(spark, f"{where}/comparison_metrics.json", out)
    return out | {"disclaimer": report.DISCLAIMER}


def _divergence(spark, c, where, generate) -> dict:
    before, after = c["before"], c["after"]
    s = divergence.Settings(
        before["method_id"], after["method_id"], str(c.get("quadrant_reward") or "rm"), float(c.get("reward_high_quantile", 0.75)), float(c.get("reward_low_quantile", 0.25)),
        c.get("reward_high_abs"), c.get("reward_low_abs"), least_examples=int(c.get("min_n_for_aggregate_claim", 8)),
    )
    lock = guards.require_rows(align.locked(_manifest(spark, c), c.get("split", "held_out"), c.get("task", "hidden_state")), "locked examples")
    names, preds = _predictions(spark, [before, after])
    aligned = align.align(lock, names, preds)
    if c.get("require_full_coverage", True):
        aligned = align.require_full_coverage(aligned)
    from tessera.sources.schemas import HUMAN_LABEL, RM_SCORE

    scores = jsonl.keyed_table(spark, c["rm_scores_path"], RM_SCORE, "rm_score") if c.get("rm_scores_path") else spark.createDataFrame([], RM_SCORE)
    human = jsonl.keyed_table(spark, c["human_labels_path"], HUMAN_LABEL, "preferred") if c.get("human_labels_path") else None
    cells = divergence.diagnosed(aligned, scores, lock, s).persist()
    rows = divergence.before_after(cells, s, human).persist()
    sinks.fan_out(rows, where, sinks.DIVERGENCE_PARTS)
    one = divergence.summary(rows, s)
    tied = bool(cells.agg(F.bool_or("tied")).first()[0])
    out = {"summary": one.first().asDict(), "quadrants": report.table(divergence.quadrant_counts(cells)), "tags": report.table(divergence.divergence_tags(rows)), "findings": report.table(divergence.summary_findings(one, s, human is not None, tied))}
    sinks.write_json(spark, f"{where}/reward_hacking_metrics.json", out)
    return out | {"disclaimer": report.DISCLAIMER}


def _pairs(spark: SparkSession, c: dict) -> DataFrame:
    return jsonl.strict(jsonl.preferences(spark, c["prefs_path"]))


def _dpo(spark, c, where, generate) -> dict:
    rows = guards.require_rows(preferences.trainer_rows(_pairs(spark, c)), "forced choices")
    train, val = preferences.train_and_validation(rows, fallback=True)
    sinks.write_rows(train, f"{where}/train")
    sinks.write_rows(val, f"{where}/val")
    return {"training": {"n_train": train.count(), "n_val": val.count()}, "disclaimer": report.DISCLAIMER}


def _grpo(spark, c, where, generate) -> dict:
    train, val = preferences.train_and_validation(guards.grpo_rows(guards.of_task(_manifest(spark, c), "hidden_state").where("split <> 'held_out'")), fallback=False)
    sinks.write_rows(train, f"{where}/train")
    sinks.write_rows(val, f"{where}/val")
    return {"training": {"n_train": train.count(), "n_val": val.count()}, "disclaimer": report.DISCLAIMER}


def _reward_model(spark, c, where, generate) -> dict:
    fraction = 0.25 if c.get("val_fraction") is None else float(c["val_fraction"])
    parts = preferences.seeded_split(preferences.dpo_rows(_pairs(spark, c)), "judgment_id", int(c.get("seed") or 0), fraction).persist()
    train, val = parts.where("part = 'train'"), parts.where("part = 'val'")
    settings = embedding_reward.Settings(**{f.name: type(f.default)(c[f.name]) for f in fields(embedding_reward.Settings) if c.get(f.name) is not None})
    model, history = embedding_reward.train(train, val, settings)
    embedding_reward.save(spark, model, f"{where}/model")
    measure = lambda rows: reward_model.pair_metrics(embedding_reward.score(model, rows)).first().asDict()
    sinks.write_rows(embedding_reward.score(model, val), f"{where}/val_scores")
    sinks.write_json(spark, f"{where}/history.json", history)
    return {"training": {"train": measure(train), "val": measure(val), "history": history}, "disclaimer": report.DISCLAIMER}


RUNNERS: dict[str, Callable[..., dict]] = {"baseline": _baseline, "temporal_shuffle": _temporal, "comparison": _comparison, "reward_hacking": _divergence, "dpo": _dpo, "grpo": _grpo, "reward_model": _reward_model}


def validate_manifest(spark: SparkSession, path: str, options: validation.Options | None = None, media_root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings in report order and the one-row verdict of a manifest. A missing file is a finding."""
    o = options or validation.Options()
    if not jsonl.exists(spark, path):
        found = spark.createDataFrame([("error", "manifest_missing", path, [], [], None)], validation.SCHEMA)
        return found, validation.report(spark.createDataFrame([], "clip_id string"), found, o.fail_on_leakage)
    rows = jsonl.parsed(spark, path, jsonl.schemas.EXAMPLE, jsonl.schemas.example_rules()[:-1], jsonl.schemas.example_columns)
    good, bad = jsonl.permissive(rows)
    ex = jsonl.flat_examples(good)
    files = jsonl.media_files(spark, media_root) if media_root else None
    found = validation.findings(ex, o, files).unionByName(validation.malformed(bad))
    return validation.ordered(found), validation.report(ex, found, o.fail_on_leakage)


def preference_quality(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Quality findings of a preference file and its malformed lines."""
    good, bad = jsonl.permissive(jsonl.preferences(spark, path))
    return preferences.quality_findings(good, bad.count()), bad
