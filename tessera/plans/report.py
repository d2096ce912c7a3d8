"""Report documents from run folders: what is absent is said to be unavailable."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.text import FORBIDDEN_CLAIMS
from tessera.sources.jsonl import document, exists

UNAVAILABLE = "unavailable"
DISCLAIMER = "Accuracy, reward and preference scores are reported side by side; none of them stands for another, and no single example proves a divergence."

#: Files that tell the kind of a run, in order; all files of one entry must be there.
KINDS = (
    ("reward_hacking", ("reward_hacking_metrics.json",)),
    ("comparison", ("comparison_metrics.json",)),
    ("grpo", ("grpo_train_records.jsonl",)),
    ("grpo", ("held_out_eval.json",)),
    ("grpo", ("held_out_eval_rows.jsonl",)),
    ("grpo", ("reward_stats.json", "train_metadata.json")),
    ("dpo", ("dpo_train_records.jsonl",)),
    ("reward_model", ("checkpoint_best.pt", "train_metadata.json")),
    ("temporal", ("temporal_shuffle_summary.json",)),
    ("baseline", ("BASELINE_IMMUTABLE.json",)),
    ("baseline", ("predictions.jsonl",)),
)
#: Documents of a run, and where a section takes its values from, in order.
DOCUMENTS = ("summary.json", "metrics.json", "config.json", "environment.json", "train_metadata.json", "reward_stats.json", "held_out_eval.json", "comparison_metrics.json", "reward_hacking_metrics.json", "temporal_shuffle_summary.json", "dispatch_config.json")
SECTIONS = {
    "summary": (("summary.json", None), ("metrics.json", None)),
    "configuration": (("config.json", None), ("dispatch_config.json", None)),
    "dataset": (("config.json", "dataset"), ("summary.json", "dataset")),
    "model": (("config.json", "model"), ("environment.json", None)),
    "training": (("train_metadata.json", None),),
    "reward": (("reward_stats.json", None),),
    "evaluation": (("metrics.json", None), ("held_out_eval.json", None)),
    "generalization": (("comparison_metrics.json", "generalization_slices"),),
    "temporal": (("temporal_shuffle_summary.json", None),),
    "reward_hacking": (("reward_hacking_metrics.json", None),),
}


def detect_kind(spark: SparkSession, run_dir: str) -> str:
    there: dict[str, bool] = {}

    def has(name: str) -> bool:
        if name not in there:
            there[name] = exists(spark, f"{run_dir}/{name}")
        return there[name]

    for kind, names in KINDS:
        if all(map(has, names)):
            return kind
    told = (read_document(spark, f"{run_dir}/dispatch_config.json") or {}).get("experiment_type")
    return {"temporal_shuffle": "temporal"}.get(told, told) or "unknown"


def read_document(spark: SparkSession, path: str) -> dict | None:
    """A small JSON object; null if it is missing, corrupt or no object."""
    from pyspark.sql import functions as F

    row = document(spark, path).select(F.to_json("doc").alias("j")).first()
    return json.loads(row["j"]) if row and row["j"] else None


def load_run(spark: SparkSession, run_dir: str) -> dict[str, dict | None]:
    return {name: read_document(spark, f"{run_dir}/{name}") for name in DOCUMENTS}


def build(run: dict[str, dict | None], kind: str, examples: DataFrame | None = None) -> dict:
    """The report document. ``examples`` is a bounded selection (see ``operators.selection``)."""
    out: dict = {"kind": kind, "disclaimer": DISCLAIMER}
    for section, sources in SECTIONS.items():
        found = (run.get(f) if key is None else (run.get(f) or {}).get(key) for f, key in sources)
        out[section] = next((x for x in found if x), UNAVAILABLE)
    out["examples"] = [r.asDict(recursive=True) for r in examples.collect()] if examples is not None else UNAVAILABLE
    check_claims(out)
    return out


def check_claims(report: dict) -> None:
    """No report may claim what its numbers cannot show."""
    body = json.dumps(report, default=str)
    for pattern in FORBIDDEN_CLAIMS:
        if re.search(pattern, body):
            raise ValueError(f"the report makes a forbidden claim: {pattern}")


def _number(x: object) -> str:
    return "n/a" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)


def markdown(title: str, report: dict) -> str:
    """A readable form: a table for each section of plain values, a list for the rest."""
    lines = [f"# {title}", "", str(report.get("disclaimer", "")), ""]
    for name, section in report.items():
        if name in ("disclaimer",):
            continue
        lines += [f"## {name.replace('_', ' ')}", ""]
        if isinstance(section, dict):
            lines += ["| field | value |", "|---|---|"] + [f"| {k} | {_number(v)} |" for k, v in sorted(section.items()) if not isinstance(v, (dict, list))]
            lines += [f"- {k}: {json.dumps(v, default=str)}" for k, v in sorted(section.items()) if isinstance(v, (dict, list))]
        elif isinstance(section, list):
            lines += [f"- {json.dumps(x, default=str)}" for x in section] or ["none"]
        else:
            lines.append(_number(section))
        lines.append("")
    return "\n".join(lines)


def table(df: DataFrame, limit: int = 200) -> list[dict]:
    """A small result for a document, by its first columns; ``limit`` is the size of a report table."""
    return [r.asDict(recursive=True) for r in df.orderBy(*df.columns[:2]).limit(limit).collect()]


def status_colour(status: str) -> str:
    return {"pass": "green", "ok": "green", "warn": "amber", "partial": "amber", "fail": "red", "blocked": "red"}.get(status.lower(), "grey")


def overall_status(components: dict[str, str]) -> dict:
    """Counts by status and the overall one: the worst that occurs."""
    counts: dict[str, int] = {}
    for s in components.values():
        counts[s] = counts.get(s, 0) + 1
    worst = next((s for s in ("fail", "blocked", "partial", "warn") if counts.get(s)), "pass" if components else "unknown")
    return {"overall": worst, "counts": counts}
