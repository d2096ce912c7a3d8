"""Run folders and result files. A run never overwrites another."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.jsonl import exists

MARKER = "_IMMUTABLE"
#: Output folder of each kind of run.
OUTPUT = {"dpo": "runs/dpo", "grpo": "runs/grpo", "reward_model": "runs/reward_model", "comparison": "runs/comparison", "reward_hacking": "runs/reward_hacking"}


def make_run_id(name: str, now: datetime | None = None) -> str:
    """UTC time and a name fit for a path."""
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%SZ")
    safe = "".join(c if c.isalnum() or c in "-_" else "-" for c in name).strip("-")
    return f"{stamp}_{safe or 'run'}"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, which all executors share; in local mode a temporary one will do."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def resolve_run_id(config: dict, run_id: str | None, default: str) -> str:
    """The argument, else the config's, else a new one."""
    given = (run_id or "").strip() or str(config.get("run_id") or "").strip()
    return given or make_run_id(str(config.get("name") or default))


def output_dir(config: dict, kind: str) -> str:
    return str(config.get("output_dir") or OUTPUT.get(kind, "runs"))


def run_directory(spark: SparkSession, output: str, run_id: str, overwrite: bool = False) -> str:
    """The path of a run, which must be new unless ``overwrite``."""
    if not run_id.strip():
        raise ValueError("the run id is blank")
    path = f"{output.rstrip('/')}/{run_id}"
    if not overwrite and exists(spark, path):
        raise FileExistsError(f"the run {path} is there already")
    return path


def protect_baseline(spark: SparkSession, baseline: str | None, target: str) -> None:
    """Refuse to write into a baseline run or a folder that is marked immutable."""
    if baseline and target.rstrip("/") == baseline.rstrip("/"):
        raise ValueError(f"{target} is the baseline run")
    if exists(spark, f"{target.rstrip('/')}/{MARKER}"):
        raise ValueError(f"{target} is immutable")


def _stream(spark: SparkSession, path: str, overwrite: bool):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, overwrite)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> str:
    out = _stream(spark, path, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


def write_json(spark: SparkSession, path: str, payload: object, overwrite: bool = False) -> str:
    """A small document, keys sorted."""
    return write_text(spark, path, json.dumps(payload, indent=2, sort_keys=True, default=str) + "\n", overwrite)


def mark_immutable(spark: SparkSession, run_dir: str) -> str:
    return write_text(spark, f"{run_dir}/{MARKER}", "")


def write_rows(df: DataFrame, path: str) -> str:
    """JSON lines in a new folder, one file for each task; nulls are kept."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
    return path


def fan_out(df: DataFrame, run_dir: str, parts: dict[str, str]) -> dict[str, str]:
    """Write filtered copies of one result: name -> condition. The result is computed once."""
    held = df.persist()
    try:
        return {name: write_rows(held.where(condition), f"{run_dir}/{name}") for name, condition in parts.items()}
    finally:
        held.unpersist()


#: What is written of an analysis and of a divergence run.
ANALYSIS_PARTS = {"inspectable": "true", "errors": "not correct", "successes": "correct"}
DIVERGENCE_PARTS = {
    "records": "true",
    "high_reward_low_accuracy": "after.quadrant = 'high_reward_low_accuracy'",
    "low_reward_high_accuracy": "after.quadrant = 'low_reward_high_accuracy'",
    "flagged": "size(tags) > 0",
}


def write_manifest(ex: DataFrame, path: str) -> str:
    """Examples, if no id occurs twice and no clip has two paths or splits."""
    from tessera.operators.validation import first_violation

    broken = first_violation(ex).first()
    if broken is not None:
        raise ValueError(f"{broken['detail']}: {broken['subject']}")
    return write_rows(ex, path)


def write_queue(queue: DataFrame, path: str) -> str:
    """An annotation queue without its derived pair ids."""
    return write_rows(queue.drop("pair_id"), path)


def append_judgments(judgments: DataFrame, store: str) -> int:
    """Append judgments to a Parquet store and return how many were new.

    A judgment id, or a pair of annotator and content, that the store or an
    earlier row of the batch has is refused.
    """
    spark = judgments.sparkSession
    from pyspark.sql import Window

    order = "ord" if "ord" in judgments.columns else "timestamp"
    one = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy(order, "judgment_id"))
    fresh = judgments.withColumn("_a", one("judgment_id")).where("_a = 1").withColumn("_b", one("annotator_id", "pair_id")).where("_b = 1").drop("_a", "_b")
    if exists(spark, store):
        old = spark.read.parquet(store)
        fresh = fresh.join(old.select("judgment_id"), "judgment_id", "left_anti").join(old.select("annotator_id", "pair_id").distinct(), ["annotator_id", "pair_id"], "left_anti")
    fresh = fresh.select(judgments.columns).persist()
    try:
        n = fresh.count()
        if n:
            fresh.write.mode("append").parquet(store)
        return n
    finally:
        fresh.unpersist()
