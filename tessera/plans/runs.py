"""Many run folders as tables: one scan, a row for each run and document, values by priority of their sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.report import KINDS

#: Files with a row for each example, the first that has rows is taken.
ROW_FILES = ("examples_inspectable.jsonl", "aligned_examples.jsonl", "predictions.jsonl", "held_out_eval_rows.jsonl")
#: Text of values that count as none where the first that says something is taken.
NOTHING = ("", "0", "0.0", "false", "{}", "[]")


@dataclass(frozen=True)
class Value:
    """Where a report takes a field from: kinds of runs in order, and in each (document, path) in order.

    Without ``truthy`` a value is taken unless it is null. With ``one_run`` only the first run
    that has one of the documents counts, whether or not it has the value.
    """

    name: str
    kinds: tuple[str, ...]
    sources: tuple[tuple[str, str], ...]
    truthy: bool = True
    one_run: bool = False


_MODELS = ("grpo", "dpo", "baseline", "reward_model", "temporal")
_TRAINED = ("grpo", "dpo", "reward_model", "baseline")
#: Order of kinds and sources.
VALUES = (
    Value("model", _MODELS, (("train_metadata.json", "$.base_checkpoint"), ("train_metadata.json", "$.base_model_id"), ("config.json", "$.model_id"), ("config.json", "$.model.model_id"), ("run_metadata.json", "$.identity.model_id"))),
    Value("hardware", _MODELS, (("train_metadata.json", "$.hardware"), ("stack_probe.json", "$"))),
    Value("seed", _MODELS, (("train_metadata.json", "$.seed"), ("config.json", "$.seed")), truthy=False),
    Value("manifest", _TRAINED, (("train_metadata.json", "$.manifest"),), one_run=True),
    Value("dataset_version", _TRAINED, (("train_metadata.json", "$.dataset_version"),), truthy=False, one_run=True),
    Value("training_method", ("grpo", "dpo", "reward_model"), (("train_metadata.json", "$"),), one_run=True),
)


def _placed(df: DataFrame, root: str) -> DataFrame:
    """Column file split into run, the folder below ``root``, and document, the name in it; deeper files are left out."""
    under = F.regexp_replace("file", r"^[A-Za-z]+:/+", "/")
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^[A-Za-z]+:/+", "/")
    tail = F.split(F.substring(under, F.length(base) + 2, F.length(under)), "/")
    return df.withColumn("_tail", tail).where(F.size("_tail") == 2).select(F.get("_tail", F.lit(0)).alias("run"), F.get("_tail", F.lit(1)).alias("document"), *[c for c in df.columns if c != "file"])


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(run, document, body) of every JSON document of every run below ``root``, whole."""
    read = spark.read.text(f"{root.rstrip('/')}/*/*.json", wholetext=True)
    return _placed(read.select(F.url_decode("_metadata.file_path").alias("file"), F.col("value").alias("body")), root)


def rows(spark: SparkSession, root: str) -> DataFrame:
    """(run, document, body) of every line of the files of examples."""
    read = spark.read.option("pathGlobFilter", "{" + ",".join(ROW_FILES) + "}").text(f"{root.rstrip('/')}/*")
    return _placed(read.select(F.url_decode("_metadata.file_path").alias("file"), F.col("value").alias("body")), root).where(F.trim("body") != "")


def files(spark: SparkSession, root: str) -> DataFrame:
    """(run, document) of all files of all runs that are not empty; contents are not read."""
    found = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*").select(F.col("path").alias("file"))
    return _placed(found, root)


def _objects(docs: DataFrame) -> DataFrame:
    """Documents that are JSON objects with something in them, parsed; others count as missing."""
    parsed = docs.withColumn("doc", F.when(F.ltrim("body").startswith("{"), F.try_parse_json("body")))
    return parsed.where(F.col("doc").isNotNull() & (F.size(F.json_object_keys("body")) > 0)).select("run", "document", "doc")


def kinds(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(run, kind): what a run's files say, else the type in its configuration, else unknown."""
    names = found.groupBy("run").agg(F.collect_set("document").alias("names"))  # as many as a run has files
    kind = F.lit(None).cast("string")
    for k, needed in reversed(KINDS):
        every = F.lit(True)
        for name in needed:
            every = every & F.array_contains("names", name)
        kind = F.when(every, k).otherwise(kind)
    told = _objects(docs).where("document = 'dispatch_config.json'").select("run", F.try_variant_get("doc", "$.experiment_type", "string").alias("told"))
    told = told.withColumn("told", F.when(F.col("told") == "temporal_shuffle", "temporal").otherwise(F.col("told")))
    return names.join(told, "run", "left").select("run", F.coalesce(kind, "told", F.lit("unknown")).alias("kind"))


def fields(docs: DataFrame) -> DataFrame:
    """(run, document, field, value): the entries of every document, values as JSON."""
    entries = F.from_json("body", "map<string, string>")
    held = _objects(docs).select("run", "document", F.to_json("doc").alias("body"))
    return held.select("run", "document", F.explode(entries).alias("field", "value"))


def values(docs: DataFrame, of: DataFrame, wanted: tuple[Value, ...] = VALUES) -> DataFrame:
    """(field, value, kind, run, document): what a report over these runs says of each field and where it is from.

    ``of`` is (run, kind). Of runs of one kind the first by name counts before the
    others. Fields without a value have no row.
    """
    hits = []
    for w in wanted:
        for i, (document, path) in enumerate(w.sources):
            text = F.try_variant_get("doc", path, "string")
            good = text.isNotNull() & (~text.isin(*NOTHING) if w.truthy else F.lit(True))
            place = F.coalesce(F.array_position(F.array(*map(F.lit, w.kinds)), F.col("kind")), F.lit(0)).cast("int")
            hit = F.struct(F.lit(w.name).alias("field"), place.alias("place"), F.lit(i).alias("source"), F.when(good, text).alias("value"), F.lit(w.one_run).alias("one_run"))
            hits.append(F.when((F.col("document") == document) & (place > 0), hit))
    every = _objects(docs).join(of, "run").select("run", "kind", "document", F.inline(F.array_compact(F.array(*hits))))
    order = F.struct("place", "run", "source")
    first = every.groupBy("field").agg(F.min(F.struct("place", "run")).alias("first"))
    kept = every.join(F.broadcast(first), "field").where(~F.col("one_run") | (F.struct("place", "run") == F.col("first"))).where("value is not null")
    return kept.groupBy("field").agg(F.min_by(F.struct("value", "kind", "run", "document"), order).alias("v")).select("field", "v.*")


def _correct(body: Column) -> Column:
    """Whether a row's example was answered right: of a pair the later answer, of aligned methods the first that is there."""
    flag = lambda path: F.try_variant_get(F.try_parse_json(body), path, "boolean")
    cells = F.from_json(F.get_json_object(body, "$.methods"), "map<string, struct<missing: boolean, correct: boolean>>")
    there = F.filter(F.map_values(cells), lambda c: ~F.coalesce(c["missing"], F.lit(False)))
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    has = lambda k: F.array_contains(keys, k)
    return F.when(has("before") & has("after"), flag("$.after.correct")).when(cells.isNotNull(), F.get(there, F.lit(0))["correct"]).when(has("correct"), flag("$.correct")).otherwise(flag("$.matched"))


def accuracies(docs: DataFrame, examples: DataFrame) -> DataFrame:
    """(run, accuracy, n_examples, source): stated in metrics.json, else in held_out_eval.json, else counted from rows.

    Rows count only where neither document is there; of several files of rows the first
    of ``ROW_FILES`` is counted. n_examples is null where the accuracy is stated.
    """
    get = lambda path: F.try_variant_get("doc", path, "double")
    overall = F.array_contains(F.json_object_keys(F.to_json("doc")), "overall_accuracy")
    metrics = F.struct(F.when(overall, get("$.overall_accuracy")).otherwise(get("$.accuracy")).alias("accuracy"))
    stated = _objects(docs).where("document in ('metrics.json', 'held_out_eval.json')")
    said = F.when(F.col("document") == "metrics.json", metrics["accuracy"]).otherwise(get("$.accuracy"))
    stated = stated.groupBy("run").agg(F.min_by(F.struct(said.alias("accuracy"), F.col("document").alias("source")), F.col("document") != "metrics.json").alias("s"))
    place = F.array_position(F.array(*map(F.lit, ROW_FILES)), F.col("document"))
    counted = examples.select("run", "document", place.alias("place"), _correct(F.col("body")).alias("correct"))
    each = counted.groupBy("run", "document", "place").agg(F.count("correct").alias("n"), F.count_if("correct").alias("k"))
    rows_of = each.groupBy("run").agg(F.min_by(F.struct("document", "n", "k"), "place").alias("r"))
    both = stated.join(rows_of, "run", "full")
    derived = F.col("s").isNull()
    out = both.select(
        "run", F.when(derived, F.try_divide("r.k", "r.n")).otherwise(F.col("s.accuracy")).alias("accuracy"),
        F.when(derived, F.col("r.n")).alias("n_examples"), F.when(derived, F.col("r.document")).otherwise(F.col("s.source")).alias("source"),
    )
    return out.where("accuracy is not null")
