"""JSON lines: strict and permissive scans with line numbers, optional documents.

Paths are opened by Spark and Hadoop only, so any file system that Spark reads
will do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import blank, strip
from tessera.sources import schemas


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, *paths: str | None) -> str | None:
    return next((p for p in paths if p and exists(spark, p)), None)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1) and text of every line.

    Lines are numbered within each block that a task reads and shifted by the
    lines of the blocks before it, so no task reads a whole large file.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    own = raw.withColumn("nth", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(before.select("file", "block", "before"), ["file", "block"]).select("file", (F.col("before") + F.col("nth")).alias("line_no"), "text")


def parsed(spark: SparkSession, path: str, schema: str, rules: list[schemas.Rule], columns: Callable[[Column], dict[str, Column]] | None = None) -> DataFrame:
    """Every line that is not blank: file, ord (line number), fields, ``_line`` and ``_error`` (null if valid)."""
    body = F.col("_line")
    rows = lines(spark, path).where(~blank(F.col("text"))).select("file", "line_no", strip(F.col("text")).alias("_line"))
    full = f"{schema}, _corrupt string"
    rows = rows.withColumn("r", F.from_json(body, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    not_object = F.try_parse_json(body).isNull() | ~body.startswith("{")
    rows = rows.select("file", F.col("line_no").alias("ord"), "_line", not_object.alias("_bad"), "r.*")
    if columns:
        rows = rows.withColumns(columns(body))
    broken = F.when(F.col("_bad"), "not a JSON object").when(F.col("_corrupt").isNotNull(), "a field has another type")
    for rule, message in rules:
        broken = broken.when(rule, message)
    return rows.withColumn("_error", broken).drop("_bad", "_corrupt")


def strict(rows: DataFrame) -> DataFrame:
    """Valid rows; an invalid one is an error at run time that names the file and line."""
    where = F.concat(F.col("file"), F.lit(":"), F.col("ord").cast("string"), F.lit(": "), F.col("_error"))
    checked = rows.withColumn("ord", F.when(F.col("_error").isNotNull(), F.raise_error(where).cast("bigint")).otherwise(F.col("ord")))
    return checked.drop("file", "_line", "_error")


def permissive(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others as line_no, error and raw_text. Nothing is lost."""
    good = rows.where("_error is null").drop("file", "_line", "_error")
    return good, rows.where("_error is not null").select(F.col("ord").alias("line_no"), F.col("_error").alias("error"), F.col("_line").alias("raw_text"))


def examples(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, schemas.EXAMPLE, schemas.example_rules(), schemas.example_columns)


def preferences(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, schemas.PREFERENCE, schemas.preference_rules(), schemas.preference_columns)


def flat_examples(rows: DataFrame) -> DataFrame:
    """Examples with the video's fields as columns, as the validation checks take them."""
    v = rows.select("*", F.col("video.path").alias("video_path"), F.col("video.content_hash").alias("content_hash"), F.col("video.duration_s").alias("duration_s"), F.col("video.fps").alias("fps"), F.col("video.num_frames").alias("num_frames"))
    return v.drop("video")


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file whose lines are all objects; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def optional_table(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """``table``, or no rows if there is no file."""
    if path and exists(spark, path):
        return table(spark, path, schema)
    return spark.createDataFrame([], schema)


def keyed_table(spark: SparkSession, path: str, schema: str, value: str) -> DataFrame:
    """One row for each (example_id, method_id); of repeated keys the last line. A broken line or missing key is an error."""
    rules = [(blank(F.col(k)), f"{k} is missing") for k in ("example_id", "method_id")]
    rows = strict(parsed(spark, path, schema, rules))
    fields = [c for c in rows.columns if c not in ("ord", "example_id", "method_id")]
    last = rows.groupBy("example_id", "method_id").agg(F.max_by(F.struct(*fields), "ord").alias("r"))
    return last.select("example_id", "method_id", "r.*")


def predictions(spark: SparkSession, path: str, method_id: str) -> DataFrame:
    """A method's predictions, with the keys that each line has in ``_keys``; ids must be there once.

    Presence decides how a row is normalised, so a file may mix rows with and
    without stored flags.
    """
    from tessera.operators.guards import require_unique

    rows = parsed(spark, path, schemas.PREDICTION, [(blank(F.col("example_id")), "example_id is missing")])
    rows = strict(rows.withColumn("_keys", F.json_object_keys("_line")))
    return require_unique(rows, "example_id").withColumn("method_id", F.lit(method_id))


def document(spark: SparkSession, path: str | None) -> DataFrame:
    """One row with column ``doc`` (variant): the JSON object of a file; null if it is missing, corrupt or no object."""
    empty = spark.range(1).select(F.lit(None).cast("variant").alias("doc"))
    if not path or not exists(spark, path):
        return empty
    body = spark.read.text(path, wholetext=True).select(F.col("value"))
    return body.select(F.when(F.ltrim("value").startswith("{"), F.try_parse_json("value")).alias("doc"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Answers of a text file: lines that are not blank, as they are."""
    return spark.read.text(path).where(~blank(F.col("value"))).select(F.col("value").alias("answer")).distinct()


def media_files(spark: SparkSession, path: str, pattern: str = "*.mp4") -> DataFrame:
    """path and length of media under a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length")


def count_media(spark: SparkSession, path: str) -> int:
    """Files that are not empty."""
    return media_files(spark, path).where("length > 0").count() if exists(spark, path) else 0
