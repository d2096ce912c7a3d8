"""The engine's relations over the driver tables, by deterministic rules.

The driver tables have no examples, predictions or judgments, so these views
derive them: ``ex`` from documents and labels, ``pred`` from ``ex`` for methods
m0 and m1, ``pref`` from assistant turns, ``span`` from events. ``SQL`` holds the
same views in ANSI SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METHODS = ("m0", "m1")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _id(prefix: str, x) -> F.Column:
    return F.concat(F.lit(prefix), x.cast("string"))


def examples(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    d = table(spark, folder, "documents").join(labels, "doc_id", "left")
    i = F.col("doc_id")
    clip = i % 331
    return d.select(
        _id("ex_", i).alias("example_id"),
        i.alias("ord"),
        _id("clip_", clip).alias("clip_id"),
        F.col("source").alias("trick_id"),
        F.col("lang").alias("performer_id"),
        _id("cam_", i % 4).alias("camera_id"),
        F.when(i % 5 != 0, _id("prop_", i % 13)).alias("prop_id"),
        F.when(i % 7 != 0, _id("v", i % 3)).alias("question_variant"),
        F.concat(F.lit("v/"), clip.cast("string"), F.lit(".mp4")).alias("video_path"),
        F.md5(F.col("text").cast("binary")).alias("content_hash"),
        (F.col("n_chars").cast("double") / 30).alias("duration_s"),
        F.when(i % 17 != 0, (24 + (i % 3) * 3).cast("double")).alias("fps"),
        F.col("n_chars").cast("int").alias("num_frames"),
        F.when(F.col("quality").isNull(), "explanation").otherwise("hidden_state").alias("task"),
        F.col("text").alias("question"),
        F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("ground_truth"),
        F.when(clip % 10 < 6, "train").when(clip % 10 < 8, "val").otherwise("held_out").alias("split"),
        F.col("toxic").alias("toxic"),
    )


def methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m,) for m in METHODS], "method_id string")


def predictions(ex: DataFrame) -> DataFrame:
    n, i = F.col("num_frames"), F.col("ord")
    base = ex.where("task = 'hidden_state'")
    m0 = F.when((F.col("toxic") == 1) | (n % 5 == 0), "bad").otherwise("good")
    m1 = F.when(n > 300, "good").otherwise("bad")
    both = base.select("*", F.inline(F.array(F.struct(F.lit("m0").alias("method_id"), m0.alias("answer")), F.struct(F.lit("m1").alias("method_id"), m1.alias("answer")))))
    rows = both.where(~((F.col("method_id") == "m1") & (i % 29 == 0)))
    return rows.select(
        "example_id", "method_id", "ord", "ground_truth", "split", "trick_id", "performer_id", "camera_id",
        F.concat(F.lit("Looking closely.\nAnswer: "), F.col("answer")).alias("raw_text"),
        F.when(n % 23 != 0, F.col("answer")).alias("parsed_answer"),
        (F.lit(1.0) + (n % 7) / 10).alias("latency_s"),
    )


def preferences(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").where("role = 'assistant'")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    p = turns.withColumn("prev", before).where("prev is not null")
    tie = (F.length("text") + F.col("turn")) % 3 == 0
    winner = F.when(tie, "tie").when(F.length("prev") >= F.length("text"), "a").otherwise("b")
    slot = F.col("conv_id") % 10
    key = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return p.select(
        F.concat(F.lit("judg_"), key).alias("judgment_id"),
        F.concat(F.lit("pair_"), (F.col("conv_id") % 40).cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("pair_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
        _id("clip_", F.col("conv_id") % 11).alias("clip_id"),
        _id("ex_", F.col("conv_id")).alias("example_id"),
        F.lit("Explain the clip.").alias("instruction"),
        F.col("prev").alias("response_a"),
        F.col("text").alias("response_b"),
        winner.alias("winner"),
        _id("ann", F.col("conv_id") % 3).alias("annotator_id"),
        F.lit("explanation").alias("task"),
        F.when(slot < 6, "train").when(slot < 8, "val").otherwise("held_out").alias("split"),
    )


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """Gold and stated intervals of events; each user's next event states an interval."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, folder, "events").select("event_id", "user_id", "ts", "value", F.lead("value").over(w).alias("nv"), F.lead("event_id").over(w).alias("nid"))
    text = lambda x: x.cast("decimal(10,2)").cast("string")
    return e.where("nv is not null").select(
        "event_id",
        F.col("value").alias("gold_start"),
        (F.col("value") + F.col("event_id") % 7).alias("gold_end"),
        F.concat(F.lit("start_s="), text(F.col("nv")), F.lit(" end_s="), text(F.col("nv") + F.col("nid") % 5)).alias("raw_text"),
    )


def model_scores(ex: DataFrame) -> DataFrame:
    """A reward model's scores for both methods."""
    both = ex.where("task = 'hidden_state'").select("example_id", "ord", "num_frames", F.explode(F.array(*map(F.lit, METHODS))).alias("method_id"))
    value = F.when(F.col("method_id") == "m0", F.col("num_frames") % 97).otherwise((F.col("num_frames") * 7) % 101)
    return both.select("example_id", "method_id", "ord", (value.cast("double") / 100).alias("rm_score"))


SQL = """
ex AS (
  SELECT concat('ex_', CAST(d.doc_id AS VARCHAR)) AS example_id, d.doc_id AS ord,
    concat('clip_', CAST(d.doc_id % 331 AS VARCHAR)) AS clip_id, d.source AS trick_id, d.lang AS performer_id,
    concat('cam_', CAST(d.doc_id % 4 AS VARCHAR)) AS camera_id,
    CASE WHEN d.doc_id % 5 <> 0 THEN concat('prop_', CAST(d.doc_id % 13 AS VARCHAR)) END AS prop_id,
    CASE WHEN d.doc_id % 7 <> 0 THEN concat('v', CAST(d.doc_id % 3 AS VARCHAR)) END AS question_variant,
    concat('v/', CAST(d.doc_id % 331 AS VARCHAR), '.mp4') AS video_path, md5(d.text) AS content_hash,
    CAST(d.n_chars AS DOUBLE) / 30 AS duration_s,
    CASE WHEN d.doc_id % 17 <> 0 THEN CAST(24 + (d.doc_id % 3) * 3 AS DOUBLE) END AS fps,
    CAST(d.n_chars AS INTEGER) AS num_frames,
    CASE WHEN l.quality IS NULL THEN 'explanation' ELSE 'hidden_state' END AS task, d.text AS question,
    CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS ground_truth,
    CASE WHEN (d.doc_id % 331) % 10 < 6 THEN 'train' WHEN (d.doc_id % 331) % 10 < 8 THEN 'val' ELSE 'held_out' END AS split,
    l.toxic AS toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
pred AS (
  SELECT e.example_id, m.method_id, e.ord, e.ground_truth, e.split, e.trick_id, e.performer_id, e.camera_id,
    concat('Looking closely.' || chr(10) || 'Answer: ', a.answer) AS raw_text,
    CASE WHEN e.num_frames % 23 <> 0 THEN a.answer END AS parsed_answer, CAST(1.0 AS DOUBLE) + CAST(e.num_frames % 7 AS DOUBLE) / 10 AS latency_s
  FROM ex e CROSS JOIN (VALUES ('m0'), ('m1')) m(method_id)
  CROSS JOIN LATERAL (SELECT CASE WHEN m.method_id = 'm0' THEN CASE WHEN e.toxic = 1 OR e.num_frames % 5 = 0 THEN 'bad' ELSE 'good' END
    ELSE CASE WHEN e.num_frames > 300 THEN 'good' ELSE 'bad' END END AS answer) a
  WHERE e.task = 'hidden_state' AND NOT (m.method_id = 'm1' AND e.ord % 29 = 0)
),
scored AS (
  SELECT *, parsed_answer IS NULL AS parse_failed, parsed_answer IS NOT NULL AND parsed_answer = ground_truth AS correct FROM pred
),
pref0 AS (
  SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE role = 'assistant'
),
pref AS (
  SELECT concat('judg_', CAST(conv_id AS VARCHAR), '_', CAST(turn AS VARCHAR)) AS judgment_id,
    concat('pair_', CAST(conv_id % 40 AS VARCHAR), '_', CAST(turn AS VARCHAR)) AS pair_id, conv_id * 1000 + turn AS ord,
    concat('clip_', CAST(conv_id % 11 AS VARCHAR)) AS clip_id, concat('ex_', CAST(conv_id AS VARCHAR)) AS example_id,
    'Explain the clip.' AS instruction, prev AS response_a, text AS response_b,
    CASE WHEN (length(text) + turn) % 3 = 0 THEN 'tie' WHEN length(prev) >= length(text) THEN 'a' ELSE 'b' END AS winner,
    concat('ann', CAST(conv_id % 3 AS VARCHAR)) AS annotator_id, 'explanation' AS task,
    CASE WHEN conv_id % 10 < 6 THEN 'train' WHEN conv_id % 10 < 8 THEN 'val' ELSE 'held_out' END AS split
  FROM pref0 WHERE prev IS NOT NULL
),
forced AS (
  SELECT *, CASE winner WHEN 'a' THEN response_a ELSE response_b END AS chosen, CASE winner WHEN 'a' THEN response_b ELSE response_a END AS rejected
  FROM pref WHERE winner IN ('a', 'b')
),
span0 AS (
  SELECT event_id, value, lead(value) OVER w AS nv, lead(event_id) OVER w AS nid FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
),
span AS (
  SELECT event_id, value AS gold_start, value + event_id % 7 AS gold_end,
    concat('start_s=', CAST(CAST(nv AS DECIMAL(10,2)) AS VARCHAR), ' end_s=', CAST(CAST(nv + nid % 5 AS DECIMAL(10,2)) AS VARCHAR)) AS raw_text
  FROM span0 WHERE nv IS NOT NULL
),
rm AS (
  SELECT e.example_id, m.method_id, CAST(CASE WHEN m.method_id = 'm0' THEN e.num_frames % 97 ELSE (e.num_frames * 7) % 101 END AS DOUBLE) / 100 AS rm_score
  FROM ex e CROSS JOIN (VALUES ('m0'), ('m1')) m(method_id) WHERE e.task = 'hidden_state'
),
lock_set AS (SELECT * FROM ex WHERE split = 'held_out' AND task = 'hidden_state'),
aligned AS (
  SELECT e.*, m.method_id, p.example_id IS NULL AS missing, p.raw_text, p.parsed_answer, p.parse_failed, p.correct,
    CASE WHEN p.correct THEN 1.0 WHEN NOT p.correct THEN 0.0 END::DOUBLE AS reward
  FROM lock_set e CROSS JOIN (VALUES ('m0'), ('m1')) m(method_id)
  LEFT JOIN scored p ON p.example_id = e.example_id AND p.method_id = m.method_id
)
"""
