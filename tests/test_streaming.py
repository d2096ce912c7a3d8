"""Streams in micro-batches, with restarts, replays and late rows, against one batch run."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.streaming import judgments

JUDGMENT = "judgment_id string, annotator_id string, pair_id string, ord long, winner string"


def batches(seed):
    """Four micro-batches; ids, pairs and whole rows come again within and across them."""
    r = random.Random(seed)
    rows = [(f"j{r.randrange(60)}", f"a{r.randrange(3)}", f"p{r.randrange(14)}", i, r.choice("ab")) for i in range(120)]
    rows[7] = (None, None, None, 7, "a")
    rows[50] = (None, "a1", None, 50, "a")
    parts = [rows[lo : lo + 30] for lo in range(0, 120, 30)]
    parts[2] += parts[0][:10]
    return parts


def sequential(parts):
    """One row at a time: an id that was seen is used up; of first rows of ids the first of an annotator and pair is taken."""
    ids, pairs, out = set(), set(), Counter()
    for part in parts:
        for row in sorted(part, key=lambda r: (r[3], r[0] or "")):
            why = None
            if row[0] in ids:
                why = judgments.SEEN_ID
            elif row[1:3] in pairs:
                why = judgments.SEEN_PAIR
            ids.add(row[0])
            if why is None:
                pairs.add(row[1:3])
            out[(*row, why)] += 1
    return out


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def read(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("seed", [0, 1])
def test_verdicts_equal_one_row_at_a_time(spark, tmp_path, seed):
    parts, src = batches(seed), str(tmp_path / "src")
    for part in parts:
        put(spark, part, JUDGMENT, src)
    judgments.with_state_store(spark)
    q = judgments.verdicts(read(spark, JUDGMENT, src)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert Counter(tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()) == sequential(parts)


def test_log_resumes_and_replays_a_failed_batch(spark, tmp_path):
    parts = batches(2)
    src, log, cp = (str(tmp_path / x) for x in ("src", "log", "cp"))
    for part in parts[:2]:
        put(spark, part, JUDGMENT, src)
    judgments.log_judgments(read(spark, JUDGMENT, src), log, cp).awaitTermination(240)
    for part in parts[2:]:
        put(spark, part, JUDGMENT, src)
    broken = read(spark, JUDGMENT, src).withColumn("winner", F.when(F.col("ord") == 95, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("winner")))
    with pytest.raises(Exception, match="lost"):  # the third batch goes through, the fourth fails under way
        judgments.log_judgments(broken, log, cp).awaitTermination(240)
    judgments.log_judgments(read(spark, JUDGMENT, src), log, cp).awaitTermination(240)
    want = Counter(k[:5] for k, n in sequential(parts).items() for _ in range(n) if k[5] is None)
    assert Counter(tuple(x) for x in spark.read.parquet(log).collect()) == want
    judgments.log_judgments(read(spark, JUDGMENT, src), log, cp).awaitTermination(240)  # nothing new
    assert spark.read.parquet(log).count() == sum(want.values())


def test_windows_with_late_rows_equal_a_batch(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    r = random.Random(3)
    schema = "ts timestamp, reward double, parse_failed boolean"
    row = lambda minute: (at + datetime.timedelta(minutes=minute), r.random(), r.random() < 0.3)
    parts = [[row(m) for m in range(0, 30)], [row(m) for m in range(20, 50)], [row(m) for m in range(44, 80)], [row(200)]]
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))

    def run():
        judgments.rollout_metrics(read(spark, schema, src)).select(F.col("window.start").alias("start"), "n", "mean_reward", "n_parse_failed").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination(240)

    for part in parts[:2]:
        put(spark, part, schema, src)
    run()  # open windows wait in state for the restart
    for part in parts[2:]:
        put(spark, part, schema, src)
    run()
    flat = spark.createDataFrame([x for p in parts for x in p], schema)  # late rows were all within the watermark
    want = judgments.rollout_metrics(flat).where("window.start < '2026-01-01 03:00:00'").select(F.col("window.start").alias("start"), "n", F.round("mean_reward", 9), "n_parse_failed")
    got = spark.read.parquet(out).withColumn("mean_reward", F.round("mean_reward", 9))
    assert Counter(tuple(x) for x in got.collect()) == Counter(tuple(x) for x in want.collect()) and got.count() == 8


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    schema = "ts timestamp, reward double, parse_failed boolean"
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for minute in (0, 100, 101, 1, 200, 300):  # minute 1 comes when its window is closed for a batch
        put(spark, [(at + datetime.timedelta(minutes=minute), 1.0, False)], schema, src)
    judgments.rollout_metrics(read(spark, schema, src)).select("window.start", "n").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)
    assert sorted((x.start.hour * 60 + x.start.minute, x.n) for x in spark.read.parquet(out).collect()) == [(0, 1), (100, 2), (200, 1)]


def test_metrics_table_equals_a_batch_after_restarts(spark, tmp_path):
    r, schema = random.Random(4), "epoch int, loss double"
    parts = [[(r.randrange(4), r.random()) for _ in range(20)] for _ in range(3)]
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for part in parts:
        put(spark, part, schema, src)
        judgments.keep_metrics(read(spark, schema, src), out, cp).awaitTermination(240)
    want = judgments.epoch_metrics(spark.createDataFrame([x for p in parts for x in p], schema))
    rounded = lambda rows: sorted((x.epoch, x.n, round(x.mean_loss, 9)) for x in rows.collect())
    assert rounded(judgments.kept_metrics(spark, out)) == rounded(want)


def test_rollout_log_holds_every_row_once(spark, tmp_path):
    schema = "completion string, reward double"
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    put(spark, [("a", 1.0), ("a", 1.0)], schema, src)
    judgments.log_rollouts(read(spark, schema, src), out, cp).awaitTermination(240)
    put(spark, [("b", 0.5)], schema, src)
    for _ in range(2):
        judgments.log_rollouts(read(spark, schema, src), out, cp).awaitTermination(240)
    assert sorted(tuple(x) for x in spark.read.parquet(out).collect()) == [("a", 1.0), ("a", 1.0), ("b", 0.5)]
