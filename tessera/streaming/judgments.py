"""Structured Streaming: an append-only judgment log with keyed state, rollout logs, running metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

#: Why a judgment is refused.
SEEN_ID, SEEN_PAIR = "duplicate judgment_id", "annotator has judged this pair"
#: State that outlives a task needs a store that can hold more than memory.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class FirstOnly(StatefulProcessor):
    """Of the rows of a key, ever, the first by ``order`` stays; the others get ``reason`` in column refused.

    State is one number for each key. Rows that are refused already pass.
    """

    def __init__(self, order: list[str], reason: str):
        self.order, self.reason = order, reason

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.seen.exists()
        n, lead = (self.seen.get()[0] if before else 0), None
        for part in rows:
            still = part["refused"].isna()
            yield part[~still]
            fresh = part[still]
            n += len(fresh)
            if not before and len(fresh):
                fresh = (fresh if lead is None else pd.concat([lead, fresh])).sort_values(self.order, kind="stable")
                lead, fresh = fresh.iloc[:1], fresh.iloc[1:]
            yield fresh.assign(refused=self.reason)
        if lead is not None:
            yield lead
        if n:
            self.seen.update((n,))

    def close(self) -> None:
        pass


def _order(columns: list[str]) -> list[str]:
    return ["ord" if "ord" in columns else "timestamp", "judgment_id"]


def verdicts(stream: DataFrame) -> DataFrame:
    """A stream of judgments with column ``refused``: null, or why the store does not take the row.

    A row is refused if an earlier one has its judgment id or, among first rows of
    an id, its annotator and pair. Earlier is an earlier micro-batch, or the same
    one and a smaller order (ord, else timestamp) and id. An id that was seen is used
    up, whether its row was taken or not. Null ids are one key like any other.
    """
    names = stream.columns
    shape = StructType([*stream.schema.fields]).add("refused", "string")
    rows = stream.withColumn("refused", F.lit(None).cast("string"))
    for keys, reason in ((["judgment_id"], SEEN_ID), (["annotator_id", "pair_id"], SEEN_PAIR)):
        rows = rows.groupBy(*keys).transformWithStateInPandas(FirstOnly(_order(names), reason), shape, "append", "none")
    return rows.select(*names, "refused")


def with_state_store(spark: SparkSession) -> None:
    """Streams of this session that start from now on keep their state in RocksDB."""
    for k, v in STORE.items():
        spark.conf.set(k, v)


def deduplicated(stream: DataFrame, event_time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Judgments with each judgment id once; state is dropped when the watermark has passed."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["judgment_id"])


def log_judgments(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append the judgments that are not refused to a Parquet store.

    What was seen is state beside the checkpoint, so a batch costs what it holds, not
    what the store holds. The sink commits each batch once: after a restart a batch that
    was under way is replayed from the state of its predecessor and written once.
    """
    with_state_store(stream.sparkSession)
    taken = verdicts(stream).where("refused is null").drop("refused")
    return taken.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_rollouts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append scored completions as they come."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollout_metrics(stream: DataFrame, event_time: str = "ts", window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Mean reward and parse failures of each window, late rows within the watermark included."""
    timed = stream.withWatermark(event_time, delay)
    return timed.groupBy(F.window(event_time, window)).agg(F.count("*").alias("n"), F.avg("reward").alias("mean_reward"), F.count_if("parse_failed").alias("n_parse_failed"))


def epoch_metrics(rows: DataFrame) -> DataFrame:
    """Rows and mean loss of each epoch, of a stream or a table."""
    return rows.groupBy("epoch").agg(F.count("*").alias("n"), F.avg("loss").alias("mean_loss"))


def latest_metrics(stream: DataFrame, name: str) -> StreamingQuery:
    """Per-epoch metrics that are rewritten as they change, in a table in memory."""
    return epoch_metrics(stream).writeStream.outputMode("complete").format("memory").queryName(name).start()


def keep_metrics(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Per-epoch metrics in a folder, one table for each micro-batch under its number: a replayed batch writes the same table again."""

    def put(totals: DataFrame, batch: int) -> None:
        totals.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return epoch_metrics(stream).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of the last micro-batch that ``keep_metrics`` wrote."""
    every = spark.read.parquet(path)
    last = every.agg(F.max("batch").alias("batch"))
    return every.join(F.broadcast(last), "batch").drop("batch")
