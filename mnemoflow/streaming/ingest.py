"""Streams: counts of events by window, and commits applied batch by batch. The batch and the stream share their operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.commit import commit
from ..sources.store import MemoryStore


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum per type and window. On a stream, events later than ``late`` are dropped by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    per = timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return per.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def commit_batches(decisions: DataFrame, store: MemoryStore, now: Column, name: str, checkpoint: str) -> StreamingQuery:
    """Commit each micro-batch of decisions to the store. A batch is a transaction of the stream's name and the batch's
    number, so one that runs again after a failure is committed once."""

    def write(batch: DataFrame, number: int) -> None:
        commit(store, batch, now, f"{name}.{number}")

    return decisions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_batches(decisions: DataFrame, apply: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Apply each micro-batch of decisions and write its result to a folder of the batch's number, so that a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        apply(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return decisions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
