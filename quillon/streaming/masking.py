"""Streaming: documents masked as they come, sessions of events, and repeated events dropped.

Recognition and masking keep no state between documents, so a stream runs the batch operators on each micro-batch;
identity is per document and needs none either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def masked_stream(documents: DataFrame, mask: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Mask a stream of documents into Parquet. Batches are written under their number, so one that is run again after a
    failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        mask(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def sessions(events: DataFrame, gap: str = "15 seconds", late: str = "1 hour") -> DataFrame:
    """Heartbeats into sessions that end after a gap: user_id, start, end, n_events, value. Batch or stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.session_window("ts", gap)
    found = rows.groupBy("user_id", window.alias("w")).agg(F.count("*").alias("n_events"), F.sum("value").alias("value"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "value")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once, within what may come late."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def kept_tasks(tasks: DataFrame, hours: int = 24, most: int = 24) -> DataFrame:
    """Of ended tasks (task_id, ended) the last ``most`` that ended within ``hours`` of the latest; others (ended null) stay."""

    latest = tasks.agg(F.max("ended").alias("latest"))
    ended = tasks.where("ended is not null").join(F.broadcast(latest), F.col("ended") >= F.col("latest") - F.expr(f"INTERVAL {hours} HOURS")).drop("latest")
    first = ended.orderBy(F.desc("ended"), "task_id").limit(most)
    return tasks.where("ended is null").unionByName(first.select(*tasks.columns))
