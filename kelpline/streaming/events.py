"""Structured Streaming: daily series of events, active-task dedup, retrieval queue transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events (ts, duration_ms, status) by day; rows later than `late` are dropped once a day has closed."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    by = timed.groupBy(F.window("at", "1 day").alias("w"))
    out = by.agg(F.count("*").alias("calls"), F.sum("duration_ms").alias("spent"), F.count_if(F.col("status") == "error").alias("errors"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "calls", F.round("spent", 4).alias("spent"), "errors")


def active_tasks(tasks: DataFrame, within: str = "10 minutes") -> DataFrame:
    """First task of each dedupe key while the key is active: later ones within the watermark are dropped."""
    return tasks.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", within).dropDuplicatesWithinWatermark(["dedupe_key"])


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Drain what a source has into a memory table of that name."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
