"""Windowed counts of events, the same for a table and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_totals(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per window and event type: start, event_type, n and total value. On a stream, events more than ``late`` behind the
    latest are dropped and windows are given out when they close."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    got = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "total")
