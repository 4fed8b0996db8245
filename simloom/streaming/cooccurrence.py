"""Windowed co-occurrence counts of an event stream, late data by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transitions(events: DataFrame, *, span: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``start, event_type, n, total`` for each window of ``ts``; the same on a stream and on a table."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", span).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
