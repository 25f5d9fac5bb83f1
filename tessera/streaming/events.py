"""Windowed aggregates of an event stream: beyond the batch engine, for tables that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", key: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """(window_start, key, n, total): counts and sums of tumbling or sliding windows; the same plan for a stream (with a watermark) and a table."""
    df = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")
