"""Registered queries over event streams, run as a batch to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.plans.tables import rounded
from tessera.streaming.events import windowed


@query("event_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    return rounded(windowed(events).withColumn("window_start", F.col("window_start").cast(dict(events.dtypes)["ts"])), 4)
