"""The event log as a stream: counts of each kind within windows of time, late events allowed for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Works on a stream and on a table alike."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late).groupBy(F.window(time, window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
