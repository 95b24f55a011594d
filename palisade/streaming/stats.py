"""Streaming statistics over a stream of log records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.times import hour_text


def in_event_time(logs: DataFrame, delay: str) -> DataFrame:
    """Set the watermark. It needs a TIMESTAMP, which in UTC is the same instant."""
    return logs.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)


def hourly_counts(logs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Rows, and HIGH rows, per hour, severity and event type.

    Rows that come later than ``delay`` behind the newest one are dropped. An hour is
    reported once, when no more rows for it are accepted.
    """
    return (
        in_event_time(logs, delay)
        .groupBy(F.window("timestamp", "1 hour"), "severity", "event_type")
        .agg(F.count("*").alias("count"), F.count_if(F.col("severity") == "HIGH").alias("high_severity"))
        .select(hour_text("window.start").alias("hour"), "severity", "event_type", "count", "high_severity")
    )
