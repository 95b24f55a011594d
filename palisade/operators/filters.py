"""Filters over the log table. Every predicate is a built-in expression, so it reaches the scan."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.times import ntz

EQUALITY_COLUMNS = ("source_ip", "severity", "event_type", "destination_port", "protocol", "log_source")


def in_range(logs: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Rows between two instants, both included; an open side is unbounded.

    A table partitioned by ``log_date`` gets the matching date bounds too, which prune its
    folders.
    """
    dated = "log_date" in logs.columns
    for value, compare in ((start, Column.__ge__), (end, Column.__le__)):
        if value is not None:
            logs = logs.where(compare(F.col("timestamp"), ntz(value)))
            if dated:
                logs = logs.where(compare(F.col("log_date"), ntz(value).cast("date")))
    return logs


def search(logs: DataFrame, pattern: str) -> DataFrame:
    """Case-insensitive regular expression over source, text or user."""
    hit = lambda c: F.coalesce(F.col(c).rlike("(?i)" + pattern), F.lit(False))
    return logs.where(hit("source_ip") | hit("raw_log") | hit("username"))


def filter_logs(
    logs: DataFrame,
    *,
    start: datetime | None = None,
    end: datetime | None = None,
    pattern: str | None = None,
    **equal: str | int | None,
) -> DataFrame:
    """All filters of the browse view together. An empty or zero value means no filter."""
    unknown = set(equal) - set(EQUALITY_COLUMNS)
    if unknown:
        raise ValueError(f"cannot filter on {sorted(unknown)}")
    wanted = [F.col(c) == v for c, v in equal.items() if v]
    logs = in_range(logs, start, end)
    if wanted:
        logs = logs.where(reduce(Column.__and__, wanted))
    return search(logs, pattern) if pattern else logs


def with_defaults(logs: DataFrame) -> DataFrame:
    """Fill missing fields for display and drop rows that have no timestamp."""
    # What stands in for a missing or empty field.
    defaults = {"source_ip": "Unknown", "log_source": "unknown", "event_type": "UNKNOWN", "severity": "LOW"}
    return logs.where(F.col("timestamp").isNotNull()).withColumns({
        **{c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)) for c, v in defaults.items()},
        "raw_log": F.coalesce("raw_log", F.lit("")),
    })


def of_severity(detections: DataFrame, severity: str | None) -> DataFrame:
    """Detections of one severity."""
    return detections.where(F.col("severity") == severity) if severity else detections


def from_source(detections: DataFrame, ip: str | None) -> DataFrame:
    """Detections one source takes part in (``source_ips`` for floods, ``source_ip`` otherwise)."""
    if not ip:
        return detections
    if "source_ips" in detections.columns:
        return detections.where(F.array_contains("source_ips", ip))
    return detections.where(F.col("source_ip") == ip)
