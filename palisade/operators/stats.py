"""Statistics over the log table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.times import day_text, hour_text, ntz
from palisade.operators.filters import in_range

# The severities a per-source breakdown reports.
BREAKDOWN = ("HIGH", "MEDIUM", "LOW")


def count_by(logs: DataFrame, column: str) -> DataFrame:
    """Rows per value of a column, rows without one left out."""
    return logs.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))


def severity_share(logs: DataFrame) -> DataFrame:
    """Rows per severity, and their share of all in whole percent."""
    counts = count_by(logs, "severity")
    total = F.sum("count").over(Window.partitionBy())
    return counts.select("severity", "count", F.floor(F.col("count") * 100 / total + 0.5).alias("percent"))


def top_event_types(logs: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent event types, named for display."""
    counts = count_by(logs, "event_type").orderBy(F.desc("count"), "event_type").limit(limit)
    return counts.select(F.replace("event_type", F.lit("_"), F.lit(" ")).alias("event_type"), "count")


def logs_by_hour(
    logs: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """Rows per hour; hours without rows are absent. Without a range: the day before ``as_of``."""
    if start is None and end is None:
        start, end = _last_day(as_of)
    return (
        in_range(logs, start, end).where(F.col("timestamp").isNotNull())
        .groupBy(hour_text("timestamp").alias("hour")).agg(F.count("*").alias("count"))
    )


def report_bucket(start: datetime, end: datetime, kind: str):
    """The time bucket of a report: hours for DAILY, days for WEEKLY, and otherwise hours up
    to a span of seven days."""
    hourly = kind == "DAILY" or (kind != "WEEKLY" and end - start < timedelta(days=7))
    return hour_text("timestamp") if hourly else day_text("timestamp")


def time_breakdown(logs: DataFrame, start: datetime, end: datetime, kind: str = "CUSTOM") -> DataFrame:
    """Rows, and HIGH rows, per hour or per day of a report period."""
    return in_range(logs, start, end).groupBy(report_bucket(start, end, kind).alias("time")).agg(
        F.count("*").alias("count"),
        F.count_if(F.col("severity") == "HIGH").alias("high_severity"),
    )


def profile(logs: DataFrame, start: datetime, end: datetime, kind: str = "CUSTOM") -> DataFrame:
    """Rows per severity, event type, protocol and time bucket of a period.

    These columns have few values, so the result is small; a report takes all its
    distributions from it and reads the log once for them.
    """
    return in_range(logs, start, end).groupBy(
        "severity", "event_type", "protocol", report_bucket(start, end, kind).alias("time"),
    ).agg(F.count("*").alias("count"))


def profile_counts(profile_rows: DataFrame, column: str) -> DataFrame:
    """``count_by`` from a profile."""
    return profile_rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum("count").alias("count"))


def profile_times(profile_rows: DataFrame) -> DataFrame:
    """``time_breakdown`` from a profile."""
    high = F.when(F.col("severity") == "HIGH", F.col("count")).otherwise(0)
    return profile_rows.groupBy("time").agg(F.sum("count").alias("count"), F.sum(high).alias("high_severity"))


def ip_counts(logs: DataFrame) -> DataFrame:
    """Rows per source with its severity counts, in one grouping."""
    return logs.where(F.col("source_ip").isNotNull()).groupBy("source_ip").agg(
        F.count("*").alias("count"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in BREAKDOWN],
    )


def severity_map(frame: DataFrame) -> DataFrame:
    """Replace the three severity columns by a map without zero entries."""
    pairs = [x for s in BREAKDOWN for x in (F.lit(s), F.col(s.lower()))]
    return frame.withColumn(
        "severity_breakdown", F.map_filter(F.create_map(*pairs), lambda _, n: n > 0),
    ).drop(*[s.lower() for s in BREAKDOWN])


def top_ips(
    logs: DataFrame,
    limit: int = 10,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """The sources with most rows: source_ip, count, high, medium, low."""
    return ip_counts(in_range(logs, start, end)).orderBy(F.desc("count"), "source_ip").limit(limit)


def top_ports(
    logs: DataFrame,
    limit: int = 10,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """The ports with most rows, each with one protocol (the first in order)."""
    return (
        in_range(logs, start, end).where(F.col("destination_port").isNotNull())
        .groupBy(F.col("destination_port").alias("port"))
        .agg(F.count("*").alias("count"), F.min("protocol").alias("protocol"))
        .orderBy(F.desc("count"), "port").limit(limit)
    )


def statistics(
    logs: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    as_of: datetime | None = None,
    limit: int = 10,
) -> DataFrame:
    """All statistics as one long table: statistic, key, count, detail.

    The detail of a source is its rows per severity (those it has), that of a port its protocol.

    One grouping by the columns that have few values serves five statistics; the small
    table it gives is then grouped again. Sources and ports have their own groupings,
    which read only their columns.
    """
    scope = in_range(logs, start, end)
    if start is None and end is None:
        low, high = _last_day(as_of)
        recent = F.col("timestamp").between(ntz(low), ntz(high))
    else:
        recent = F.col("timestamp").isNotNull()
    base = scope.groupBy(
        "severity", "event_type", "protocol", F.when(recent, hour_text("timestamp")).alias("hour"),
    ).agg(F.count("*").alias("c"))
    # The value column of each set is the key; a missing value is not reported.
    sets = base.select(
        F.inline(F.array(
            F.struct(F.lit("total_logs").alias("statistic"), F.lit("all").alias("key")),
            *[F.struct(F.lit(name).alias("statistic"), F.col(column).alias("key")) for name, column in (
                ("severity_counts", "severity"), ("event_type_counts", "event_type"),
                ("protocol_counts", "protocol"), ("logs_by_hour", "hour"))],
        )), "c")
    counted = sets.where(F.col("key").isNotNull()).groupBy("statistic", "key").agg(
        F.sum("c").alias("count")).withColumn("detail", F.lit(None).cast("string"))
    shares = [F.when(F.col(s.lower()) > 0, F.concat(F.lit(f"{s}="), F.col(s.lower()).cast("string"))) for s in BREAKDOWN]
    ips = top_ips(scope, limit).select(
        F.lit("top_source_ips").alias("statistic"), F.col("source_ip").alias("key"), "count",
        F.concat_ws(",", *shares).alias("detail"))
    ports = top_ports(scope, limit).select(
        F.lit("top_ports").alias("statistic"), F.col("port").cast("string").alias("key"), "count",
        F.col("protocol").alias("detail"))
    return counted.unionByName(ips).unionByName(ports)


def _last_day(as_of: datetime | None) -> tuple[datetime, datetime]:
    if as_of is None:
        raise ValueError("without a range the hourly statistic needs as_of")
    return as_of - timedelta(hours=24), as_of
