"""Brute-force logins: many failed logins of one source within a time window."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.severity import BRUTE_FORCE_BOUNDS, by_bounds
from palisade.functions.times import MINUTE, from_micros, lookback, micros
from palisade.operators import params
from palisade.operators.filters import in_range
from palisade.operators.windows import Slots, ahead_counts, greedy_windows, in_windows, with_bounds
from palisade.session import settle

EVENT = "SSH_FAILED_LOGIN"
LOOKBACK_HOURS = 24


def failed_logins(
    logs: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    source_ip: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """The rows the detector looks at; the default range is the day before ``as_of``."""
    start, end = lookback(start, end, as_of, LOOKBACK_HOURS)
    rows = in_range(logs, start, end).where((F.col("event_type") == EVENT) & F.col("source_ip").isNotNull())
    return rows.where(F.col("source_ip") == source_ip) if source_ip else rows


def attempts_per_instant(attempts: DataFrame) -> DataFrame:
    """One row per source and instant. Counting starts before the shuffle, so a source that
    sends a third of all rows costs no more than the instants it sends in."""
    return attempts.groupBy("source_ip", micros("timestamp").alias("at")).agg(F.count("*").alias("c"))


def _windows(nodes: DataFrame, slots: Slots, threshold: int) -> DataFrame:
    candidates = ahead_counts(nodes, ["source_ip"], slots).where(F.col("n") >= threshold)
    return greedy_windows(candidates, ["source_ip"], slots, ["n", "until"])


def brute_force_windows(
    logs: DataFrame,
    window_minutes: int = 15,
    threshold: int = 5,
    start: datetime | None = None,
    end: datetime | None = None,
    source_ip: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """The attack windows: source_ip, attempt_count, window_start, window_end."""
    params.check(window_minutes=window_minutes, threshold=threshold)
    nodes = attempts_per_instant(failed_logins(logs, start, end, source_ip, as_of))
    chosen = _windows(nodes, Slots.of(window_minutes * MINUTE), threshold)
    return with_bounds(chosen.withColumnRenamed("n", "attempt_count"))


def detect_brute_force(
    logs: DataFrame,
    window_minutes: int = 15,
    threshold: int = 5,
    start: datetime | None = None,
    end: datetime | None = None,
    source_ip: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """One row per attacking source. Totals cover all its failed logins in the range,
    not only those inside windows; order with ``ordered``."""
    params.check(window_minutes=window_minutes, threshold=threshold)
    attempts = failed_logins(logs, start, end, source_ip, as_of)
    nodes = attempts_per_instant(attempts)
    flagged = (
        _windows(nodes, Slots.of(window_minutes * MINUTE), threshold)
        .groupBy("source_ip").agg(F.count("*").alias("window_count"))
    )
    at = micros("timestamp")
    totals = attempts.groupBy("source_ip").agg(
        F.count("*").alias("total_attempts"),
        from_micros(F.min(at)).alias("first_attempt"),
        from_micros(F.max(at)).alias("last_attempt"),
    )
    users = usernames_tried(attempts).groupBy("source_ip").agg(
        F.count("*").alias("unique_usernames_attempted"))
    return (
        totals.join(flagged, "source_ip").join(users, "source_ip", "left")
        .fillna(0, ["unique_usernames_attempted"])
        .withColumn("severity", by_bounds(BRUTE_FORCE_BOUNDS))
        .select("source_ip", "total_attempts", "unique_usernames_attempted", "first_attempt",
                "last_attempt", "window_count", "severity")
    )


def usernames_tried(attempts: DataFrame) -> DataFrame:
    """The distinct users each source tried, one per row: a source may try millions."""
    return attempts.where(F.col("username") != "").select("source_ip", "username").distinct()


def window_attempts(
    logs: DataFrame,
    window_minutes: int = 15,
    threshold: int = 5,
    start: datetime | None = None,
    end: datetime | None = None,
    source_ip: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """The single attempts of every attack window, one per row."""
    params.check(window_minutes=window_minutes, threshold=threshold)
    attempts = failed_logins(logs, start, end, source_ip, as_of)
    slots = Slots.of(window_minutes * MINUTE)
    # Written first: with a known size the join with the log is a broadcast when it may be.
    windows = settle(_windows(attempts_per_instant(attempts), slots, threshold).select(
        "source_ip", F.col("at").alias("opened")), "login-windows")
    rows = attempts.select("source_ip", "timestamp", "username", "log_id", micros("timestamp").alias("at"))
    return in_windows(rows, windows, ["source_ip"], slots).select(
        "source_ip", from_micros("opened").alias("window_start"), "timestamp", "username", "log_id")


def detection_order() -> list[Column]:
    """Most attempts first."""
    return [F.desc("total_attempts"), F.asc("source_ip")]


def ordered(detections: DataFrame) -> DataFrame:
    return detections.orderBy(*detection_order())


def timeline(
    logs: DataFrame,
    source_ip: str,
    start: datetime | None = None,
    end: datetime | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """All failed logins of one source, newest first."""
    rows = failed_logins(logs, start, end, source_ip, as_of)
    return rows.select("timestamp", "username", "log_id").orderBy(F.desc("timestamp"), "log_id")


def timeline_total(
    logs: DataFrame,
    source_ip: str,
    start: datetime | None = None,
    end: datetime | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """How many failed logins the timeline of a source has."""
    rows = failed_logins(logs, start, end, source_ip, as_of)
    return rows.agg(F.count("*").alias("total_attempts")).withColumn("source_ip", F.lit(source_ip))
