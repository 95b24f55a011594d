"""The dashboard: alerts, threat counts, busiest sources and health over the last day."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.times import ntz
from palisade.operators import stats
from palisade.operators.filters import in_range
from palisade.plans import threats
from palisade.plans.threats import DetectorSettings

DETECTION_HOURS = 24
TOP_DAYS = 7
TOP_IPS = 10


@dataclass(frozen=True)
class Dashboard:
    alerts: DataFrame
    threats: DataFrame
    top_ips: DataFrame
    health: DataFrame
    score: DataFrame


def dashboard(logs: DataFrame, as_of: datetime, settings: DetectorSettings = DetectorSettings()) -> Dashboard:
    found = threats.detect_all(logs, as_of - timedelta(hours=DETECTION_HOURS), as_of, settings)
    summary, state = threats.threat_summary(found), health(logs, as_of)
    return Dashboard(threats.active_alerts(found), summary, top_ips(logs, as_of), state, score(summary, state))


def health(logs: DataFrame, as_of: datetime) -> DataFrame:
    """Rows and HIGH rows of the last day, and the newest timestamp overall.

    The counts read the last day alone. Of a table with ``log_date`` the newest timestamp is
    looked for in its newest day, which is known from the folders when the scan starts.
    """
    one = F.lit(1).alias("one")
    counts = in_range(logs, as_of - timedelta(hours=24), as_of).agg(
        F.count("*").alias("total_logs_24h"), F.count_if(F.col("severity") == "HIGH").alias("high_severity_logs_24h"))
    last = logs
    if "log_date" in logs.columns:
        last = logs.where(F.col("log_date") == logs.select(F.max("log_date")).scalar())
    newest = last.agg(F.max("timestamp").alias("last_log_timestamp"))
    return counts.select(one, "*").join(newest.select(one, "*"), "one").drop("one")


def score(summary: DataFrame, state: DataFrame) -> DataFrame:
    """The dashboard score from the threat row and the health row."""
    one = F.lit(1).alias("one")
    both = summary.select(one, "*").join(state.select(one, "*"), "one")
    return both.select(threats.dashboard_score(
        F.col("critical_threats"), F.col("high_threats"),
        F.col("total_logs_24h"), F.col("high_severity_logs_24h")).alias("score"))


def top_ips(logs: DataFrame, as_of: datetime, limit: int = TOP_IPS) -> DataFrame:
    """The busiest sources of the last seven days, each with the time it was last seen.

    Only when these days hold no row at all the whole log is used, in the same job: where the
    scan begins is a scalar that is known before it, and on a table with ``log_date`` it
    prunes folders.
    """
    since = as_of - timedelta(days=TOP_DAYS)
    named = logs.where(F.col("source_ip").isNotNull())
    # A single row: null when the last days are empty, and then nothing is left out.
    some = in_range(named, since, as_of).limit(1).agg(F.when(F.count("*") > 0, ntz(since)).alias("since")).scalar()
    # Rows after `as_of` do not count, but may be where a source was last seen.
    scanned = named.where(F.coalesce(F.col("timestamp") >= some, some.isNull()))
    if "log_date" in logs.columns:
        first = F.lit("0001-01-01").cast("date")
        scanned = scanned.where(F.coalesce(F.col("log_date"), first) >= F.coalesce(some.cast("date"), first))
    counted = F.coalesce(some.isNull() | (F.col("timestamp") <= ntz(as_of)), F.lit(False))
    return _counted(scanned, counted).orderBy(F.desc("total_logs"), "source_ip").limit(limit)


def _counted(logs: DataFrame, counted) -> DataFrame:
    per_ip = logs.groupBy("source_ip").agg(
        F.count_if(counted).alias("total_logs"),
        *[F.count_if(counted & (F.col("severity") == s)).alias(s.lower()) for s in stats.BREAKDOWN],
        F.max("timestamp").alias("last_seen"),
    )
    return per_ip.where(F.col("total_logs") > 0)
