"""Port scans: many distinct destination ports of one source within a time window."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.severity import PORT_SCAN_BOUNDS, by_bounds, rank
from palisade.functions.times import MINUTE, from_micros, lookback, micros
from palisade.operators import params
from palisade.operators.filters import in_range
from palisade.operators.windows import Slots, ahead_distinct, greedy_windows, in_windows, with_bounds
from palisade.session import settle

LOOKBACK_HOURS = 24
LISTED_PORTS = 100       # per source
WINDOW_PORTS = 50        # per window
WINDOW_ATTEMPTS = 50     # per window


def scan_rows(
    logs: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    source_ip: str | None = None,
    protocol: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """The rows the detector looks at: those with a source and a port. The default range is
    the day before ``as_of``."""
    start, end = lookback(start, end, as_of, LOOKBACK_HOURS)
    rows = in_range(logs, start, end).where((F.col("source_ip") != "") & F.col("destination_port").isNotNull())
    if source_ip:
        rows = rows.where(F.col("source_ip") == source_ip)
    return rows.where(F.col("protocol") == protocol) if protocol else rows


def _nodes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_ip", micros("timestamp").alias("at"), F.col("destination_port").alias("port")).agg(
        F.count("*").alias("c"))


def _ports(rows: DataFrame) -> DataFrame:
    """Rows, first and last instant per source and port: as many rows as there are such pairs."""
    at = micros("timestamp")
    return rows.groupBy("source_ip", F.col("destination_port").alias("port")).agg(
        F.count("*").alias("c"), F.min(at).alias("first"), F.max(at).alias("last"))


def _totals(ports: DataFrame, min_total_attempts: int) -> DataFrame:
    """Totals of the sources with enough rows; the others are left out altogether."""
    return ports.groupBy("source_ip").agg(
        F.sum("c").alias("total_attempts"),
        from_micros(F.min("first")).alias("first_attempt"),
        from_micros(F.max("last")).alias("last_attempt"),
    ).where(F.col("total_attempts") >= min_total_attempts)


def _windows(nodes: DataFrame, slots: Slots, unique_ports_threshold: int) -> DataFrame:
    ahead = ahead_distinct(nodes, ["source_ip"], "port", slots, least=unique_ports_threshold)
    return greedy_windows(ahead.where(F.col("k") >= unique_ports_threshold), ["source_ip"], slots, ["n", "k", "until"])


def port_scan_windows(
    logs: DataFrame,
    window_minutes: int = 10,
    unique_ports_threshold: int = 10,
    min_total_attempts: int = 20,
    start: datetime | None = None,
    end: datetime | None = None,
    source_ip: str | None = None,
    protocol: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """The attack windows: source_ip, attempt_count, unique_ports, window_start, window_end."""
    params.check(window_minutes=window_minutes, unique_ports_threshold=unique_ports_threshold,
                 min_total_attempts=min_total_attempts)
    rows = scan_rows(logs, start, end, source_ip, protocol, as_of)
    chosen = _windows(_nodes(rows), Slots.of(window_minutes * MINUTE), unique_ports_threshold)
    kept = chosen.join(_totals(_ports(rows), min_total_attempts).select("source_ip"), "source_ip", "left_semi")
    return with_bounds(kept.withColumnsRenamed({"n": "attempt_count", "k": "unique_ports"}))


def detect_port_scan(
    logs: DataFrame,
    window_minutes: int = 10,
    unique_ports_threshold: int = 10,
    min_total_attempts: int = 20,
    start: datetime | None = None,
    end: datetime | None = None,
    source_ip: str | None = None,
    protocol: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """One row per scanning source. ``unique_ports_attempted`` counts all its ports in the
    range; ``ports_attempted`` lists the lowest hundred of them."""
    params.check(window_minutes=window_minutes, unique_ports_threshold=unique_ports_threshold,
                 min_total_attempts=min_total_attempts)
    rows = scan_rows(logs, start, end, source_ip, protocol, as_of)
    flagged = (
        _windows(_nodes(rows), Slots.of(window_minutes * MINUTE), unique_ports_threshold)
        .groupBy("source_ip").agg(F.count("*").alias("window_count"))
    )
    ports = settle(_ports(rows), "ports-tried")
    port_counts = ports.groupBy("source_ip").agg(F.count("*").alias("unique_ports_attempted"))
    return (
        _totals(ports, min_total_attempts)
        .join(flagged, "source_ip").join(port_counts, "source_ip")
        .join(_first_ports(ports, ["source_ip"], LISTED_PORTS, "ports_attempted"), "source_ip")
        .withColumn("severity", by_bounds(PORT_SCAN_BOUNDS))
        .select("source_ip", "total_attempts", "unique_ports_attempted", "ports_attempted",
                "first_attempt", "last_attempt", "window_count", "severity")
    )


def _first_ports(ports: DataFrame, keys: list[str], limit: int, name: str) -> DataFrame:
    """The lowest ports of each key as an array. The limit is applied before the shuffle too."""
    lowest = F.row_number().over(Window.partitionBy(*keys).orderBy("port"))
    return (
        ports.withColumn("place", lowest).where(F.col("place") <= limit)
        .groupBy(*keys).agg(F.sort_array(F.collect_list("port")).alias(name))
    )


def window_details(
    logs: DataFrame,
    window_minutes: int = 10,
    unique_ports_threshold: int = 10,
    min_total_attempts: int = 20,
    start: datetime | None = None,
    end: datetime | None = None,
    source_ip: str | None = None,
    protocol: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """The attack windows with their lowest fifty ports and first fifty attempts as arrays.

    The windows are written first: their size is then known, so the join with the log is a
    broadcast when they are small and a shuffle when they are not.
    """
    found = settle(port_scan_windows(logs, window_minutes, unique_ports_threshold, min_total_attempts,
                                     start, end, source_ip, protocol, as_of), "scan-windows")
    opened = found.select("source_ip", micros("window_start").alias("opened"))
    rows = scan_rows(logs, start, end, source_ip, protocol, as_of).select(
        "source_ip", "timestamp", F.col("destination_port").alias("port"), "protocol", "log_id",
        micros("timestamp").alias("at"))
    inside = in_windows(rows, opened, ["source_ip"], Slots.of(window_minutes * MINUTE))
    key = ["source_ip", "opened"]
    ports = _first_ports(
        inside.select(*key, "port").distinct(), key, WINDOW_PORTS, "ports")
    earliest = F.row_number().over(Window.partitionBy(*key).orderBy("at", "log_id"))
    attempts = (
        inside.withColumn("place", earliest).where(F.col("place") <= WINDOW_ATTEMPTS)
        .groupBy(*key).agg(F.sort_array(F.collect_list(
            F.struct("timestamp", "log_id", F.col("port").alias("destination_port"), "protocol"))).alias("attempts"))
    )
    return (
        found.withColumn("opened", micros("window_start"))
        .join(ports, key).join(attempts, key).drop("opened")
    )


def detection_order() -> list[Column]:
    """Most severe first, then most ports, then most attempts."""
    return [F.desc(rank("severity")), F.desc("unique_ports_attempted"), F.desc("total_attempts"), F.asc("source_ip")]


def ordered(detections: DataFrame) -> DataFrame:
    return detections.orderBy(*detection_order())
