"""Floods: a request rate too high for one source, or for one target from many sources.

Windows here are tumbling but anchored in the data: the first row of a key opens one, and
the first row after its cover opens the next, whether or not it was an attack.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.severity import DISTRIBUTED_FLOOD_BOUNDS, SINGLE_FLOOD_BOUNDS, by_bounds, rank
from palisade.functions.times import SECOND, from_micros, lookback, micros
from palisade.operators import params
from palisade.operators.filters import in_range
from palisade.operators.windows import Slots, ahead_counts, greedy_windows, in_windows
from palisade.session import settle, together

LOOKBACK_HOURS = 1
WINDOW_ATTACKERS = 10
TARGET_ATTACKERS = 20
# A target is a (port, protocol) pair in which either may be missing. Keys must not be
# null, so a missing port is held as -1 and a present protocol is marked with "=".
TARGET = ["port_key", "protocol_key"]


def flood_rows(
    logs: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    destination_port: int | None = None,
    protocol: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """The rows the detectors look at; the default range is the hour before ``as_of``."""
    start, end = lookback(start, end, as_of, LOOKBACK_HOURS)
    rows = in_range(logs, start, end)
    if destination_port:
        rows = rows.where(F.col("destination_port") == destination_port)
    if protocol:
        rows = rows.where(F.col("protocol") == protocol)
    return rows


def _sources(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("source_ip") != "").withColumn("at", micros("timestamp"))


def _targets(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.coalesce("destination_port", F.lit(-1)).alias("port_key"),
        F.coalesce(F.concat(F.lit("="), "protocol"), F.lit("")).alias("protocol_key"),
        F.nullif("source_ip", F.lit("")).alias("source_ip"),
        micros("timestamp").alias("at"),
    )


def _target_columns() -> list:
    return [
        F.nullif("port_key", F.lit(-1)).alias("target_port"),
        F.when(F.col("protocol_key") != "", F.expr("substring(protocol_key, 2)")).alias("target_protocol"),
    ]


@dataclass(frozen=True)
class Tumbling:
    """Windows with at least so many rows (keys, ``opened``, ``closed``, ``request_count``), what
    was counted on the way (keys, ``at``, ``c``), and the keys that have such windows at all."""

    windows: DataFrame
    counted: DataFrame
    busy: DataFrame

    def totals(self, keys: list[str], flagged: DataFrame) -> DataFrame:
        return _key_totals(self.counted.join(flagged, keys, "left_semi"), keys)


def _tumbling(rows: DataFrame, keys: list[str], window_seconds: int, threshold: int) -> Tumbling:
    """The windows of all keys. A window closes one width after it opened, or with the last row of its key.

    The log is read once, into a written table of instants, which is dealt by (key, slot) when
    rows ahead are counted. Only keys that somewhere have enough rows within one width can
    have such a window; all others stay out of the window choice, which for floods has every
    instant as a candidate.
    """
    slots = Slots.of(window_seconds * SECOND)
    ahead = settle(
        ahead_counts(_per_instant(rows, keys), keys, slots).select(*keys, "slot", "at", "side", "c", "n"), "instants")
    counted = ahead.where(F.col("side") == 0)
    busy = settle(
        counted.groupBy(*keys).agg(F.max("at").alias("last"), F.max("n").alias("most"))
        .where(F.col("most") >= threshold).select(*keys, "last"), "busy-keys")
    nodes = ahead.join(busy, keys, "left_semi")
    chosen = greedy_windows(nodes, keys, slots, ["n"]).where(F.col("n") >= threshold)
    windows = chosen.join(busy, keys).select(
        *keys,
        F.col("at").alias("opened"),
        F.least(F.col("at") + slots.width, "last").alias("closed"),
        F.col("n").alias("request_count"),
        (F.col("n") / F.lit(window_seconds / 60)).alias("request_rate_per_min"),
    )
    return Tumbling(windows, counted.select(*keys, "at", "c"), busy)


def _per_instant(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counting starts before the shuffle: a flooding key costs only its instants."""
    return rows.groupBy(*keys, "at").agg(F.count("*").alias("c"))


def _key_totals(nodes: DataFrame, keys: list[str]) -> DataFrame:
    first, last, total = F.min("at"), F.max("at"), F.sum("c")
    minutes = (last - first) / F.lit(60.0 * SECOND)
    return nodes.groupBy(*keys).agg(
        total.alias("total_requests"),
        F.when(last > first, total / minutes).otherwise(total.cast("double")).alias("avg_request_rate"),
        from_micros(first).alias("first_request"),
        from_micros(last).alias("last_request"),
    )


# --- one source ------------------------------------------------------------------------


def single_flood_windows(
    logs: DataFrame,
    window_seconds: int = 60,
    single_ip_threshold: int = 100,
    **scope,
) -> DataFrame:
    """Attack windows of single sources."""
    params.check(window_seconds=window_seconds, single_ip_threshold=single_ip_threshold)
    rows = _sources(flood_rows(logs, **scope))
    return _dated(_tumbling(rows, ["source_ip"], window_seconds, single_ip_threshold).windows)


def detect_single_floods(
    logs: DataFrame,
    window_seconds: int = 60,
    single_ip_threshold: int = 100,
    **scope,
) -> DataFrame:
    """One row per flooding source."""
    params.check(window_seconds=window_seconds, single_ip_threshold=single_ip_threshold)
    rows = _sources(flood_rows(logs, **scope))
    found = _tumbling(rows, ["source_ip"], window_seconds, single_ip_threshold)
    flagged = settle(
        found.windows.groupBy("source_ip").agg(
            F.count("*").alias("window_count"),
            F.max("request_rate_per_min").alias("peak_request_rate")),
        "flood-sources")
    # Ports and protocols of the flagged sources. Distinct first: what is then listed is no
    # longer than the set of ports that exist.
    mine = rows.join(flagged, "source_ip", "left_semi")
    seen = mine.select("source_ip", "destination_port", "protocol").distinct()
    targets = seen.groupBy("source_ip").agg(
        F.sort_array(F.collect_set(F.nullif("destination_port", F.lit(0)))).alias("target_ports"),
        F.sort_array(F.collect_set(F.nullif("protocol", F.lit("")))).alias("target_protocols"))
    return (
        found.totals(["source_ip"], flagged).join(flagged, "source_ip")
        .join(targets, "source_ip")
        .withColumn("severity", by_bounds(SINGLE_FLOOD_BOUNDS))
        .select(
            F.lit("SINGLE_IP_FLOOD").alias("attack_type"),
            F.array("source_ip").alias("source_ips"),
            F.lit(1).cast("bigint").alias("source_ip_count"),
            "total_requests", "peak_request_rate", "avg_request_rate",
            "target_ports", "target_protocols", "first_request", "last_request", "window_count", "severity",
        )
    )


def single_flood_window_counts(
    logs: DataFrame,
    window_seconds: int = 60,
    single_ip_threshold: int = 100,
    **scope,
) -> DataFrame:
    """Requests per attack window, port and protocol. A missing or zero port is null."""
    windows = settle(single_flood_windows(logs, window_seconds, single_ip_threshold, **scope), "flood-windows")
    opened = windows.select("source_ip", micros("window_start").alias("opened"))
    rows = _sources(flood_rows(logs, **scope)).select(
        "source_ip", "at",
        F.nullif("destination_port", F.lit(0)).alias("port"),
        F.nullif("protocol", F.lit("")).alias("protocol"))
    return (
        in_windows(rows, opened, ["source_ip"], Slots.of(window_seconds * SECOND))
        .groupBy("source_ip", from_micros("opened").alias("window_start"), "port", "protocol")
        .agg(F.count("*").alias("requests"))
    )


def window_maps(counts: DataFrame) -> DataFrame:
    """Per window: requests per port and per protocol, as maps."""
    key = ["source_ip", "window_start"]

    def as_map(column: str, name: str) -> DataFrame:
        sums = counts.where(F.col(column).isNotNull()).groupBy(*key, column).agg(F.sum("requests").alias("requests"))
        return sums.groupBy(*key).agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "requests")))).alias(name))

    return (
        counts.select(*key).distinct()
        .join(as_map("port", "target_ports"), key, "left")
        .join(as_map("protocol", "protocols"), key, "left")
    )


# --- one target, many sources ----------------------------------------------------------


def _distributed(
    rows: DataFrame,
    window_seconds: int,
    ip_count: int,
    request_threshold: int,
) -> tuple[Tumbling, DataFrame, DataFrame, DataFrame]:
    """All windows, the attack windows among them, the requests of each source inside busy
    windows, and those of each source and instant of busy targets."""
    found = _tumbling(rows, TARGET, window_seconds, request_threshold)
    busy = settle(found.windows, "busy-windows")
    # The second and last read of the log: requests per source and instant of busy targets.
    sources = settle(
        rows.where(F.col("source_ip").isNotNull()).join(found.busy, TARGET, "left_semi")
        .groupBy(*TARGET, "at", "source_ip").agg(F.count("*").alias("c")), "target-sources")
    hits = (
        in_windows(sources, busy.select(*TARGET, "opened"), TARGET, Slots.of(window_seconds * SECOND))
        .groupBy(*TARGET, "opened", "source_ip").agg(F.sum("c").alias("requests"))
    )
    breadth = _breadth(hits, [*TARGET, "opened"], "unique_ip_count")
    wide = busy.join(breadth.where(F.col("unique_ip_count") >= ip_count), [*TARGET, "opened"])
    return found, wide, hits, sources


def distributed_flood_windows(
    logs: DataFrame,
    window_seconds: int = 60,
    distributed_ip_count: int = 10,
    distributed_request_threshold: int = 500,
    **scope,
) -> DataFrame:
    """Attack windows of (port, protocol) targets, with the busiest ten sources of each."""
    params.check(window_seconds=window_seconds, distributed_ip_count=distributed_ip_count,
                 distributed_request_threshold=distributed_request_threshold)
    rows = _targets(flood_rows(logs, **scope))
    _, windows, hits, _ = _distributed(rows, window_seconds, distributed_ip_count, distributed_request_threshold)
    key = [*TARGET, "opened"]
    top = _busiest(hits, key, WINDOW_ATTACKERS)
    return _dated(windows.join(top, key).select("*", *_target_columns()).drop(*TARGET))


def detect_distributed_floods(
    logs: DataFrame,
    window_seconds: int = 60,
    distributed_ip_count: int = 10,
    distributed_request_threshold: int = 500,
    **scope,
) -> DataFrame:
    """One row per flooded target. A target too narrow or too quiet has no windows and no row."""
    params.check(window_seconds=window_seconds, distributed_ip_count=distributed_ip_count,
                 distributed_request_threshold=distributed_request_threshold)
    rows = _targets(flood_rows(logs, **scope))
    found, windows, _, sources = _distributed(rows, window_seconds, distributed_ip_count, distributed_request_threshold)
    flagged = settle(
        windows.groupBy(*TARGET).agg(
            F.count("*").alias("window_count"),
            F.max("request_rate_per_min").alias("peak_request_rate"),
            F.max("unique_ip_count").alias("peak_unique_ips")),
        "flooded-targets")
    hits = (
        sources.join(flagged, TARGET, "left_semi")
        .groupBy(*TARGET, "source_ip").agg(F.sum("c").alias("requests"))
    )
    breadth = _breadth(hits, TARGET, "source_ip_count")
    return (
        found.totals(TARGET, flagged).join(flagged, TARGET).join(breadth, TARGET)
        .join(_busiest(hits, TARGET, TARGET_ATTACKERS), TARGET)
        .withColumn("severity", by_bounds(DISTRIBUTED_FLOOD_BOUNDS))
        .select(
            F.lit("DISTRIBUTED_FLOOD").alias("attack_type"),
            F.transform("top_attacking_ips", lambda x: x["source_ip"]).alias("source_ips"),
            "source_ip_count", "total_requests", "peak_request_rate", "avg_request_rate",
            "peak_unique_ips", *_target_columns(), "first_request", "last_request",
            "window_count", "top_attacking_ips", "severity",
        )
    )


def _breadth(hits: DataFrame, key: list[str], name: str) -> DataFrame:
    """The number of sources per key.

    The condition always holds. It keeps the request counts in the plan, so that this and
    the ranking of the same sources are one shuffle and one read of the log, not two.
    """
    return hits.where(F.col("requests") > 0).groupBy(*key).agg(F.count("*").alias(name))


def _busiest(hits: DataFrame, key: list[str], limit: int) -> DataFrame:
    """The sources with most requests per key, most first, as (source_ip, requests) structs.

    Ranking under a limit is cut before the shuffle as well, so a target with millions of
    sources sends only a few of them on.
    """
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("requests"), "source_ip"))
    listed = F.sort_array(F.collect_list(F.struct("place", "source_ip", "requests")))
    return (
        hits.withColumn("place", place).where(F.col("place") <= limit)
        .groupBy(*key).agg(listed.alias("listed"))
        .select(*key, F.transform("listed", lambda x: F.struct(
            x["source_ip"].alias("source_ip"), x["requests"].alias("requests"))).alias("top_attacking_ips"))
    )


# --- both ------------------------------------------------------------------------------


def detect_floods(
    logs: DataFrame,
    window_seconds: int = 60,
    single_ip_threshold: int = 100,
    distributed_ip_count: int = 10,
    distributed_request_threshold: int = 500,
    **scope,
) -> DataFrame:
    """Both kinds together; fields of the other kind are null."""
    single, distributed = together(
        lambda: detect_single_floods(logs, window_seconds, single_ip_threshold, **scope),
        lambda: detect_distributed_floods(logs, window_seconds, distributed_ip_count,
                                          distributed_request_threshold, **scope))
    return single.unionByName(distributed, allowMissingColumns=True)


def detection_order() -> list[Column]:
    """Most severe first, then the highest peak."""
    return [F.desc(rank("severity")), F.desc("peak_request_rate"), F.array_join("source_ips", ",")]


def ordered(detections: DataFrame) -> DataFrame:
    return detections.orderBy(*detection_order())


def _dated(windows: DataFrame) -> DataFrame:
    rest = [c for c in windows.columns if c not in ("opened", "closed")]
    return windows.select(
        *rest, from_micros("opened").alias("window_start"), from_micros("closed").alias("window_end"))
