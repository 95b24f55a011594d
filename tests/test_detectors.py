"""Detector edge cases, severities, and busy keys."""

import bisect
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palisade.functions.severity import (
    BRUTE_FORCE_BOUNDS, DISTRIBUTED_FLOOD_BOUNDS, PORT_SCAN_BOUNDS, SINGLE_FLOOD_BOUNDS, by_bounds)
from palisade.operators import brute_force, floods, port_scan
from palisade.schema import LOG_SCHEMA

DAY = datetime(2024, 1, 1)
WHOLE = {"start": datetime(2000, 1, 1), "end": datetime(2100, 1, 1)}


def logs(spark, rows):
    """rows: (seconds, ip, port, protocol)."""
    return spark.createDataFrame([
        (i, DAY + timedelta(seconds=s), ip, port, protocol, "auth.log", "SSH_FAILED_LOGIN", "HIGH", "u", "")
        for i, (s, ip, port, protocol) in enumerate(rows)], LOG_SCHEMA)


def minutes(*values):
    return [(int(v * 60), "a", 22, "TCP") for v in values]


@pytest.mark.parametrize("rows,want", [
    (minutes(0, 1, 2, 3, 15), [(0, 15, 5)]),                       # the end is included
    (minutes(0, 1, 2, 3) + [(901, "a", 22, "TCP")], []),           # one second later it is not
    (minutes(0, 1, 2, 3, 4, 16, 17, 18, 19, 20), [(0, 4, 5), (16, 20, 5)]),
    (minutes(0, 20, 21, 22, 23, 24), [(20, 24, 5)]),
    (minutes(0, 0, 0, 0, 0), [(0, 0, 5)]),
])
def test_brute_force_windows(spark, rows, want):
    got = brute_force.brute_force_windows(logs(spark, rows), **WHOLE).orderBy("window_start").collect()
    at = lambda t: int((t - DAY).total_seconds() // 60)
    assert [(at(r.window_start), at(r.window_end), r.attempt_count) for r in got] == want


def test_port_scan_needs_distinct_ports_and_rows(spark):
    nine = [(i * 10, "a", 8000 + i % 9, "TCP") for i in range(30)]
    assert port_scan.detect_port_scan(logs(spark, nine), **WHOLE).count() == 0
    ten = nine + [(290, "a", 9000, "TCP"), (291, "a", None, "TCP")]
    found = port_scan.detect_port_scan(logs(spark, ten), **WHOLE).first()
    assert (found.total_attempts, found.unique_ports_attempted, found.window_count, found.severity) == (31, 10, 1, "MEDIUM")
    few = [(i, "a", i, "TCP") for i in range(12)]
    assert port_scan.port_scan_windows(logs(spark, few), **WHOLE).count() == 0
    assert port_scan.port_scan_windows(logs(spark, few), min_total_attempts=12, **WHOLE).first().unique_ports == 12


def test_rows_without_a_port_are_no_part_of_a_scan(spark):
    rows = [(i, "a", 100 + i, "TCP") for i in range(12)] + [(i, "a", None, "TCP") for i in range(20)]
    assert port_scan.detect_port_scan(logs(spark, rows), min_total_attempts=20, **WHOLE).count() == 0
    assert port_scan.port_scan_windows(logs(spark, rows), min_total_attempts=20, **WHOLE).count() == 0
    found = port_scan.detect_port_scan(logs(spark, rows), min_total_attempts=12, **WHOLE).first()
    assert (found.total_attempts, found.unique_ports_attempted) == (12, 12)


def scan_loop(rows, width=600, least_ports=10, least_rows=20):
    """The definition: rows with a source and a port, one source at a time, in time order."""
    by_source = {}
    for second, source, port, _ in rows:
        if source and port is not None:
            by_source.setdefault(source, []).append((second, port))
    out = []
    for source, mine in by_source.items():
        mine.sort(key=lambda r: r[0])
        i = 0
        while len(mine) >= least_rows and i < len(mine):
            inside = [r for r in mine[i:] if r[0] <= mine[i][0] + width]
            ports = {p for _, p in inside}
            if len(ports) >= least_ports:
                out.append((source, len(inside), len(ports), mine[i][0], inside[-1][0]))
                i += len(inside)
            else:
                i += 1
    return sorted(out)


def scan_series(seed=7):
    rng = random.Random(seed)
    return [(rng.randint(0, 20000), rng.choice(["a", "b", "c", "", None]), rng.choice([None, *range(30)]), "TCP") for _ in range(1500)]


def test_port_scan_windows_equal_a_plain_loop(spark):
    rows = scan_series()
    second = lambda t: int((t - DAY).total_seconds())
    got = port_scan.port_scan_windows(logs(spark, rows), **WHOLE).collect()
    assert sorted((r.source_ip, r.attempt_count, r.unique_ports, second(r.window_start), second(r.window_end)) for r in got) == scan_loop(rows) != []


def test_tumbling_windows(spark):
    rows = [(s, "a", 80, "TCP") for s in (0, 30, 60, 61, 120, 122)]
    got = floods.single_flood_windows(logs(spark, rows), 60, 1, **WHOLE).orderBy("window_start").collect()
    assert [(r.window_start.minute * 60 + r.window_start.second, r.request_count) for r in got] == [(0, 3), (61, 2), (122, 1)]
    assert [r.window_end - r.window_start for r in got] == [timedelta(seconds=s) for s in (60, 60, 0)]
    assert (got[1].window_end - DAY).total_seconds() == 121


def test_flood_in_one_instant(spark):
    found = floods.detect_single_floods(logs(spark, [(5, "a", 0, "")] * 100), **WHOLE).first()
    assert (found.avg_request_rate, found.peak_request_rate, found.target_ports, found.target_protocols) == (100.0, 100.0, [], [])


def test_distributed_floods(spark):
    rows = [(i % 50, f"ip{i % 12}", None, None) for i in range(600)]
    rows += [(i % 50, f"ip{i % 9}", 80, "TCP") for i in range(600)]        # too few sources
    rows += [(0, None, 81, "TCP")] * 490 + [(1, f"s{i}", 81, "TCP") for i in range(10)]  # rows without a source count
    got = floods.detect_distributed_floods(logs(spark, rows), **WHOLE).orderBy("total_requests").collect()
    assert [(r.target_port, r.target_protocol, r.total_requests, r.source_ip_count, r.peak_unique_ips) for r in got] == [
        (81, "TCP", 500, 10, 10), (None, None, 600, 12, 12)]
    assert got[1].source_ips[:3] == ["ip0", "ip1", "ip10"] and got[1].top_attacking_ips[0].requests == 50
    assert floods.detect_distributed_floods(logs(spark, rows), destination_port=81, **WHOLE).count() == 1


def test_busy_source(spark):
    """One source holds most rows and never pauses: many carried slots, many windows."""
    hot = spark.range(200_000).select(
        F.col("id").alias("log_id"),
        (F.lit(DAY).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") % 86_400 * 2).cast("decimal(18,6)"))).alias("timestamp"),
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("ip"), (F.col("id") % 997).cast("string"))).alias("source_ip"),
        F.lit("SSH_FAILED_LOGIN").alias("event_type"), F.lit("u").alias("username"))
    got = brute_force.detect_brute_force(hot, **WHOLE).where("source_ip = 'hot'").first()
    assert got.total_attempts == 160_000 and got.severity == "CRITICAL"
    per_instant = {}
    for i in range(200_000):
        if i % 10 < 8:
            per_instant[i % 86_400 * 2] = per_instant.get(i % 86_400 * 2, 0) + 1
    times, windows, i = sorted(per_instant), 0, 0
    while i < len(times):
        j = bisect.bisect_right(times, times[i] + 900)
        if sum(per_instant[t] for t in times[i:j]) >= 5:
            windows, i = windows + 1, j
        else:
            i += 1
    assert got.window_count == windows > 150


@pytest.mark.parametrize("bounds,row,want", [
    (BRUTE_FORCE_BOUNDS, (9, 1), "LOW"), (BRUTE_FORCE_BOUNDS, (10, 1), "MEDIUM"), (BRUTE_FORCE_BOUNDS, (20, 1), "HIGH"),
    (BRUTE_FORCE_BOUNDS, (9, 3), "HIGH"), (BRUTE_FORCE_BOUNDS, (50, 1), "CRITICAL"), (BRUTE_FORCE_BOUNDS, (9, 5), "CRITICAL"),
])
def test_brute_force_severity(spark, bounds, row, want):
    frame = spark.createDataFrame([row], "total_attempts int, window_count int")
    assert frame.select(by_bounds(bounds)).first()[0] == want


def test_other_severities(spark):
    frame = spark.createDataFrame([(25, 1, 20, 199.0, 3)],
                                  "unique_ports_attempted int, window_count int, total_attempts int, peak_request_rate double, source_ip_count int")
    assert frame.select(by_bounds(PORT_SCAN_BOUNDS), by_bounds(SINGLE_FLOOD_BOUNDS),
                        by_bounds(DISTRIBUTED_FLOOD_BOUNDS)).first()[:] == ("HIGH", "LOW", "LOW")


@pytest.mark.parametrize("call", [
    lambda t: brute_force.detect_brute_force(t, 0, **WHOLE),
    lambda t: brute_force.brute_force_windows(t, threshold=1001, **WHOLE),
    lambda t: port_scan.detect_port_scan(t, unique_ports_threshold=1, **WHOLE),
    lambda t: floods.detect_floods(t, window_seconds=3601, **WHOLE),
    lambda t: brute_force.detect_brute_force(t),
])
def test_bad_parameters(spark, call):
    with pytest.raises(ValueError):
        call(logs(spark, minutes(0)))


def test_default_ranges(spark):
    rows = logs(spark, minutes(0, 1, 2, 3, 4))
    found = lambda hours: brute_force.detect_brute_force(rows, as_of=DAY + timedelta(hours=hours)).count()
    assert (found(24), found(25)) == (1, 0)


def test_no_python_and_no_nested_loop(spark, small):
    from palisade.sources.event_view import read_logs

    table = read_logs(spark, small)
    for frame in (brute_force.detect_brute_force(table, **WHOLE), port_scan.detect_port_scan(table, **WHOLE),
                  floods.detect_floods(table, **WHOLE)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
