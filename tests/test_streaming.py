"""Streams give what batch gives, over several batches, restarts and late rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palisade.functions.times import ntz
from palisade.operators import brute_force, floods, port_scan
from palisade.schema import LOG_SCHEMA
from palisade.sources.event_view import logs_as_lines, read_logs
from palisade.sources.parsers import parse_lines, records
from palisade.sources.tables import read_logs as read_table
from palisade.streaming import detect, ingest, stats

WHOLE = {"start": datetime(2000, 1, 1), "end": datetime(2100, 1, 1)}


@pytest.fixture(scope="module")
def files(spark, small, tmp_path_factory):
    """The log in time order as several files, then one row far in the future that moves
    the watermark past everything."""
    folder = str(tmp_path_factory.mktemp("stream"))
    logs = read_logs(spark, small)
    days = logs.withColumn("part", F.dayofmonth("timestamp"))
    for low, high in ((1, 7), (8, 14), (15, 22), (23, 31)):
        days.where(F.col("part").between(low, high)).drop("part").coalesce(1).write.mode("append").parquet(folder)
    for _ in range(2):
        logs.limit(1).withColumns({
            "timestamp": ntz(datetime(2050, 1, 1)), "source_ip": F.lit("later"), "event_type": F.lit("SSH_FAILED_LOGIN"),
        }).coalesce(1).write.mode("append").parquet(folder)
    return folder


def run(spark, frame, tmp_path):
    """All available batches, one file each."""
    name = "t" + tmp_path.name.replace("-", "_")
    query = (frame.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name)


def source(spark, files):
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(files)


def rows(frame, *columns):
    return sorted(tuple(str(v) for v in r) for r in frame.select(*columns).collect() if "later" not in r)


def test_brute_force(spark, small, files, tmp_path):
    columns = ("source_ip", "attempt_count", "window_start", "window_end")
    got = run(spark, detect.brute_force_stream(source(spark, files)), tmp_path)
    want = brute_force.brute_force_windows(read_logs(spark, small), **WHOLE)
    assert rows(got, *columns) == rows(want, *columns) != []


def test_port_scan(spark, small, files, tmp_path):
    columns = ("source_ip", "attempt_count", "unique_ports", "window_start", "window_end")
    got = run(spark, detect.port_scan_stream(source(spark, files)), tmp_path)
    want = port_scan.port_scan_windows(read_logs(spark, small), **WHOLE)
    assert rows(got, *columns) == rows(want, *columns) != []


def test_single_flood(spark, small, files, tmp_path):
    columns = ("source_ip", "request_count", "window_start")
    got = run(spark, detect.single_flood_stream(source(spark, files), single_ip_threshold=8), tmp_path)
    want = floods.single_flood_windows(read_logs(spark, small), 60, 8, **WHOLE)
    assert rows(got, *columns) == rows(want, *columns) != []


def test_distributed_flood(spark, small, files, tmp_path):
    columns = ("target_port", "target_protocol", "request_count", "unique_ip_count", "window_start")
    # The small log has one source only: make it five.
    several = lambda frame: frame.withColumn("source_ip", F.concat(F.lit("10.0.1."), (F.col("log_id") % 5).cast("string")))
    got = run(spark, detect.distributed_flood_stream(
        several(source(spark, files)), distributed_ip_count=2, distributed_request_threshold=3), tmp_path)
    want = floods.distributed_flood_windows(several(read_logs(spark, small)), 60, 2, 3, **WHOLE)
    assert rows(got.where("window_start < '2040-01-01'"), *columns) == rows(want, *columns) != []


def test_sessions(spark, small, files, tmp_path):
    got = run(spark, detect.sessions(source(spark, files), ["source_ip"], 60_000_000, "1 minute"), tmp_path)
    assert got.agg(F.sum("rows")).first()[0] >= 1000


def test_hourly_counts(spark, small, files, tmp_path):
    columns = ("hour", "severity", "event_type", "count")
    got = run(spark, stats.hourly_counts(source(spark, files)), tmp_path)
    want = read_logs(spark, small).groupBy(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:00:00").alias("hour"), "severity", "event_type").agg(
        F.count("*").alias("count"))
    assert rows(got.where("hour < '2040'"), *columns) == rows(want, *columns)


def test_ingest_and_restart(spark, small, tmp_path):
    lines = logs_as_lines(read_logs(spark, small))
    drop, table, failed, state = (str(tmp_path / n) for n in ("drop", "table", "failed", "state"))
    now = ntz(datetime(2024, 6, 1))
    for part in range(3):
        lines.where(F.col("line_id") % 3 == part).select("line").coalesce(1).write.mode("append").text(drop)
        if part == 1:
            spark.createDataFrame([("no address here",)], "value string").coalesce(1).write.mode("append").text(drop)
        # Each start goes on where the one before stopped.
        query = ingest.stream_ingest(ingest.follow(spark, drop, files_per_batch=1), table, failed, state, reference_time=now)
        query.awaitTermination(120)
        assert query.exception() is None
    got = read_table(spark, table)
    want = records(parse_lines(lines.drop("log_source_hint"), datetime(2024, 6, 1)))
    columns = ("timestamp", "source_ip", "destination_port", "event_type", "raw_log")
    assert rows(got, *columns) == rows(want, *columns)
    assert got.select("log_id").distinct().count() == got.count() == 1000
    assert [r.line for r in spark.read.parquet(failed).collect()] == ["no address here"]


def test_a_batch_that_runs_again_changes_nothing(spark, small, tmp_path):
    """As if the stream stopped after the records were written, and before it was noted."""
    lines = logs_as_lines(read_logs(spark, small))
    drop, table, failed, state = (str(tmp_path / n) for n in ("drop", "table", "failed", "state"))

    def run_all():
        query = ingest.stream_ingest(ingest.follow(spark, drop, files_per_batch=1), table, failed, state)
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted((r.log_id, r.raw_log) for r in read_table(spark, table).collect())

    for part in range(2):
        lines.where(F.col("line_id") % 2 == part).select("line").coalesce(1).write.mode("append").text(drop)
    spark.createDataFrame([("no stamp, from 10.9.9.9",)], "value string").coalesce(1).write.mode("append").text(drop)
    first = run_all()
    assert len(first) == 1001 and [i for i, _ in first] == list(range(1001))
    for name in ("1", "2", ".1.crc", ".2.crc"):
        (tmp_path / "state" / "state" / "commits" / name).unlink(missing_ok=True)
    assert run_all() == first


@pytest.mark.parametrize("least", [1, 290])
def test_port_scan_stream_equals_a_plain_loop(spark, tmp_path, least):
    from tests.test_detectors import logs, scan_loop, scan_series

    folder = str(tmp_path / "in")
    series = scan_series(8)
    logs(spark, series).coalesce(1).write.mode("append").parquet(folder)
    for _ in range(2):
        logs(spark, [(10 ** 8, "later", 1, "TCP")]).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    frame = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    # The first file holds all rows, so none is late.
    got = run(spark, detect.port_scan_stream(frame, min_total_attempts=least, period_hours=None), tmp_path).collect()
    zero = datetime(2024, 1, 1)
    second = lambda t: int((t - zero).total_seconds())
    want = scan_loop(series, least_rows=least)
    assert {w[0] for w in want} != {"a", "b", "c"} or least == 1
    base = second(min(r.window_start for r in got)) - min(w[3] for w in want)
    assert sorted((r.source_ip, r.attempt_count, r.unique_ports, second(r.window_start) - base, second(r.window_end) - base) for r in got) == want


def test_enriched_alert_feed(spark, files, tmp_path):
    reputation = spark.createDataFrame([("10.0.0.0", True, "HIGH")], "ip string, detected boolean, threat_level string")
    out = str(tmp_path / "alerts")
    found = detect.enrich_stream(detect.brute_force_stream(source(spark, files)), reputation)
    query = detect.alert_feed(
        found, lambda frame, n: frame.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "state"))
    query.awaitTermination(240)
    assert query.exception() is None
    got = spark.read.parquet(out)
    assert got.count() > 0 and {r[0] for r in got.select("reputation.threat_level").collect()} == {"HIGH"}
