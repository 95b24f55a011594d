"""The log table: ids, loads, pages of any depth."""

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palisade.operators import browse
from palisade.operators.browse import page
from palisade.plans import dashboard
from palisade.sources.event_view import logs_as_lines, read_logs
from palisade.sources import rollup
from palisade.sources.ingest import ingest, ingest_lines
from palisade.sources.tables import append_logs, next_id, numbered, read_lines, read_logs as read_table


def test_ids_are_consecutive_over_partitions(spark):
    rows = spark.range(1000).repartition(7).where("id % 3 = 0")
    got = sorted(r.line_id for r in numbered(rows, 50).collect())
    assert got == list(range(50, 50 + rows.count()))
    assert numbered(rows.where("false"), 5).count() == 0


def test_ingest_goes_on_with_the_ids_of_the_table(spark, small, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "logs")
    logs_as_lines(read_logs(spark, small)).select("line").union(
        spark.createDataFrame([("",), ("no address",)], "line string")).repartition(3).write.text(folder)
    for k in range(2):
        told = ingest(read_lines(spark, folder, first_id=next_id(spark, table)), table, datetime(2024, 6, 1)).first()
        assert (told.ingested_count, told.failed_count, told.total_received) == (1000, 2, 1002)
    logs = read_table(spark, table)
    assert logs.count() == logs.select("log_id").distinct().count() == 2000


def test_the_same_load_replaces_itself(spark, small, tmp_path):
    table, logs = str(tmp_path / "logs"), read_logs(spark, small)
    append_logs(logs, table, "one")
    append_logs(logs.limit(10), table)
    append_logs(logs, table, "one")
    assert read_table(spark, table).count() == 1010


@pytest.mark.parametrize("sort_by,direction,strict", [
    ("timestamp", "desc", False), ("timestamp", "asc", False), ("severity", "asc", False), ("source_ip", "desc", True),
    ("event_type", "desc", False), ("nothing", "asc", False)])
def test_pages_of_any_depth(spark, medium, sort_by, direction, strict):
    logs = read_logs(spark, medium).withColumn("timestamp", F.when(F.col("log_id") % 50 != 0, F.date_trunc("day", "timestamp").cast("timestamp_ntz")))
    key = sort_by if sort_by != "nothing" else "timestamp"
    down = (direction == "desc" and (key == "timestamp" or strict)) if sort_by != "nothing" else True
    rows = sorted(((r[0], r[1]) for r in logs.select(key, "log_id").collect()), key=lambda r: r[1])
    rows.sort(key=lambda r: (r[0] is not None, r[0]) if r[0] is not None else (False,), reverse=down)
    for number in (1, 97, 250, 400):
        got = [r.log_id for r in page(logs, number, 40, sort_by, direction, strict).collect()]
        assert got == [r[1] for r in rows[(number - 1) * 40:number * 40]]


def test_the_range_of_a_page_is_bounded(spark, small, monkeypatch):
    """Also where one instant and one name have far more rows than the bound."""
    monkeypatch.setattr(browse, "RANGE_ROWS", 20)
    monkeypatch.setattr(browse, "ID_RANGES", 4)
    logs = read_logs(spark, small).select(
        "log_id", F.lit(datetime(2024, 1, 1)).alias("timestamp"), F.lit("HIGH").alias("severity"), "source_ip")
    ids = sorted(r[0] for r in logs.select("log_id").collect())
    for key, down in (("timestamp", True), ("severity", False)):
        rows, skip, count = browse.narrow(logs, 500, 10, key, down)
        assert count <= 20 + 10 and rows.count() == count
        assert [r.log_id for r in page(logs, 51, 10, key).collect()] == ids[500:510]
    assert page(logs, 101, 10).count() == 0


def days_of(table):
    return sorted(p for p in Path(table).iterdir() if p.name.startswith("log_date="))


def spoil(folders):
    """Files that fail when they are read."""
    for folder in folders:
        for file in folder.rglob("*.parquet"):
            file.write_bytes(b"not a parquet file")
            crc = file.with_name(f".{file.name}.crc")
            if crc.exists():
                crc.unlink()


def test_new_pages_and_the_newest_time_read_the_newest_day_alone(spark, small, tmp_path):
    table = str(tmp_path / "logs")
    logs = read_logs(spark, small)
    append_logs(logs, table)
    newest = logs.orderBy(F.desc("timestamp"), "log_id").limit(20).collect()
    health = dashboard.health(read_table(spark, table), datetime(2030, 1, 1)).first()
    spoil(days_of(table)[:-1])
    shown = page(read_table(spark, table), 1, 10, days=rollup.days(spark, table))
    assert [r.log_id for r in shown.collect()] == [r.log_id for r in newest[:10]]
    assert [r.log_id for r in page(read_table(spark, table), 2, 10, days=rollup.days(spark, table)).collect()] == [
        r.log_id for r in newest[10:]]
    plan = dashboard.health(read_table(spark, table), datetime(2030, 1, 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date#" in plan and "Subquery" in plan
    assert health.last_log_timestamp == newest[0].timestamp


def test_top_sources_read_the_last_week_alone_when_it_has_rows(spark, small, tmp_path):
    table, as_of = str(tmp_path / "logs"), datetime(2024, 1, 30, 0, 2)
    logs = read_logs(spark, small)
    append_logs(logs.withColumn("timestamp", F.when(F.col("log_id") % 9 != 0, F.col("timestamp"))), table)
    want = dashboard.top_ips(read_table(spark, table).drop("log_date"), as_of).collect()
    ever = dashboard.top_ips(read_table(spark, table).drop("log_date"), datetime(2030, 1, 1)).collect()
    assert dashboard.top_ips(read_table(spark, table), datetime(2030, 1, 1)).collect() == ever
    assert sum(r.total_logs for r in ever) > sum(r.total_logs for r in want)
    spoil(p for p in days_of(table) if p.name < "log_date=2024-01-23" or "HIVE" in p.name)
    assert dashboard.top_ips(read_table(spark, table), as_of).collect() == want


def test_lines_without_ids_are_read_once(spark, small, tmp_path):
    table = str(tmp_path / "logs")
    lines = read_logs(spark, small).select(F.col("raw_log").alias("line")).union(
        spark.createDataFrame([("",), ("no address",)], "line string")).repartition(5)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    for k in range(2):
        told = ingest_lines(lines.mapInArrow(count, "line string"), table, datetime(2024, 6, 1)).first()
        assert (told.ingested_count, told.failed_count, told.total_received) == (1000, 2, 1002)
        assert seen.value == 1002 * (k + 1)
    logs = read_table(spark, table)
    assert logs.select("log_id").distinct().count() == logs.count() == 2000 and logs.agg(F.max("log_id")).first()[0] <= 2003


def test_ids_of_many_partitions_are_a_joined_table(spark):
    rows = spark.range(0, 6000, 1, 3000)
    made = numbered(rows, 7)
    assert sorted((r.id, r.line_id) for r in made.collect()) == [(k, k + 7) for k in range(6000)]
    assert len(made._jdf.queryExecution().optimizedPlan().toString()) < 5000


def test_the_rollup_follows_its_loads(spark, small, tmp_path):
    table, logs = str(tmp_path / "logs"), read_logs(spark, small)
    for load, rows in (("a", logs), ("b", logs.limit(100)), ("a", logs.where("severity = 'HIGH'"))):
        append_logs(rows, table, load)
    want = rollup.hours_of(read_table(spark, table)).orderBy("hour").collect()
    summed = rollup.read_rollup(spark, table).groupBy("hour").agg(
        *[F.sum(c).alias(c) for c in ("rows", "high", "bytes")], *[F.max(c).alias(c) for c in ("newest", "largest_id")])
    assert summed.orderBy("hour").collect() == want
    start, end = datetime(2024, 1, 3, 0, 1, 7), datetime(2024, 1, 20, 0, 0)
    got = rollup.logs_by_hour(rollup.read_rollup(spark, table), read_table(spark, table), start, end)
    from palisade.operators.stats import logs_by_hour
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, logs_by_hour(read_table(spark, table), start, end).collect()))
