from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palisade.plans import retention
from palisade.plans.retention import ROW_OVERHEAD_BYTES, enforce_retention, find_cut, retained
from palisade.sources import rollup
from palisade.sources.event_view import read_logs
from palisade.sources.tables import append_logs, read_logs as read_table


def batches(rows, limit, batch):
    """The definition: drop the oldest batch while the rest is too large."""
    rows = sorted(rows)
    size = sum(r[2] for r in rows)
    while size > limit and rows:
        size -= sum(r[2] for r in rows[:batch])
        rows = rows[batch:]
    return {r[1] for r in rows}


@pytest.mark.parametrize("share,batch", [(0.5, 70), (0.31, 1), (0.999, 2000), (0.9, 33), (1.0, 10), (0.0, 400)])
def test_same_rows_as_batchwise_deletion(spark, small, share, batch):
    logs = read_logs(spark, small)
    rows = [(r.timestamp, r.log_id, len(r.raw_log.encode()) + ROW_OVERHEAD_BYTES)
            for r in logs.select("timestamp", "log_id", "raw_log").collect()]
    limit = int(sum(r[2] for r in rows) * share)
    kept = {r.log_id for r in retained(logs, limit, batch).select("log_id").collect()}
    assert kept == batches(rows, limit, batch)


def test_table_is_cut(spark, small, tmp_path):
    table = str(tmp_path / "logs")
    # Text long enough for whole megabytes.
    logs = read_logs(spark, small).withColumn("raw_log", F.repeat("raw_log", 40))
    append_logs(logs, table)
    before = find_cut(read_table(spark, table), 2 * 1024 * 1024, 100)
    cut = enforce_retention(spark, table, 2, 100)
    assert cut == before and cut.deleted_rows % 100 == 0
    left = read_table(spark, table)
    assert left.count() == 1000 - cut.deleted_rows
    assert left.agg(F.min("timestamp")).first()[0] >= cut.timestamp
    assert enforce_retention(spark, table, 2, 100) is None
    assert find_cut(left.where(F.col("timestamp") > F.lit(datetime(2050, 1, 1))), 0) is None


@pytest.mark.parametrize("stopped", ["before the mark", "after the mark", "after deleting", "after the move"])
def test_a_stopped_run_loses_nothing(spark, small, tmp_path, monkeypatch, stopped):
    table, aside = str(tmp_path / "logs"), str(tmp_path / "aside")
    logs = read_logs(spark, small).withColumn("raw_log", F.repeat("raw_log", 40))
    for path in (table, aside):
        append_logs(logs, path)
    enforce_retention(spark, aside, 2, 100)
    want = {r.log_id for r in read_table(spark, aside).collect()}
    finish = retention.finish_swap
    with monkeypatch.context() as patch:
        patch.setattr(retention, "finish_swap", lambda *a: None)
        cut = enforce_retention(spark, table, 2, 100)
    path, files = retention._files(spark, table)
    day = cut.timestamp.date().isoformat()
    if stopped == "before the mark":
        files.delete(path(f"_swap/before={day}"), True)
        assert read_table(spark, table).count() == 1000
        assert enforce_retention(spark, table, 2, 100) == cut
    else:
        if stopped != "after the mark":
            for name in retention._names(files, path("")):
                if name.startswith("log_date=") and name <= f"log_date={day}":
                    files.delete(path(name), True)
        if stopped == "after the move":
            files.rename(path(f"_swap/new/log_date={day}"), path(f"log_date={day}"))
        assert enforce_retention(spark, table, 2, 100) is None
    assert {r.log_id for r in read_table(spark, table).collect()} == want
    finish(spark, table)
    assert {r.log_id for r in read_table(spark, table).collect()} == want


def test_rows_without_a_time_stay(spark, small):
    logs = read_logs(spark, small).withColumn("timestamp", F.when(F.col("log_id") % 10 != 0, F.col("timestamp")))
    size = logs.where("timestamp is not null").agg(F.sum(retention.row_bytes())).first()[0]
    cut = find_cut(logs, size // 3, 70)
    kept = retained(logs, size // 3, 70)
    assert kept.where("timestamp is null").count() == 100
    assert kept.count() == 1000 - cut.deleted_rows


def test_one_instant_is_cut_by_ranges_of_ids(spark):
    rows = 2_000_000
    logs = spark.range(rows).select(
        (F.col("id") * 3 + 5).alias("log_id"), F.lit(datetime(2024, 1, 1)).alias("timestamp"), F.lit("x" * 10).alias("raw_log"))
    cut = find_cut(logs, (rows - 1_234_567) * (ROW_OVERHEAD_BYTES + 10), 1)
    assert (cut.deleted_rows, cut.log_id) == (1_234_567, 3 * 1_234_566 + 5)


def test_the_rollup_gives_the_same_cut_and_follows_it(spark, small, tmp_path):
    table = str(tmp_path / "logs")
    append_logs(read_logs(spark, small).withColumn("raw_log", F.repeat("raw_log", 40)), table)
    rolled = lambda: rollup.read_rollup(spark, table)
    for batch in (1, 100):
        assert find_cut(read_table(spark, table), 2 << 20, batch, rolled()) == find_cut(read_table(spark, table), 2 << 20, batch)
    hours = rolled().select("hour").distinct().count()
    enforce_retention(spark, table, 2, 100)
    want = rollup.hours_of(read_table(spark, table)).select("hour", "rows", "bytes").orderBy("hour").collect()
    got = rolled().groupBy("hour").agg(
        F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).orderBy("hour").collect()
    assert got == want and len(got) < hours
