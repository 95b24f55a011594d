"""Reading lines, and reading and writing the log table and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.schema import LOG_SCHEMA, LOG_TABLE_SCHEMA
from palisade.session import settle
from palisade.sources.rollup import read_rollup, write_rollup

PARTS_BLOCK = 1024  # partitions whose counts are added up together; a power of two
_PART, _PLACE, _START = "_part", "_place", "_start"


def read_lines(spark: SparkSession, path: str, log_source_hint: str | None = None, first_id: int = 0) -> DataFrame:
    """Text files as raw lines with consecutive ids from ``first_id``."""
    return numbered(raw_lines(spark, path, log_source_hint), first_id).select("line_id", "line", "log_source_hint")


def raw_lines(spark: SparkSession, path: str, log_source_hint: str | None = None) -> DataFrame:
    """Text files as raw lines that have no ids yet."""
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.lit(log_source_hint).cast("string").alias("log_source_hint"))


def placed(rows: DataFrame) -> DataFrame:
    """``rows``, written once, with the partition they came from and their place in it."""
    # The lower 33 bits of Spark's id are the place in the partition.
    return settle(rows.withColumns({
        _PART: F.spark_partition_id(), _PLACE: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "placed-rows")


def with_ids(held: DataFrame, first: int, column: str = "line_id") -> DataFrame:
    """Rows from ``placed`` with consecutive ids from ``first``, in the order of their partitions.

    The rows of each partition are counted, and the counts added up as a table: first over
    blocks of partitions, then inside each block, so no task sees all partitions. The
    starts are joined with the rows.
    """
    counts = held.groupBy(_PART).agg(F.count("*").alias("rows")).withColumn("block", F.col(_PART).bitwiseAND(-PARTS_BLOCK))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda window: F.coalesce(F.sum("rows").over(window), F.lit(0))
    # One row per block of partitions.
    blocks = counts.groupBy("block").agg(F.sum("rows").alias("rows")).select(
        "block", so_far(earlier().orderBy("block")).alias("before"))
    starts = counts.join(blocks, "block").select(
        _PART, (F.lit(first) + F.col("before") + so_far(earlier("block").orderBy(_PART))).alias(_START))
    return held.join(starts, _PART).withColumn(column, F.col(_START) + F.col(_PLACE)).drop(_PART, _PLACE, _START)


def numbered(rows: DataFrame, first: int, column: str = "line_id") -> DataFrame:
    """``rows``, read once and written, with consecutive ids from ``first``."""
    return with_ids(placed(rows), first, column)


def next_id(spark: SparkSession, path: str) -> int:
    """The id after the largest in the log table, from its rollup."""
    if not exists(spark, path):
        return 0
    largest = read_rollup(spark, path).agg(F.max("largest_id").alias("m")).first()["m"]
    return 0 if largest is None else largest + 1


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def append_logs(logs: DataFrame, path: str, load: str | None = None) -> None:
    """Add records to the log table, below their day, in a folder named by ``load``.

    Writing the same load again replaces what it wrote before; without a name it is a new
    one. Rows are brought together by day, and days are cut by their size at run time. Files
    are sorted by source and time: their min/max statistics then let a scan skip most of them.
    What the load holds per hour is then rolled up from what was written; writing the load
    again also replaces that, so a stopped load is mended by the same call.
    """
    load = load or uuid.uuid4().hex
    dated = logs.select(*LOG_SCHEMA.names, F.col("timestamp").cast("date").alias("log_date"), F.lit(load).alias("load"))
    (dated.hint("rebalance", "log_date", "load").sortWithinPartitions("log_date", "source_ip", "timestamp")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date", "load").parquet(path))
    write_rollup(logs.sparkSession, path, load)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The log table. Filters on ``log_date`` prune folders; others reach the files."""
    return spark.read.schema(LOG_TABLE_SCHEMA).parquet(path).select(*LOG_TABLE_SCHEMA.names)


def export_rows(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Filtered logs or detections as CSV (with header) or JSON files.

    CSV has no nested values: lists and maps are written as JSON text. Times keep their
    microseconds, which Spark's own format cuts off.
    """
    stamps = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    if kind == "json":
        rows.write.mode("errorifexists").options(**stamps).json(path)
        return
    if kind != "csv":
        raise ValueError(f"cannot export as {kind!r}")
    nested = ("array", "map", "struct")
    flat = rows.select(*[
        F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in rows.dtypes])
    flat.write.mode("errorifexists").option("header", True).options(**stamps).csv(path)
