"""What a load of the log table holds, per hour: kept with the load and replaced with it.

Each load leaves one small file per day below ``_rollup``, which readers of the log pass over.
Questions about the whole table (its size, its hours, its newest row, its largest id) read
these files instead of the log.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.times import hour_text, ntz
from palisade.operators.filters import in_range
from palisade.schema import LOG_TABLE_SCHEMA

FOLDER = "_rollup"
# An estimate of what a record takes besides its text.
ROW_OVERHEAD_BYTES = 200

_KEYS = [T.StructField("log_date", T.DateType()), T.StructField("load", T.StringType())]
SCHEMA = T.StructType([
    T.StructField("hour", T.TimestampNTZType()), T.StructField("rows", T.LongType()), T.StructField("high", T.LongType()),
    T.StructField("bytes", T.LongType()), T.StructField("newest", T.TimestampNTZType()), T.StructField("largest_id", T.LongType()),
    *_KEYS,
])


def row_bytes() -> Column:
    return F.coalesce(F.octet_length("raw_log"), F.lit(0)).cast("bigint") + ROW_OVERHEAD_BYTES


def hours_of(logs: DataFrame, *keys: str) -> DataFrame:
    """Rows, HIGH rows, bytes, newest time and largest id per hour."""
    return logs.groupBy(F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour"), *keys).agg(
        F.count("*").alias("rows"), F.count_if(F.col("severity") == "HIGH").alias("high"), F.sum(row_bytes()).alias("bytes"),
        F.max("timestamp").alias("newest"), F.max("log_id").alias("largest_id"))


def write_rollup(spark: SparkSession, table: str, load: str | None = None) -> None:
    """Roll up one load from what was written of it, or all loads of a table that has no rollup yet."""
    written = spark.read.schema(T.StructType([*LOG_TABLE_SCHEMA.fields, _KEYS[1]])).parquet(table)
    if load is not None:
        written = written.where(F.col("load") == load)
    (hours_of(written, "log_date", "load").select(*SCHEMA.names).hint("rebalance", "log_date", "load")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date", "load")
     .parquet(f"{table}/{FOLDER}"))


def read_rollup(spark: SparkSession, table: str) -> DataFrame:
    """One row per day, load and hour. A table written without a rollup is rolled up first."""
    if not _exists(spark, f"{table}/{FOLDER}"):
        write_rollup(spark, table)
    return spark.read.schema(SCHEMA).parquet(f"{table}/{FOLDER}")


def logs_by_hour(rolled: DataFrame, logs: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """``hour, count`` of a range: whole hours from the rollup, the hours at its two ends from the log."""
    inner = (F.col("hour") >= ntz(start)) & (F.col("hour") + F.expr("INTERVAL 1 HOUR") <= ntz(end))
    whole = rolled.where(inner).groupBy("hour").agg(F.sum("rows").alias("count"))
    first = start.replace(minute=0, second=0, microsecond=0)
    last = end.replace(minute=0, second=0, microsecond=0)
    edge = F.date_trunc("hour", "timestamp").cast("timestamp_ntz")
    # The range of an edge is an hour, so only its day is read.
    ends = [in_range(logs, max(start, h), min(end, h.replace(minute=59, second=59, microsecond=999_999))) for h in sorted({first, last})]
    parts = [e.groupBy(edge.alias("hour")).agg(F.count("*").alias("count")).where(
        ~((F.col("hour") >= ntz(start)) & (F.col("hour") + F.expr("INTERVAL 1 HOUR") <= ntz(end)))) for e in ends]
    made = whole
    for part in parts:
        made = made.union(part)
    return made.select(hour_text("hour").alias("hour"), F.col("count"))


def days(spark: SparkSession, table: str) -> list[date | None]:
    """The days of a table, from the names of its folders; None for rows without a time."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    found = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    names = [n.removeprefix("log_date=") for n in found if n.startswith("log_date=")]
    return [None if "__HIVE" in n else date.fromisoformat(n) for n in names]


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
