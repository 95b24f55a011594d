"""Streaming ingestion: new lines are parsed as they arrive and appended to the log table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade.session import drop_settled
from palisade.sources.parsers import failures, parse_lines, records
from palisade.sources.tables import append_logs, placed, with_ids


def follow(spark: SparkSession, folder: str, log_source_hint: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Lines of the files that appear in a folder (rotated logs). Lines get their id on write."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
        .select(F.col("value").alias("line"), F.lit(log_source_hint).cast("string").alias("log_source_hint"))
    )


def parse_stream(lines: DataFrame, router: str = "reference", reference_time: Column | None = None) -> DataFrame:
    """Lines with their record in ``parsed``; a line without a stamp gets the batch's time."""
    now = F.current_timestamp().cast("timestamp_ntz") if reference_time is None else reference_time
    return parse_lines(lines, now, router=router)


def stream_ingest(
    lines: DataFrame,
    table: str,
    failed: str,
    checkpoint: str,
    router: str = "reference",
    reference_time: Column | None = None,
    trigger: dict | None = None,
    first_id: int = 0,
) -> StreamingQuery:
    """Add parsed records to the log table and other lines to a folder of failures.

    A batch may run again after a failure: both its records and its failures go to folders
    of the batch, which are replaced. Ids are consecutive over the stream; a batch leaves a mark
    with the id after its last, and a batch that runs again starts at the same id. Lines
    without a stamp take the time of their batch, which the stream keeps, so they
    return to the same day.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/{name}")
        files = path("").getFileSystem(spark._jsc.hadoopConfiguration())
        first = first_id
        if number:
            marks = files.listStatus(path(f"ids/{number - 1}"))
            first = int(marks[0].getPath().getName())
        # The batch is read and parsed once; what follows reads what was written of it.
        held = placed(parse_stream(batch, router, F.col("batch_time") if reference_time is None else reference_time))
        parsed = with_ids(held, first)
        failures(parsed).write.mode("overwrite").parquet(f"{failed}/batch={number}")
        append_logs(records(parsed), table, f"{name}-{number}")
        files.mkdirs(path(f"ids/{number}/{first + held.count()}"))
        drop_settled(spark, held)
        # Only the last batch can run again, and it starts from the mark before it.
        if number > 1:
            files.delete(path(f"ids/{number - 2}"), True)

    # Every stream names its loads after its checkpoint.
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    lines = lines.withColumn("batch_time", F.current_timestamp().cast("timestamp_ntz"))
    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/state")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
