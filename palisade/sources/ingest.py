"""Lines in, records and counts out."""

from __future__ import annotations

from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from palisade.session import drop_settled
from palisade.sources.parsers import parse_lines, records
from palisade.sources.tables import append_logs, next_id, placed, with_ids


def ingest_summary(parsed: DataFrame) -> DataFrame:
    """Received, ingested and failed lines as one row, with a message."""
    return _told(parsed.agg(
        F.count("*").alias("total_received"),
        F.count("parsed").alias("ingested_count"),
    ))


def _told(counts: DataFrame) -> DataFrame:
    counts = counts.withColumn("failed_count", F.col("total_received") - F.col("ingested_count"))
    # The texts of the message.
    some = F.format_string("Successfully ingested %d log(s). %d failed to parse.", "ingested_count", "failed_count")
    return counts.select(
        (F.col("ingested_count") > 0).alias("success"), "ingested_count", "failed_count", "total_received",
        F.when(F.col("ingested_count") > 0, some)
        .otherwise("No logs could be parsed from the provided lines").alias("message"),
    )


def ingest(
    lines: DataFrame,
    table: str,
    reference_time: datetime,
    router: str = "reference",
    load: str | None = None,
) -> DataFrame:
    """Parse lines and add them to the log table; returns the counts.

    Lines are parsed once: what is written is counted on the way. Ids come with the lines
    (``read_lines(..., first_id=next_id(spark, table))`` continues those of the table).
    """
    seen = Observation("ingest")
    counts = F.count("*").alias("total_received"), F.count("parsed").alias("ingested_count")
    parsed = parse_lines(lines, reference_time, router=router).observe(seen, *counts)
    append_logs(records(parsed), table, load)
    try:
        found = seen.get["total_received"], seen.get["ingested_count"]
    except Py4JJavaError:
        # Where no line could be parsed the write is planned away, and its counts with it.
        found = lines.count(), 0
    return _told(lines.sparkSession.createDataFrame([found], "total_received long, ingested_count long"))


def ingest_lines(
    lines: DataFrame,
    table: str,
    reference_time: datetime,
    router: str = "reference",
    load: str | None = None,
) -> DataFrame:
    """``ingest`` for lines without ids: they continue those of the table.

    The lines are read and parsed once. What comes out is written with its place, counted
    there, and gets its ids on the way into the table. Writers that run at once must use
    ``ingest`` with ranges of their own.
    """
    spark = lines.sparkSession
    held = placed(parse_lines(lines, reference_time, router=router))
    append_logs(records(with_ids(held, next_id(spark, table))), table, load)
    found = held.agg(F.count("*"), F.count("parsed")).first()
    drop_settled(spark, held)
    return _told(spark.createDataFrame([tuple(found)], "total_received long, ingested_count long"))
