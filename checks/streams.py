"""Streams over the log. It arrives in two halves and a closing row, and each is a run of its
own, so every query also stops and goes on from its checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade.functions.times import from_micros, micros, ntz
from palisade.schema import LOG_SCHEMA
from palisade.session import shared_folder
from palisade.sources.tables import read_logs as read_table
from palisade.streaming import detect, ingest, stats

# The closing rows lie behind everything, so that the watermark passes all windows. The first moves
# it, and the run of the second works with it.
CLOSING = (datetime(2150, 1, 1), datetime(2150, 1, 2))

Start = Callable[[DataFrame, str, str], StreamingQuery]


def _folder(logs: DataFrame) -> str:
    return f"{shared_folder(logs.sparkSession)}/palisade/stream-{uuid.uuid4().hex}"


def _halves(logs: DataFrame) -> list[DataFrame]:
    """The log before and after the middle of its period."""
    ends = logs.agg(F.min(micros("timestamp")).alias("low"), F.max(micros("timestamp")).alias("high"))
    middle = ends.select(from_micros(F.floor((F.col("low") + F.col("high")) / 2)).alias("t")).first()["t"]
    early = F.col("timestamp") <= ntz(middle)
    return [logs.where(early), logs.where(~early)]


def _closing(logs: DataFrame, moment: datetime) -> DataFrame:
    row = {f.name: F.lit(None).cast(f.dataType) for f in LOG_SCHEMA}
    # It passes the filters of all detectors and is too little for any window.
    row |= {"timestamp": ntz(moment), "source_ip": F.lit("closing"), "destination_port": F.lit(1),
            "event_type": F.lit("SSH_FAILED_LOGIN")}
    return logs.sparkSession.range(1).select(*[c.alias(n) for n, c in row.items()])


def _finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def to_files(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def to_batches(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The alert feed, published to a folder per batch, so a batch that comes again replaces itself."""
    publish = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    return detect.alert_feed(rows, publish, checkpoint)


def streamed(logs: DataFrame, operator: Callable[[DataFrame], DataFrame], start: Start = to_files) -> DataFrame:
    """All that ``operator`` gives over the stream of the log."""
    spark, root = logs.sparkSession, _folder(logs)
    for part in (*_halves(logs), *(_closing(logs, t) for t in CLOSING)):
        part.write.mode("append").parquet(f"{root}/in")
        made = operator(spark.readStream.schema(LOG_SCHEMA).parquet(f"{root}/in"))
        _finish(start(made, f"{root}/out", f"{root}/state"))
    return spark.read.schema(made.schema).parquet(f"{root}/out").select(*made.columns)


def hourly(logs: DataFrame) -> DataFrame:
    return streamed(logs, stats.hourly_counts).where(F.col("hour") < CLOSING[0].isoformat())


def brute_force(logs: DataFrame) -> DataFrame:
    return streamed(logs, detect.brute_force_stream)


def port_scan(logs: DataFrame) -> DataFrame:
    return streamed(logs, detect.port_scan_stream)


def port_scan_total(logs: DataFrame) -> DataFrame:
    """Only the windows of sources with enough rows in all."""
    return streamed(logs, lambda s: detect.port_scan_stream(s, min_total_attempts=907, period_hours=None))


def distributed_flood(logs: DataFrame) -> DataFrame:
    return streamed(logs, lambda s: detect.distributed_flood_stream(s, 60, 3, 20))


def alerts(logs: DataFrame) -> DataFrame:
    """Flood windows of single sources, as the alert feed publishes them."""
    return streamed(logs, lambda s: detect.single_flood_stream(s, 60, 8), to_batches)


def enriched(logs: DataFrame, known: DataFrame) -> DataFrame:
    columns = ("log_id", "source_ip", "severity", "reputation.threat_level", "reputation.reputation_score")
    return streamed(logs, lambda s: detect.enrich_stream(s.where("source_ip <> 'closing'"), known).select(*columns))


def ingested(logs: DataFrame, reference_time: datetime) -> DataFrame:
    """The log table after its lines, as text files, came in as a stream. Ids are those of the stream."""
    spark, root = logs.sparkSession, _folder(logs)
    for half in _halves(logs):
        half.select("raw_log").write.mode("append").text(f"{root}/in")
        _finish(ingest.stream_ingest(
            ingest.follow(spark, f"{root}/in"), f"{root}/table", f"{root}/failed", f"{root}/state",
            reference_time=ntz(reference_time)))
    return read_table(spark, f"{root}/table").select(*[c for c in LOG_SCHEMA.names if c != "log_id"])
