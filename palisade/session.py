"""Session settings, and the one helper that writes intermediate results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Applied by configure(); all of them are runtime-settable.
RUNTIME_CONF = {
    # Timestamps are naive UTC; conversions to microseconds rely on this.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Applied when a session is built; they cannot be changed later.
BUILD_CONF = {
    # Looking up the Python call site of every column expression costs more time on the
    # driver than planning does.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


_settled: list[str] = []


def build_session(master: str | None = None, app: str = "palisade", **conf: str) -> SparkSession:
    """A session with the settings the operators expect.

    ``master`` is left to spark-submit when not given. Extra settings use
    underscores for dots: ``spark_sql_shuffle_partitions="8"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in {**RUNTIME_CONF, **BUILD_CONF}.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Put the required runtime settings on an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediates: ``spark.checkpoint.dir``, which the cluster names.

    Where that is unset, a folder of the warehouse, if executors reach it too: a warehouse on
    the driver's disk will do only when Spark runs on that machine alone.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    on_disk = warehouse.startswith(("file:", "/"))
    if on_disk and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError(f"executors may not reach {warehouse}: set spark.checkpoint.dir to a folder that all of them share")
    return f"{warehouse}/intermediate"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For results that several branches of one job use: they are computed once, and losing
    executors afterwards costs nothing.
    """
    path = f"{shared_folder(df.sparkSession)}/palisade/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _settled.append(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._settled_at = path
    return made


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_settled(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete frames that ``settle`` returned, when nothing that is still to run reads them."""
    for frame in frames:
        if frame._settled_at in _settled:
            _settled.remove(frame._settled_at)
        _delete(spark, frame._settled_at)


def forget_settled(spark: SparkSession, since: int = 0) -> None:
    """Delete what this process settled. Call it when no frame built on it is needed."""
    while len(_settled) > since:
        _delete(spark, _settled.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was settled inside: make a report and export it in here."""
    since = len(_settled)
    try:
        yield
    finally:
        forget_settled(spark, since)


def together(*jobs: Callable[[], DataFrame]) -> list[DataFrame]:
    """Run independent pieces that start Spark jobs at the same time, in order of result.

    A single piece seldom fills a cluster through all its stages; several fill the gaps.
    """
    # A thread started by another call of this function has no active session of its own.
    session = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    inherit = inheritable_thread_target(session)
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inherit(job)) for job in jobs]]
