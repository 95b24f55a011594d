"""Size-based retention: when the log is too large, the oldest rows go, in batches.

The cut is found by counting, coarse to fine: bytes per hour over the whole log (from the
rollup that loads leave in a table), per second within one hour, per instant within one
second, and within one instant per range of ids. Each step brings back a single row, and the
cut itself is a literal, so the rewrite prunes folders by it.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.times import ntz
from palisade.operators.filters import in_range
from palisade.session import settle
from palisade.sources import rollup
from palisade.sources.rollup import ROW_OVERHEAD_BYTES, row_bytes  # noqa: F401
from palisade.sources.tables import append_logs, read_logs

BATCH_ROWS = 2000
ID_RANGES = 1024  # that the ids of one instant are cut into at a time; a power of two
# Inside the table's folder; readers pass over names that begin with an underscore.
SWAP = "_swap"


@dataclass(frozen=True)
class Cut:
    """The last row to delete in order of (timestamp, log_id), and what goes with it."""

    timestamp: datetime
    log_id: int
    deleted_rows: int
    bytes_before: int
    bytes_after: int


def find_cut(logs: DataFrame, max_bytes: int, batch_rows: int = BATCH_ROWS, rolled: DataFrame | None = None) -> Cut | None:
    """Where to cut so that at most ``max_bytes`` stay; None when nothing has to go.

    Whole batches are deleted: as few as bring the size down to the limit. With the rollup of
    a table in ``rolled``, only single hours of the log are read; without it, the hours are
    counted from the log first.
    """
    dated = ["log_date"] if "log_date" in logs.columns else []
    sized = logs.where(F.col("timestamp").isNotNull()).select("timestamp", "log_id", row_bytes().alias("bytes"), *dated)
    if rolled is None:
        hours = settle(_per_bucket(sized, "hour"), "hours")
    else:
        hours = rolled.where(F.col("hour").isNotNull()).groupBy(F.col("hour").alias("bucket")).agg(
            F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    total = hours.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).first()
    if not total["rows"] or total["bytes"] <= max_bytes:
        return None
    by_size = _locate(sized, hours, "bytes", total["bytes"] - max_bytes)
    rows = min(-(-by_size["rows_to"] // batch_rows) * batch_rows, total["rows"])
    last = by_size if rows == by_size["rows_to"] else _locate(sized, hours, "rows", rows)
    return Cut(last["timestamp"], last["log_id"], rows, total["bytes"], total["bytes"] - last["bytes_to"])


def _bucket(unit: str) -> Column:
    return F.date_trunc(unit, "timestamp").cast("timestamp_ntz")


def _per_bucket(sized: DataFrame, unit: str) -> DataFrame:
    return sized.groupBy(_bucket(unit).alias("bucket")).agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))


def _locate(sized: DataFrame, hours: DataFrame, measure: str, target: int) -> dict:
    """The first row at which the running total of rows or bytes, oldest first, reaches the target."""
    rows, start = sized, {"rows": 0, "bytes": 0}
    for unit in ("hour", "second", "microsecond"):
        # At most one row per hour of the log, then 3600, then a million: small enough for one window.
        counts = hours if unit == "hour" else _per_bucket(rows, unit)
        hit = _reach(counts, [F.col("bucket")], start, measure, target)
        start = {m: hit[f"{m}_to"] - hit[m] for m in ("rows", "bytes")}
        # The plain range reaches the scan; the bucket makes it exact.
        rows = in_range(rows, hit["bucket"], None).where(_bucket(unit) == ntz(hit["bucket"]))
    return _reach_id(rows, start, measure, target) | {"timestamp": hit["bucket"]}


def _reach_id(rows: DataFrame, start: dict, measure: str, target: int) -> dict:
    """``_reach`` over the ids of one instant, however many rows it has: the range of ids is cut
    into ``ID_RANGES`` parts until a part is one id."""
    ends = rows.agg(F.min("log_id").alias("low"), F.max("log_id").alias("high")).first()
    low = ends["low"] or 0
    shift = ((ends["high"] or 0) - low).bit_length()
    while True:
        shift = max(0, shift - ID_RANGES.bit_length() + 1)
        part = F.shiftright(F.coalesce("log_id", F.lit(low)) - low, shift)
        counts = rows.groupBy(part.alias("bucket")).agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
        hit = _reach(counts, [F.col("bucket")], start, measure, target)
        if not shift:
            return hit | {"log_id": low + hit["bucket"]}
        start = {m: hit[f"{m}_to"] - hit[m] for m in ("rows", "bytes")}
        rows = rows.where(part == hit["bucket"])


def _reach(counts: DataFrame, order: list[Column], start: dict, measure: str, target: int) -> dict:
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = counts.withColumns({f"{m}_to": F.sum(m).over(running) + start[m] for m in ("rows", "bytes")})
    return totals.where(F.col(f"{measure}_to") >= target).orderBy(*order).first().asDict()


def after(cut: Cut) -> Column:
    """The rows that stay."""
    at = F.col("timestamp")
    return (at > ntz(cut.timestamp)) | ((at == ntz(cut.timestamp)) & (F.col("log_id") > cut.log_id))


def retained(logs: DataFrame, max_bytes: int, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """The log after retention. Rows without a time have no age: they stay and do not count."""
    cut = find_cut(logs, max_bytes, batch_rows)
    return logs if cut is None else logs.where(F.col("timestamp").isNull() | after(cut))


def enforce_retention(spark, table: str, max_mb: int, batch_rows: int = BATCH_ROWS) -> Cut | None:
    """Apply retention to a log table: drop whole days, rewrite the day of the cut.

    What stays of that day is written inside the table's folder, where readers do not look, and
    then put in place of the day by a rename. A run that was stopped on the way is finished
    by ``finish_swap``, which the next run calls first; nothing is lost in between. Run it while nothing else writes to the table.
    """
    finish_swap(spark, table)
    cut = find_cut(read_logs(spark, table), max_mb * 1024 * 1024, batch_rows, rollup.read_rollup(spark, table))
    if cut is None:
        return None
    day = cut.timestamp.date()
    boundary = read_logs(spark, table).where(F.col("log_date") == F.lit(day))
    append_logs(boundary.where(after(cut)), f"{table}/{SWAP}/new", "kept")
    path, files = _files(spark, table)
    # Whether anything of the day stays has to be known when it has been moved in, too.
    some = files.exists(path(f"{SWAP}/new/log_date={day.isoformat()}"))
    files.mkdirs(path(f"{SWAP}/{'before' if some else 'through'}={day.isoformat()}"))
    finish_swap(spark, table)
    return cut


def finish_swap(spark, table: str) -> None:
    """Delete the days up to the cut and move in what stays of its day, as far as that is not done.

    The mark is set once what stays is complete. Without it the written rows are of a stopped
    run and go; with it every step can be repeated.
    """
    path, files = _files(spark, table)
    if not files.exists(path(SWAP)):
        return
    marks = [m for m in _names(files, path(SWAP)) if m.startswith(("before=", "through="))]
    if marks:
        kind, _, date = marks[0].partition("=")
        day = f"log_date={date}"
        waiting = files.exists(path(f"{SWAP}/new/{day}"))
        # Once what stays is moved in, the day's folder is no longer an old one.
        gone = lambda name: name < day or name == day and (waiting or kind == "through")
        # The rollup of a day goes and comes with the day, and is moved before it, since the day marks what is done.
        for part in (f"{rollup.FOLDER}/", ""):
            for name in _names(files, path(part)):
                if name.startswith("log_date=") and "__HIVE" not in name and gone(name):
                    files.delete(path(part + name), True)
        if waiting:
            if files.exists(path(f"{SWAP}/new/{rollup.FOLDER}/{day}")):
                files.rename(path(f"{SWAP}/new/{rollup.FOLDER}/{day}"), path(f"{rollup.FOLDER}/{day}"))
            files.rename(path(f"{SWAP}/new/{day}"), path(day))
    files.delete(path(SWAP), True)


def _names(files, folder) -> list[str]:
    return [status.getPath().getName() for status in files.listStatus(folder)]


def _files(spark, table: str):
    place = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{name}" if name else table)
    return place, place("").getFileSystem(spark._jsc.hadoopConfiguration())
