"""Sorting, paging and lookups over the log table."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from palisade.functions.times import ntz

SORT_KEYS = ("timestamp", "severity", "source_ip", "event_type")


def sort_key(sort_by: str, direction: str, strict_direction: bool) -> tuple[str, bool]:
    """The sort column, and whether it goes down."""
    if sort_by not in SORT_KEYS:
        return "timestamp", True
    return sort_by, direction.lower() == "desc" and (sort_by == "timestamp" or strict_direction)


def sort_order(sort_by: str = "timestamp", direction: str = "desc", strict_direction: bool = False) -> list[Column]:
    """The sort columns of the browse view.

    Only ``timestamp`` honours the direction; the other keys sort ascending by name unless
    ``strict_direction`` is set, and an unknown key means newest first. Ties go by log_id.
    """
    key, down = sort_key(sort_by, direction, strict_direction)
    # A store of documents puts missing values lowest, as Spark does in both directions.
    return [F.desc(key) if down else F.asc(key), F.asc("log_id")]


RANGE_ROWS = 100_000  # a page is ordered among at most so many rows
ID_RANGES = 1024      # that ids are cut into at a time; a power of two


def page(
    logs: DataFrame,
    number: int = 1,
    size: int = 50,
    sort_by: str = "timestamp",
    direction: str = "desc",
    strict_direction: bool = False,
    days: list[date | None] | None = None,
) -> DataFrame:
    """One page of the (already filtered) log.

    The page is found by counting, coarse to fine, until the range it lies in has at most
    ``RANGE_ROWS`` rows: days, hours, seconds, instants of the time, or beginnings of a name
    of growing length, and ranges of ids where more rows than that agree. Each step brings
    back the buckets the page lies in and reads only those of the step before. Only the rows
    of the last range are ordered.

    With ``days`` (``sources.rollup.days`` of a table with ``log_date``) a page by time counts
    days from the wanted end on, twice as many each time, and reads no day beyond the page.
    """
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    found = narrow(logs, (number - 1) * size, size, *sort_key(sort_by, direction, strict_direction), days)
    if found is None:
        return logs.where(F.lit(False))
    rows, skip, _ = found
    return rows.orderBy(*sort_order(sort_by, direction, strict_direction)).offset(skip).limit(size)


def narrow(
    logs: DataFrame, skip: int, size: int, key: str, down: bool, days: list[date | None] | None = None,
) -> tuple[DataFrame, int, int] | None:
    """The rows of the range that holds the places ``skip`` to ``skip + size``, how many of them to
    skip, and how many they are (beyond ``RANGE_ROWS`` only if more rows agree in key and id). None behind the last row."""
    if days is not None and key == "timestamp":
        found = _of_days(logs, skip, size, down, days)
        if found is None or found[2] <= RANGE_ROWS:
            return found
        logs, skip, _ = found
    dated = "log_date" in logs.columns
    for bucket, part in _time_steps(dated) if key == "timestamp" else _name_steps(key):
        hits = _hits(logs, [bucket], [F.desc("b0") if down else F.asc("b0")], skip, size)
        if not hits:
            return None
        logs, skip = logs.where(part([h["b0"] for h in hits])), skip - hits[0]["skipped"]
        if (rows := sum(h["rows"] for h in hits)) <= RANGE_ROWS:
            return logs, skip, rows
    ends = logs.agg(F.min("log_id").alias("low"), F.max("log_id").alias("high")).first()
    low, shift = ends["low"] or 0, ((ends["high"] or 0) - (ends["low"] or 0)).bit_length()
    while shift and rows > RANGE_ROWS:
        shift = max(0, shift - ID_RANGES.bit_length() + 1)
        ids = F.shiftright(F.col("log_id") - low, shift)
        hits = _hits(logs, [F.col(key), ids], [F.desc("b0") if down else F.asc("b0"), F.asc("b1")], skip, size)
        same = lambda c, v: c.eqNullSafe(_literal(v))
        logs = logs.where(reduce(Column.__or__, [same(F.col(key), h["b0"]) & same(ids, h["b1"]) for h in hits]))
        skip, rows = skip - hits[0]["skipped"], sum(h["rows"] for h in hits)
    return logs, skip, rows


def _literal(value) -> Column:
    return ntz(value) if isinstance(value, datetime) else F.lit(value)


def _hits(rows: DataFrame, buckets: list[Column], order: list[Column], skip: int, size: int) -> list[Row]:
    """The buckets that hold the wanted places, in order: no more than a page has rows."""
    names = [f"b{k}" for k in range(len(buckets))]
    counts = rows.groupBy(*[b.alias(n) for b, n in zip(buckets, names)]).agg(F.count("*").alias("rows"))
    # One row per bucket: a step has thousands of them, not more.
    until = F.sum("rows").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return (counts.withColumn("skipped", until - F.col("rows"))
            .where((F.col("skipped") < skip + size) & (F.col("skipped") + F.col("rows") > skip))
            .orderBy("skipped").collect())


def _of_days(logs: DataFrame, skip: int, size: int, down: bool, days: list[date | None]):
    """``narrow`` to days, counted in growing spans from the wanted end on."""
    ordered = sorted(days, key=lambda d: (d is not None, d or date.min), reverse=down)
    kept, at, width, rows = [], 0, 1, 0
    while at < len(ordered) and rows < skip + size:
        span = ordered[at:at + width]
        counts = {r["log_date"]: r["count"] for r in logs.where(_on_days(span)).groupBy("log_date").count().collect()}
        for day in span:
            if rows < skip + size:
                count = counts.get(day, 0)
                if rows + count <= skip:
                    skip -= count
                elif count:
                    kept.append(day)
                    rows += count
        at, width = at + width, 2 * width
    return (logs.where(_on_days(kept)), skip, rows) if kept else None


def _on_days(days: list[date | None]) -> Column:
    named = [d for d in days if d is not None]
    found = F.col("log_date").between(min(named), max(named)) if named else F.lit(False)
    return found | F.col("log_date").isNull() if None in days else found


def _time_steps(dated: bool):
    """Buckets of the time, and the range of times that some neighbouring buckets make."""
    def part(unit: str):
        def of(hits: list[datetime | None]) -> Column:
            known = [h for h in hits if h is not None]
            if not known:
                return F.col("timestamp").isNull()
            until = max(known) + timedelta(**{f"{unit}s": 1})
            found = (F.col("timestamp") >= ntz(min(known))) & (F.col("timestamp") < ntz(until))
            if dated:
                found &= F.col("log_date").between(min(known).date(), max(known).date())
            return found | F.col("timestamp").isNull() if None in hits else found
        return of

    for unit in ("day", "hour", "second", "microsecond"):
        yield F.date_trunc(unit, "timestamp").cast("timestamp_ntz"), part(unit)


def _name_steps(key: str):
    """Beginnings of a name: names in order have their beginnings in order."""
    def of(bucket: Column):
        def part(hits: list[str | None]) -> Column:
            known = [h for h in hits if h is not None]
            found = bucket.isin(known) & (F.col(key) >= min(known)) if known else F.lit(False)
            return found | F.col(key).isNull() if None in hits else found
        return part

    for length in (3, 6, 9, 12):
        yield (bucket := F.substring(key, 1, length)), of(bucket)
    yield F.col(key), of(F.col(key))


def page_info(logs: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """Total rows and pages of the (already filtered) log."""
    return logs.agg(F.count("*").alias("total")).select(
        "total", F.lit(number).alias("page"), F.lit(size).alias("page_size"),
        F.ceil(F.col("total") / size).alias("total_pages"))


def lookup(logs: DataFrame, log_id: int | str) -> DataFrame:
    """One record by id; none when there is no such record or the id is not one."""
    return logs.where(F.col("log_id") == F.lit(str(log_id)).try_cast("bigint")).limit(1)


def recent(logs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest records: a top-k, which holds ``limit`` rows per task."""
    return logs.orderBy(*sort_order()).limit(limit)


def latest(logs: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """The newest timestamp overall."""
    rows = logs if as_of is None else logs.where(F.col("timestamp") <= ntz(as_of))
    return rows.agg(F.max("timestamp").alias("last_log_timestamp"))
