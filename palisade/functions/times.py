"""Time helpers. Log time is naive UTC (TIMESTAMP_NTZ); arithmetic is in whole microseconds."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(column: Column | str) -> Column:
    """TIMESTAMP_NTZ to microseconds since the epoch."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def from_micros(column: Column | str) -> Column:
    """Microseconds since the epoch to TIMESTAMP_NTZ."""
    return F.timestamp_micros(column).cast("timestamp_ntz")


def ntz(value: datetime | None) -> Column:
    """A TIMESTAMP_NTZ literal; it folds to a constant, so comparisons reach the scan."""
    if value is None:
        return F.lit(None).cast("timestamp_ntz")
    return F.lit(naive_utc(value).isoformat(sep=" ")).cast("timestamp_ntz")


def naive_utc(value: datetime) -> datetime:
    """Drop an offset after moving to UTC; a naive value is UTC already."""
    if value.tzinfo is None:
        return value
    return value.astimezone(timezone.utc).replace(tzinfo=None)


def iso(column: Column | str) -> Column:
    """ISO text of a timestamp; the fraction appears only when it is not zero."""
    column = F.col(column) if isinstance(column, str) else column
    whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(column, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def hour_text(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:00:00")


def day_text(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'00:00:00")


def lookback(
    start: datetime | None,
    end: datetime | None,
    as_of: datetime | None,
    hours: int,
) -> tuple[datetime, datetime]:
    """Fill a missing range: ``end`` from ``as_of``, ``start`` so many hours before."""
    if end is None:
        if as_of is None:
            raise ValueError("give end or as_of: an open range needs a point in time")
        end = as_of
    return start if start is not None else end - timedelta(hours=hours), end


def midnight(value: datetime) -> datetime:
    return value.replace(hour=0, minute=0, second=0, microsecond=0)


def day_bounds(day: datetime) -> tuple[datetime, datetime]:
    """From ``day`` to the last microsecond of the 24 hours after it."""
    return day, day + timedelta(days=1) - timedelta(microseconds=1)


def week_bounds(start: datetime | None, as_of: datetime) -> tuple[datetime, datetime]:
    """From the midnight of ``start`` (seven days back by default) to ``as_of``."""
    return midnight(start if start is not None else as_of - timedelta(days=7)), as_of


def parse_range(start: str, end: str, end_of_day: bool = False) -> tuple[datetime, datetime]:
    """Range arguments as text: ISO (``Z`` allowed) or ``YYYY-MM-DD``.

    A bare end date means its midnight; ``end_of_day`` moves it to 23:59:59.
    """
    def parse(name: str, text: str) -> datetime:
        try:
            return naive_utc(datetime.fromisoformat(text.replace("Z", "+00:00")))
        except ValueError:
            raise ValueError(f"{name}: use YYYY-MM-DD or ISO format, not {text!r}") from None

    low, high = parse("start", start), parse("end", end)
    if end_of_day and len(end.strip()) == 10:
        high = high.replace(hour=23, minute=59, second=59)
    if low >= high:
        raise ValueError("start must be before end")
    return low, high
