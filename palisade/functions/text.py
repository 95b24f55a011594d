"""Text helpers over columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import fixed


# The characters that count as white space at the ends of a line.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(column: Column | str) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(column, F.lit(WHITE_SPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole_number(column: Column) -> Column:
    return column.try_cast("int")


def has_word(lowered: Column, words: Sequence[str]) -> Column:
    """Whether lower-case text has any of the words in it."""
    found = F.lit(False)
    for word in words:
        found = found | lowered.contains(word)
    return found


def named_port(column: Column, lowered: Column, names) -> Column:
    """The first port in the table that the text gives as number or product name."""
    return F.coalesce(*[
        F.when(column.contains(str(port)) | has_word(lowered, words), port) for port, words in names])


def stamped_time(iso: Column, syslog: Column, reference_time: Column) -> Column:
    """The time of a line from the stamps matched in it.

    An ISO stamp is taken first, then a syslog stamp (in the year of ``reference_time``; an
    unknown month word counts as January). Without a valid one it is ``reference_time``.
    """
    return F.coalesce(iso.try_cast("timestamp_ntz"), _syslog_time(syslog, reference_time), reference_time)


def _syslog_time(stamp: Column, reference_time: Column) -> Column:
    """The time of a matched syslog stamp; null when there is none or it is no valid time."""
    months = F.array(*[F.lit(m) for m in fixed.MONTHS])
    month = F.greatest(F.array_position(months, F.substring(stamp, 1, 3)), F.lit(1))
    day = F.regexp_extract(stamp, r"(?U)\s(\d{1,2})\s", 1)
    clock = lambda n: F.substring(stamp, n, 2).try_cast("int")
    time = F.try_make_timestamp_ntz(
        F.year(reference_time), month.cast("int"), day.try_cast("int"), clock(-8), clock(-5), clock(-2))
    # The constructor would take a 60th second.
    return F.when(clock(-2) < 60, time)


def format_threat_type(column: Column | str) -> Column:
    """A threat type for display."""
    column = F.col(column) if isinstance(column, str) else column
    # Known types and their labels.
    labels = {"BRUTE_FORCE": "Brute Force", "BRUTEFORCE": "Brute Force", "DDOS": "DDoS", "D_DOS": "DDoS",
              "PORT_SCAN": "Port Scan", "PORTSCAN": "Port Scan"}
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    known = F.try_element_at(table, F.upper(F.replace(column, F.lit("-"), F.lit("_"))))
    return F.when(F.coalesce(column, F.lit("")) == "", "Unknown").otherwise(
        F.coalesce(known, F.translate(column, "_-", "  ")))


def format_ip(column: Column | str) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit("Unknown"))
