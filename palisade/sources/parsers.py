"""Raw log lines to records, as built-in column expressions.

Each parser is a struct column that is null for lines it does not understand. What several
parsers look for is extracted once per line beforehand, and only from lines that can have
it, so a line is searched as rarely as possible and no Python runs.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.functions.text import has_word, let, named_port, stamped_time, strip, whole_number
from palisade.functions.times import ntz

FIELDS = ("timestamp", "source_ip", "destination_port", "protocol", "log_source", "event_type",
          "severity", "username", "raw_log")


def record(
    log_source: str,
    source_ip: Column,
    port: Column | int | None,
    protocol: Column | str | None,
    event_type: Column | str,
    severity: Column | str,
    username: Column | None = None,
) -> Column:
    """One parsed record as a struct. Time and text are the same for every parser."""
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.col("_time").alias("timestamp"),
        source_ip.alias("source_ip"),
        column(port).cast("int").alias("destination_port"),
        column(protocol).cast("string").alias("protocol"),
        F.lit(log_source).alias("log_source"),
        column(event_type).alias("event_type"),
        column(severity).alias("severity"),
        column(username).cast("string").alias("username"),
        F.col("_text").alias("raw_log"),
    )


def with_parts(lines: DataFrame, reference_time: datetime | Column) -> DataFrame:
    """Extract what the parsers need. Part columns start with an underscore."""
    line = F.col("line")
    now = reference_time if isinstance(reference_time, Column) else ntz(reference_time)
    # A capture that did not match is empty here and made null in the next step. In one
    # step, the comparison would search the line again.
    search = {
        "_iso": (None, fixed.ISO_STAMP, 0),
        "_stamp": (None, fixed.SYSLOG_STAMP, 0),
        "_failed_ip": ("Failed password", fixed.SSH_FAILED, 3),
        "_failed_user": ("Failed password", fixed.SSH_FAILED, 2),
        "_accepted_ip": ("Accepted password", fixed.SSH_ACCEPTED, 2),
        "_accepted_user": ("Accepted password", fixed.SSH_ACCEPTED, 1),
        "_invalid_ip": ("Invalid user", fixed.SSH_INVALID, 2),
        "_invalid_user": ("Invalid user", fixed.SSH_INVALID, 1),
        "_packet_ip": ("SRC=", fixed.PACKET_SOURCE, 1),
        "_packet_port": ("DPT=", fixed.PACKET_PORT, 1),
        "_packet_protocol": ("PROTO=", fixed.PACKET_PROTOCOL, 1),
        "_ip": (None, fixed.IPV4, 1),
        "_colon_port": (":", fixed.COLON_PORT, 1),
    }

    def capture(needs: str | None, pattern: str, number: int) -> Column:
        found = F.regexp_extract(line, pattern, number)
        return found if needs is None else F.when(line.contains(needs), found)

    captured = lines.withColumns({
        **{name: capture(*how) for name, how in search.items()},
        "_text": strip(line),
        "_lower": F.lower(line),
    }).withColumns({name: F.nullif(name, F.lit("")) for name in search})
    return captured.withColumns({
        "_time": stamped_time(F.col("_iso"), F.col("_stamp"), now),
        "_packet_port": whole_number(F.col("_packet_port")),
        "_colon_port": whole_number(F.col("_colon_port")),
    })


def auth() -> Column:
    """SSH logins. A failed login wins when a line has both."""
    return F.when(
        F.col("_failed_ip").isNotNull(),
        record("auth.log", F.col("_failed_ip"), fixed.SSH_PORT, "TCP", "SSH_FAILED_LOGIN", "HIGH", F.col("_failed_user")),
    ).when(
        F.col("_accepted_ip").isNotNull(),
        record("auth.log", F.col("_accepted_ip"), fixed.SSH_PORT, "TCP", "SSH_LOGIN_SUCCESS", "LOW", F.col("_accepted_user")),
    )


def ufw() -> Column:
    """Packets logged by UFW; some ports are watched."""
    port = F.col("_packet_port")
    watched = port.isin(*fixed.UFW_WATCHED_PORTS)
    return F.when(
        F.col("line").contains("[UFW") & F.col("_packet_ip").isNotNull(),
        record("ufw.log", F.col("_packet_ip"), port, F.col("_packet_protocol"),
               F.when(watched, "SUSPICIOUS_PORT_ACCESS").otherwise("UFW_TRAFFIC"),
               F.when(watched, "HIGH").otherwise("LOW")),
    )


def iptables() -> Column:
    """Packets logged by the kernel. A blocked packet outranks everything else.

    An opening packet (SYN without ACK) takes the later of its severity and MEDIUM in
    *alphabetic* order, which lowers HIGH to MEDIUM; kept, as results depend on it.
    """
    line, port = F.col("line"), F.col("_packet_port")
    blocked = line.contains("DROP") | line.contains("REJECT")
    opening = line.contains("SYN") & ~line.contains("ACK")
    watched = port.isin(*fixed.IPTABLES_WATCHED_PORTS)
    by_port = F.when(watched, "HIGH").otherwise("LOW")
    event = (
        F.when(blocked, "IPTABLES_BLOCKED")
        .when(port.isin(*fixed.IPTABLES_SQL_PORTS), "SQL_ACCESS_ATTEMPT")
        .when(watched, "SUSPICIOUS_PORT_ACCESS")
        .when(opening, "CONNECTION_ATTEMPT")
        .otherwise("IPTABLES_TRAFFIC")
    )
    severity = (
        F.when(blocked, "MEDIUM")
        .when(opening, F.greatest(by_port, F.lit("MEDIUM")))
        .otherwise(by_port)
    )
    return F.when(
        line.contains("kernel:") & F.col("_packet_ip").isNotNull(),
        record("iptables", F.col("_packet_ip"), port, F.col("_packet_protocol"), event, severity),
    )


def sql() -> Column:
    """Database lines. Any line with an IPv4 address counts, at least as an access.

    The port is the first number after a colon or "port"; on lines with a clock that is
    often its minutes. Zero means the default port.
    """
    line, lowered = F.col("line"), F.col("_lower")
    match = F.regexp_extract(line, fixed.COLON_OR_NAMED_PORT, 0)
    port = let(match, lambda m: F.when(
        m != "", F.nullif(whole_number(F.regexp_extract(m, r"(?U)\d+", 0)), F.lit(0)),
    ).otherwise(named_port(line, lowered, fixed.SQL_PORT_NAMES)))
    # Event and severity are decided together; the patterns are tried in order.
    kind = lambda event, severity: F.struct(F.lit(event).alias("event"), F.lit(severity).alias("severity"))
    found = (
        F.when(line.rlike(fixed.SQL_INJECTION), kind("SQL_INJECTION_ATTEMPT", "CRITICAL"))
        .when(line.rlike(fixed.SQL_FAILED), kind("SQL_AUTH_FAILED", "HIGH"))
        .when(line.rlike(fixed.SQL_CONNECTION), kind("SQL_CONNECTION_ATTEMPT", "MEDIUM"))
        .when(line.rlike(fixed.SQL_PORT), kind("SQL_PORT_ACCESS", "HIGH"))
        .otherwise(kind("SQL_ACCESS_ATTEMPT", "HIGH"))
    )
    detail = let(found, lambda x: record(
        "sql.log", F.col("_ip"), F.coalesce(port, F.lit(fixed.SQL_DEFAULT_PORT)), "TCP", x["event"], x["severity"]))
    return F.when(F.col("_ip").isNotNull(), detail)


def syslog() -> Column:
    """Anything else: SSH lines, then database failures, then any line with an address.

    The user of an SSH line is kept only when it is literally "user"; results depend on it.
    """
    line, lowered, ip = F.col("line"), F.col("_lower"), F.col("_ip")
    matched = lambda kind: F.col(f"_{kind}_ip").isNotNull()
    user = F.when(matched("failed"), F.col("_failed_user")).when(
        matched("accepted"), F.col("_accepted_user")).otherwise(F.col("_invalid_user"))
    failed = line.contains("Failed password") | line.contains("Invalid user")
    ssh = record(
        "syslog", F.coalesce("_failed_ip", "_accepted_ip", "_invalid_ip"), fixed.SSH_PORT, "TCP",
        F.when(failed, "SSH_FAILED_LOGIN").otherwise("SSH_LOGIN_SUCCESS"),
        F.when(failed, "HIGH").otherwise("LOW"), F.when(user == "user", user))
    database = record(
        "syslog", ip,
        F.coalesce(F.nullif("_colon_port", F.lit(0)), named_port(line, lowered, fixed.SYSLOG_PORT_NAMES),
                   F.lit(fixed.SQL_DEFAULT_PORT)),
        "TCP",
        F.when(has_word(lowered, fixed.SYSLOG_FAILURE_WORDS), "SQL_AUTH_FAILED").otherwise("SQL_ACCESS_ATTEMPT"),
        "HIGH")
    alarming = has_word(lowered, fixed.SYSLOG_SECURITY_WORDS)
    general = record(
        "syslog", ip, F.col("_colon_port"), None,
        F.when(alarming, "SYSLOG_SECURITY_EVENT").otherwise("SYSLOG_ENTRY"),
        F.when(alarming, "MEDIUM").otherwise("LOW"))
    about_sql = line.rlike(fixed.SYSLOG_SQL[0]) | line.rlike(fixed.SYSLOG_SQL[1])
    return (
        F.when(matched("failed") | matched("accepted") | matched("invalid"), ssh)
        .when(ip.isNotNull(), F.when(about_sql, database).otherwise(general))
    )


PARSERS: dict[str, Callable[[], Column]] = {
    "auth": auth, "ufw": ufw, "iptables": iptables, "sql": sql, "syslog": syslog}

# The hint words of each parser, tried in this order.
HINTS = (("auth", ("auth",)), ("ufw", ("ufw",)), ("iptables", ("iptables", "netfilter")),
         ("sql", ("sql",)), ("syslog", ("syslog",)))

# The order in which parsers are tried on content. "reference" puts SQL first, which claims
# every line with an IPv4 address; "specific_first" gives the narrow parsers their turn.
CONTENT_ORDER = {
    "reference": ("sql", "auth", "ufw", "iptables", "syslog"),
    "specific_first": ("auth", "ufw", "iptables", "sql", "syslog"),
}


def routed(router: str = "reference") -> Column:
    """The record of the parser that the hint names, else of the first that fits."""
    hint = F.lower("log_source_hint")
    hinted = None
    for name, words in HINTS:
        fits = has_word(hint, words)
        hinted = F.when(fits, PARSERS[name]()) if hinted is None else hinted.when(fits, PARSERS[name]())
    return F.coalesce(hinted, *[PARSERS[name]() for name in CONTENT_ORDER[router]])


def parse_lines(
    lines: DataFrame,
    reference_time: datetime | Column,
    parser: str | None = None,
    router: str = "reference",
) -> DataFrame:
    """Lines with their record in ``parsed``, null when there is none.

    ``reference_time`` gives the year of year-less stamps and the time of lines without a
    stamp. ``parser`` names one parser to use on all lines; the router decides otherwise.
    Blank lines are never parsed.
    """
    if parser is None and router not in CONTENT_ORDER:
        raise ValueError(f"unknown router {router!r}")
    if "log_source_hint" not in lines.columns:
        lines = lines.withColumn("log_source_hint", F.lit(None).cast("string"))
    found = PARSERS[parser]() if parser else routed(router)
    return with_parts(lines, reference_time).select(
        *lines.columns, F.when(F.length("_text") > 0, found).alias("parsed"))


def records(parsed: DataFrame) -> DataFrame:
    """The records of parsed lines; other lines are left out.

    Unpacking a list of one record or none drops the others without a filter, which the
    optimizer would move down and so parse every line twice.
    """
    return parsed.select(
        F.col("line_id").alias("log_id"), F.inline(F.array_compact(F.array("parsed"))))


def failures(parsed: DataFrame) -> DataFrame:
    """The lines that could not be parsed."""
    return parsed.where(F.col("parsed").isNull()).drop("parsed")
