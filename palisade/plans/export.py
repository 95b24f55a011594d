"""Reports as files: rows of titled sections for CSV, print-ready sections, and JSON.

A report may hold millions of detections, so lines are not gathered: every section is a frame
with sort columns, sections are united, and a distributed sort puts lines in order. Only the
JSON document, one nested row by its nature, holds all of a report; sections are the way for
large ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.severity import rank
from palisade.functions.times import iso
from palisade.plans.report import Report

TITLE = "Firewall Security Report"
ORDER = ("section_no", "line_no", "key_1", "key_2", "tie")


def _text(value) -> Column:
    """A cell: text as it is, numbers printed, null as empty."""
    column = value if isinstance(value, Column) else F.col(value)
    return F.coalesce(column.cast("string"), F.lit(""))


class _Section:
    """Builds the lines of one section: constant lines, then one line per row of a frame."""

    def __init__(self, anchor: DataFrame, number: int, name: str, kind: str = "table"):
        self.anchor, self.number, self.name, self.kind = anchor, number, name, kind
        self.parts: list[DataFrame] = []

    def fixed(self, line_no: int, *lines: list[Column | str], only_if: DataFrame | None = None) -> _Section:
        """Constant lines; with ``only_if`` they appear when that frame has a row."""
        row = self.anchor if only_if is None else only_if.limit(1)
        as_cell = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("string")
        cells = F.array(*[
            F.struct(F.lit(i).alias("i"), F.array(*[as_cell(v) for v in line]).cast("array<string>").alias("cells"))
            for i, line in enumerate(lines)])
        exploded = row.select(F.explode(cells).alias("x"))
        return self._add(exploded, line_no, F.col("x.cells"), F.col("x.i"), F.lit(0), F.lit(""))

    def rows(self, frame: DataFrame, cells: list, key_1: Column, key_2: Column | None = None,
             tie: Column | None = None) -> _Section:
        return self._add(frame, 2, F.array(*[_text(c) for c in cells]), key_1,
                         F.lit(0) if key_2 is None else key_2, F.lit("") if tie is None else tie)

    def blank(self, only_if: DataFrame | None = None) -> _Section:
        return self.fixed(3, [], only_if=only_if)

    def _add(self, frame, line_no, cells, key_1, key_2, tie) -> _Section:
        self.parts.append(frame.select(
            F.lit(self.number).alias("section_no"), F.lit(self.name).alias("section"),
            F.lit(self.kind).alias("section_type"), F.lit(line_no).alias("line_no"),
            key_1.cast("double").alias("key_1"), key_2.cast("double").alias("key_2"),
            _text(tie).alias("tie"), cells.alias("cells")))
        return self

    def frame(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


# Fixed values below: titles and column heads of the sections.

SOURCE_HEAD = ["IP Address", "Total Count", "HIGH", "MEDIUM", "LOW"]
BRUTE_HEAD = ["Source IP", "Total Attempts", "Severity", "First Attempt", "Last Attempt"]
SCAN_HEAD = ["Source IP", "Total Attempts", "Unique Ports", "Severity", "First Attempt", "Last Attempt"]
FLOOD_HEAD = ["Attack Type", "Source IP Count", "Total Requests", "Peak Rate (req/min)", "Target Port",
              "Target Protocol", "Severity", "First Request", "Last Request"]
FLOOD_PRINT_HEAD = ["Attack Type", "Source IPs", "Total Requests", "Peak Rate", "Target Port", "Severity"]
THREAT_HEAD = ["IP Address", "Brute Force Attacks", "DDoS Attacks", "Total Attempts", "Severity"]


def _period(report: Report) -> str:
    return f"{report.start.isoformat()} to {report.end.isoformat()}"


def _advice_order() -> tuple[Column, Column, Column]:
    return F.col("rule_no"), F.col("place"), F.col("text")


def csv_sections(report: Report) -> DataFrame:
    """The CSV report as lines: section_no, section, ..., cells. Sort by ``ORDER``."""
    s, found, c = report.summary, report.detections, F.col
    section = lambda number, name: _Section(s, number, name)
    sections = [
        section(1, "HEADER").fixed(
            0, [TITLE], ["Generated:", report.generated.isoformat()], ["Report Type:", report.kind],
            ["Period:", _period(report)]).blank(),
        section(2, "SUMMARY").fixed(
            0, ["SUMMARY"], ["Total Logs", c("total_logs")], ["Security Score", c("security_score")],
            ["Security Status", c("security_status")], ["Total Threats", c("total_threats")],
            ["Critical Threats", c("critical_threats")], ["High Threats", c("high_threats")],
            ["Medium Threats", c("medium_threats")], ["Low Threats", c("low_threats")]).blank(),
        section(3, "SEVERITIES").fixed(0, ["LOG STATISTICS - SEVERITY DISTRIBUTION"], ["Severity", "Count"])
        .rows(report.severities, ["severity", "count"], -rank("severity"), tie=c("severity")).blank(),
        section(4, "EVENT TYPES").fixed(0, ["LOG STATISTICS - EVENT TYPE DISTRIBUTION"], ["Event Type", "Count"])
        .rows(report.event_types, ["event_type", "count"], -c("count"), tie=c("event_type")).blank(),
        section(5, "TOP SOURCES").fixed(0, ["TOP SOURCE IPs"], SOURCE_HEAD)
        .rows(report.top_ips, ["source_ip", "count", "high", "medium", "low"], -c("count"), tie=c("source_ip")).blank(),
        section(6, "TOP PORTS").fixed(0, ["TOP PORTS"], ["Port", "Count", "Protocol"])
        .rows(report.top_ports, ["port", "count", "protocol"], -c("count"), c("port")).blank(),
        section(7, "TIME").fixed(0, ["TIME BREAKDOWN"], ["Time", "Total Logs", "High Severity"], only_if=report.time_breakdown)
        .rows(report.time_breakdown, ["time", "count", "high_severity"], F.lit(0), tie=c("time"))
        .blank(only_if=report.time_breakdown),
        section(8, "BRUTE FORCE").fixed(0, ["BRUTE FORCE ATTACKS"], BRUTE_HEAD)
        .rows(found.brute_force, ["source_ip", "total_attempts", "severity", iso("first_attempt"), iso("last_attempt")],
              -c("total_attempts"), tie=c("source_ip")).blank(),
        section(9, "FLOODS").fixed(0, ["DDOS ATTACKS"], FLOOD_HEAD)
        .rows(found.floods,
              ["attack_type", "source_ip_count", "total_requests", "peak_request_rate", "target_port",
               "target_protocol", "severity", iso("first_request"), iso("last_request")],
              -rank("severity"), -c("peak_request_rate"), F.array_join("source_ips", ",")).blank(),
        section(10, "PORT SCANS").fixed(0, ["PORT SCAN ATTACKS"], SCAN_HEAD, only_if=found.port_scans)
        .rows(found.port_scans,
              ["source_ip", "total_attempts", "unique_ports_attempted", "severity", iso("first_attempt"), iso("last_attempt")],
              -rank("severity"), -c("unique_ports_attempted"),
              F.concat(F.lpad((2**62 - c("total_attempts")).cast("string"), 20, "0"), c("source_ip")))
        .blank(only_if=found.port_scans),
        section(11, "THREAT SOURCES").fixed(0, ["TOP THREAT SOURCES"], THREAT_HEAD)
        .rows(report.top_sources, ["ip", "brute_force_attacks", "ddos_attacks", "total_attempts", "severity"],
              -c("total_attempts"), tie=c("ip")).blank(),
        section(12, "RECOMMENDATIONS").fixed(0, ["RECOMMENDATIONS"])
        .rows(_numbered(report.recommendations), [F.concat(c("number").cast("string"), F.lit(". "), c("text"))], c("number")),
    ]
    return reduce(DataFrame.unionByName, [x.frame() for x in sections])


def _numbered(advice: DataFrame) -> DataFrame:
    """Advice with running numbers; there are a few lines only."""
    return advice.withColumn("number", F.row_number().over(Window.orderBy(*_advice_order())))


def print_sections(report: Report) -> DataFrame:
    """The print-ready report: metadata, header, summary and five typed sections."""
    s, found, c = report.summary, report.detections, F.col
    entry = lambda name, value: [name, value]
    statistics = _Section(s, 4, "Log Statistics", "statistics")
    for position, (title, frame, column) in enumerate((
            ("severity_distribution", report.severities, "severity"),
            ("event_type_distribution", report.event_types, "event_type"),
            ("protocol_distribution", report.protocols, "protocol"))):
        statistics.rows(frame, [F.lit(title), column, "count"], F.lit(position), tie=c(column))
    sections = [
        _Section(s, 1, "metadata", "metadata").fixed(
            0, entry("title", f"{report.kind} Security Report"), entry("generated_at", report.generated.isoformat()),
            entry("start", report.start.isoformat()), entry("end", report.end.isoformat()), entry("report_type", report.kind)),
        _Section(s, 2, "header", "header").fixed(
            0, entry("title", TITLE), entry("subtitle", f"{report.kind} Report"),
            entry("generated", report.generated.strftime("%Y-%m-%d %H:%M:%S UTC")), entry("period", _period(report))),
        _Section(s, 3, "executive_summary", "summary").fixed(
            0, *[entry(n, c(n)) for n in (
                "security_score", "security_status", "total_logs", "total_brute_force_attacks", "total_ddos_attacks",
                "total_port_scan_attacks", "total_threats", "critical_threats", "high_threats", "medium_threats",
                "low_threats")]),
        statistics,
        _Section(s, 5, "Top Source IPs").fixed(0, SOURCE_HEAD)
        .rows(report.top_ips, ["source_ip", "count", "high", "medium", "low"], -c("count"), tie=c("source_ip")),
        _Section(s, 6, "Threat Detections - Brute Force Attacks").fixed(0, BRUTE_HEAD)
        .rows(found.brute_force, ["source_ip", "total_attempts", "severity", iso("first_attempt"), iso("last_attempt")],
              -c("total_attempts"), tie=c("source_ip")),
        _Section(s, 7, "Threat Detections - DDoS Attacks").fixed(0, FLOOD_PRINT_HEAD)
        .rows(found.floods,
              ["attack_type", "source_ip_count", "total_requests", F.format_string("%.2f req/min", "peak_request_rate"),
               F.nullif("target_port", F.lit(0)), "severity"],
              -rank("severity"), -c("peak_request_rate"), F.array_join("source_ips", ",")),
        _Section(s, 8, "Recommendations", "list").rows(report.recommendations, ["text"], *_advice_order()),
    ]
    return reduce(DataFrame.unionByName, [x.frame() for x in sections])


def csv_line(cells: Column) -> Column:
    """Cells as one CSV line; a cell is quoted when it holds a comma, a quote or a line break."""
    quoted = lambda v: F.when(
        v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    return F.array_join(F.transform(cells, quoted), ",")


def write_csv(report: Report, path: str) -> None:
    """The CSV report as text files whose names are in line order."""
    csv_sections(report).orderBy(*ORDER).select(csv_line(F.col("cells")).alias("line")).write.text(path)


def json_sections(report: Report) -> DataFrame:
    """Every part of the report as rows (section, json), values that JSON lacks as text."""
    meta = report.summary.select(
        F.lit(report.kind).alias("report_type"), F.lit(report.generated.isoformat()).alias("report_date"),
        F.struct(F.lit(report.start.isoformat()).alias("start"), F.lit(report.end.isoformat()).alias("end")).alias("period"),
        F.struct("*").alias("summary"))
    found = report.detections
    parts = {
        "report": meta,
        "severity_distribution": report.severities,
        "event_type_distribution": report.event_types,
        "protocol_distribution": report.protocols,
        "top_source_ips": report.top_ips,
        "top_ports": report.top_ports,
        "time_breakdown": report.time_breakdown,
        "brute_force_attacks": found.brute_force.select(
            "source_ip", "total_attempts", "severity", "first_attempt", "last_attempt"),
        "ddos_attacks": found.floods.select(
            "attack_type", "source_ip_count", "total_requests", "peak_request_rate", "target_port",
            "target_protocol", "severity", "first_request", "last_request"),
        "port_scan_attacks": found.port_scans.select(
            "source_ip", "total_attempts", "unique_ports_attempted", "severity", "first_attempt", "last_attempt"),
        "top_threat_sources": report.top_sources,
        "malicious_ip_analysis": report.malicious_ips,
        "recommendations": report.recommendations.select("text"),
    }

    def rows(name: str, frame: DataFrame) -> DataFrame:
        printable = frame.select(*[iso(n).alias(n) if t == "timestamp_ntz" else F.col(n) for n, t in frame.dtypes])
        return printable.select(
            F.lit(name).alias("section"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))

    return reduce(DataFrame.unionByName, [rows(n, f) for n, f in parts.items()])


def document(report: Report) -> DataFrame:
    """The report as one nested row. Its lists are detections and top lists: a document is as
    large as what was found, so a report with very many detections is better taken by sections.
    """
    found = report.detections

    def listed(frame: DataFrame, name: str, *order) -> DataFrame:
        place = F.row_number().over(Window.orderBy(*order)).alias("place")
        shown = frame.select(place, F.struct(*[
            (iso(n) if t == "timestamp_ntz" else F.col(n)).alias(n) for n, t in frame.dtypes]).alias("item"))
        return shown.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias(name))

    def mapped(frame: DataFrame, key: str, name: str) -> DataFrame:
        return frame.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "count")))).alias(name))

    most = lambda *names: [*map(F.desc, names)]
    parts = [
        report.summary.select(F.struct(
            "total_logs", "security_score", "security_status",
            F.struct(*[c for c in report.summary.columns if c not in ("total_logs", "security_score", "security_status")])
            .alias("threat_summary")).alias("summary")),
        mapped(report.severities, "severity", "severity_distribution"),
        mapped(report.event_types, "event_type", "event_type_distribution"),
        mapped(report.protocols, "protocol", "protocol_distribution"),
        listed(report.top_ips, "top_source_ips", F.desc("count"), "source_ip"),
        listed(report.top_ports, "top_ports", F.desc("count"), "port"),
        listed(report.time_breakdown, "time_breakdown", "time"),
        listed(found.brute_force.select("source_ip", "total_attempts", "severity", "first_attempt", "last_attempt"),
               "brute_force_attacks", *most("total_attempts"), "source_ip"),
        listed(found.floods.select(
            "attack_type", "source_ip_count", "total_requests", "peak_request_rate", "target_port", "target_protocol",
            "severity", "first_request", "last_request"),
            "ddos_attacks", F.desc(rank("severity")), *most("peak_request_rate", "total_requests"), "target_port", "first_request"),
        listed(found.port_scans.select(
            "source_ip", "total_attempts", "unique_ports_attempted", "severity", "first_attempt", "last_attempt"),
            "port_scan_attacks", F.desc(rank("severity")), *most("unique_ports_attempted", "total_attempts"), "source_ip"),
        listed(report.top_sources, "top_threat_sources", *most("total_attempts"), "ip"),
        report.malicious_ips.select(F.struct("*").alias("malicious_ip_analysis")),
        listed(report.recommendations, "recommendations", "rule_no"),
    ]
    # Each part is a single row.
    one = F.lit(1).alias("one")
    whole = reduce(lambda a, b: a.join(b.select(one, "*"), "one"), parts[1:], parts[0].select(one, "*"))
    return whole.select(
        F.lit(report.kind).alias("report_type"), F.lit(report.generated.isoformat()).alias("report_date"),
        F.struct(F.lit(report.start.isoformat()).alias("start"), F.lit(report.end.isoformat()).alias("end")).alias("period"),
        "summary",
        F.struct("severity_distribution", "event_type_distribution", "protocol_distribution", "top_source_ips", "top_ports",
                 "time_breakdown").alias("log_statistics"),
        F.struct("brute_force_attacks", "ddos_attacks", "port_scan_attacks").alias("threat_detections"),
        "top_threat_sources", "malicious_ip_analysis",
        F.transform("recommendations", lambda r: r["text"]).alias("recommendations"),
    )


def json_document(report: Report) -> DataFrame:
    """The report as one JSON text, missing values included."""
    return document(report).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def export_report(report: Report, path: str, kind: str) -> None:
    """Write a report as ``csv``, ``json`` (one document), ``json_sections`` (a folder per section) or ``print`` (JSON lines)."""
    if kind == "csv":
        write_csv(report, path)
    elif kind == "json":
        json_document(report).write.text(path)
    elif kind == "json_sections":
        json_sections(report).write.partitionBy("section").text(path)
    elif kind == "print":
        print_sections(report).orderBy(*ORDER).select(
            "section_no", "section", "section_type", "cells").write.json(path)
    else:
        raise ValueError(f"cannot export as {kind!r}")
