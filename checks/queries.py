"""The queries the driver runs: one per operator, over whole tables.

The log operators read the log table derived from `events`. Results are flat: lists are
joined to text, rates are rounded to four places, so that values compare exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import streams
from checks.feeds import provider_answers
from palisade.functions.text import format_ip, format_threat_type
from palisade.operators import browse, brute_force, filters, floods, port_scan, reputation, stats
from palisade.plans import dashboard, export, report, retention, threats
from palisade.plans.threats import Detections, DetectorSettings
from palisade.functions.times import ntz, parse_range
from palisade.session import configure, shared_folder
from palisade.sources import ingest, parsers, rollup
from palisade.sources.event_view import logs_as_lines, read_logs
from palisade.sources.tables import append_logs, export_rows, read_logs as read_table

WHOLE = {"start": datetime(2000, 1, 1), "end": datetime(2100, 1, 1)}
SINGLE = {"window_seconds": 60, "single_ip_threshold": 8, **WHOLE}
SPREAD = {"window_seconds": 60, "distributed_ip_count": 3, "distributed_request_threshold": 20, **WHOLE}
FLOOD = {**SINGLE, **SPREAD}
AS_OF = datetime(2024, 1, 30, 0, 2)
RETENTION_BATCH = 70
REFERENCE_TIME = datetime(2024, 6, 1, 12)

Query = Callable[[SparkSession, str], DataFrame]


def over_logs(operator: Callable[[DataFrame], DataFrame]) -> Query:
    """A query from an operator over the derived log table."""
    return lambda spark, folder: operator(read_logs(configure(spark), folder))


def joined(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


def rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 4) for c in columns})


def _port_scan(logs: DataFrame) -> DataFrame:
    return port_scan.detect_port_scan(logs, **WHOLE).withColumn("ports_attempted", joined("ports_attempted"))


def _scan_details(logs: DataFrame) -> DataFrame:
    return port_scan.window_details(logs, **WHOLE).withColumns({
        "ports": joined("ports"),
        "attempts": F.array_join(F.transform("attempts", lambda a: a["log_id"].cast("string")), ","),
    })


def _single_flood(logs: DataFrame) -> DataFrame:
    found = floods.detect_single_floods(logs, **SINGLE).select(
        F.col("source_ips")[0].alias("source_ip"), "total_requests", "peak_request_rate", "avg_request_rate",
        joined("target_ports"), joined("target_protocols"), "first_request", "last_request",
        "window_count", "severity")
    return rounded(found, "peak_request_rate", "avg_request_rate")


def _distributed_flood(logs: DataFrame) -> DataFrame:
    found = floods.detect_distributed_floods(logs, **SPREAD).drop("attack_type", "top_attacking_ips")
    return rounded(found.withColumn("source_ips", joined("source_ips")), "peak_request_rate", "avg_request_rate")


def _distributed_windows(logs: DataFrame) -> DataFrame:
    text = lambda x: F.concat(x["source_ip"], F.lit("="), x["requests"].cast("string"))
    found = floods.distributed_flood_windows(logs, **SPREAD).withColumn(
        "top_attacking_ips", F.array_join(F.transform("top_attacking_ips", text), ","))
    return rounded(found, "request_rate_per_min")


def _defaults(logs: DataFrame) -> DataFrame:
    """Blank out some fields first, so that there is something to fill."""
    blank = lambda step, column, value: F.when(F.col("log_id") % step == 0, F.lit(value)).otherwise(F.col(column))
    holed = logs.withColumns({
        "timestamp": blank(11, "timestamp", None), "log_source": blank(3, "log_source", ""),
        "event_type": blank(5, "event_type", None), "severity": blank(7, "severity", ""),
    })
    return filters.with_defaults(holed).select(
        "log_id", "timestamp", "source_ip", "log_source", "event_type", "severity", "raw_log")


def over_lines(parser: str | None = None, hints: bool = True, router: str = "reference") -> Query:
    """Records parsed from the rendered text of all lines."""
    def run(logs: DataFrame) -> DataFrame:
        return parsers.records(_parsed(logs, parser, hints, router))
    return over_logs(run)


def _parsed(logs: DataFrame, parser: str | None = None, hints: bool = True, router: str = "reference") -> DataFrame:
    # Parsing is heavy per row, and the given table is one small file.
    lines = logs_as_lines(logs).repartition(logs.sparkSession.sparkContext.defaultParallelism)
    return parsers.parse_lines(lines if hints else lines.drop("log_source_hint"), REFERENCE_TIME, parser, router)


def _reputation(logs: DataFrame) -> DataFrame:
    return reputation.latest(reputation.normalize(provider_answers(logs)))


def _flat_reputation(frame: DataFrame) -> DataFrame:
    return frame.withColumns({"categories": joined("categories"), "detection_names": joined("detection_names")})


def _half(logs: DataFrame) -> DataFrame:
    """Reputation of the sources that first appeared early: the others have no record."""
    return _reputation(logs).where(F.col("asn") % 2 == 0)


def _enriched(logs: DataFrame) -> DataFrame:
    return reputation.enrich(logs, _half(logs)).select(
        "log_id", "source_ip", "severity", "reputation.threat_level", "reputation.reputation_score")


def _lookup(logs: DataFrame) -> DataFrame:
    ips = logs.select(F.col("source_ip").alias("ip"))
    return reputation.classify(reputation.lookup(ips, _half(logs))).select(
        "ip", "detected", "reputation_score", "threat_level", "error", "class")


def _brute_enriched(logs: DataFrame) -> DataFrame:
    found = reputation.enrich(brute_force.detect_brute_force(logs, **WHOLE), _half(logs))
    return found.select("source_ip", "total_attempts", "severity", "reputation.threat_level")


def _flood_reputation(logs: DataFrame) -> DataFrame:
    found = reputation.flood_reputations(floods.detect_floods(logs, **FLOOD), _half(logs))
    return found.select(
        "attack_type", "target_port", "target_protocol", "first_request", "severity",
        F.explode("source_ip_reputations").alias("ip", "record"),
    ).select("attack_type", "target_port", "target_protocol", "first_request", "severity", "ip",
             "record.threat_level", "record.error")


SETTINGS = DetectorSettings(floods={
    k: v for k, v in FLOOD.items() if k not in WHOLE})


def _found(logs: DataFrame) -> Detections:
    return threats.detect_all(logs, **WHOLE, settings=SETTINGS)


def over_detections(operator: Callable[[Detections], DataFrame]) -> Query:
    return over_logs(lambda logs: operator(_found(logs)))


def _flood_detections(logs: DataFrame) -> DataFrame:
    found = floods.detect_floods(logs, **FLOOD).select(
        "attack_type", joined("source_ips"), "source_ip_count", "total_requests", "peak_request_rate",
        "avg_request_rate", "target_port", "target_protocol", "first_request", "last_request", "window_count", "severity")
    return rounded(found, "peak_request_rate", "avg_request_rate")


def _flood_filter(logs: DataFrame) -> DataFrame:
    found = floods.detect_floods(logs, **FLOOD)
    mine = filters.from_source(filters.of_severity(found, "CRITICAL"), "10.0.0.3")
    return mine.select("attack_type", "target_port", "target_protocol", "total_requests", "severity")


def _top_with_reputation(logs: DataFrame) -> DataFrame:
    return threats.source_reputations(threats.top_threat_sources(_found(logs)), _half(logs)).select(
        "ip", "total_attempts", "threat_level", "reputation_score", "class")


def _malicious(logs: DataFrame) -> DataFrame:
    found = threats.malicious_ip_analysis(threats.top_threat_sources(_found(logs)), _half(logs))
    return found.withColumn("malicious_ip_list", F.array_join(
        F.transform("malicious_ip_list", lambda x: F.concat_ws("/", x["ip"], x["threat_level"])), ","))


def _report(logs: DataFrame):
    return report.custom_report(logs, _half(logs), **WHOLE, settings=SETTINGS)


def _lines(sections: DataFrame) -> DataFrame:
    return sections.select("section_no", "line_no", F.array_join("cells", "|").alias("line"))


def _report_file(logs: DataFrame) -> DataFrame:
    """The print lines of a report as its export writes them, read back."""
    spark, path = logs.sparkSession, f"{shared_folder(logs.sparkSession)}/palisade/report-{uuid.uuid4().hex}"
    export.export_report(_report(logs), path, "print")
    lines = spark.read.schema("section_no int, section string, section_type string, cells array<string>").json(path)
    return lines.select("section_no", F.array_join("cells", "|").alias("line"))


def _dashboard_score(logs: DataFrame) -> DataFrame:
    return dashboard.score(threats.threat_summary(_found(logs)), dashboard.health(logs, AS_OF))


def _labels(logs: DataFrame) -> DataFrame:
    """Display labels of the detections, and of a source that is missing."""
    found = _found(logs)
    kinds = (found.brute_force.select(F.lit("brute-force").alias("kind"), "source_ip")
             .unionByName(found.port_scans.select(F.lit("PortScan").alias("kind"), "source_ip"))
             .unionByName(found.floods.select(F.col("attack_type").alias("kind"), F.lit(None).cast("string").alias("source_ip"))))
    return kinds.select(format_threat_type("kind").alias("label"), format_ip("source_ip").alias("source")).groupBy(
        "label", "source").agg(F.count("*").alias("detections"))


def _retained(logs: DataFrame) -> DataFrame:
    """Keep about a third: the limit follows from the size of the log itself."""
    return retention.retained(logs, _limit(logs), RETENTION_BATCH)


def _limit(logs: DataFrame) -> int:
    return int(logs.agg(F.sum(retention.row_bytes()).alias("b")).first()["b"]) // 3


def _cut(logs: DataFrame) -> DataFrame:
    return _cut_rows(logs, retention.find_cut(logs, _limit(logs), RETENTION_BATCH))


def _cut_rows(logs: DataFrame, cut: retention.Cut) -> DataFrame:
    return logs.where(~retention.after(cut)).agg(
        F.count("*").alias("deleted_rows"), F.max("timestamp").alias("cut_at"),
        F.sum(retention.row_bytes()).alias("deleted_bytes"))


def _report_values(logs: DataFrame) -> DataFrame:
    """The JSON document read back, as one line per value or list entry."""
    made = _report(logs)
    kind = T.StructType([f for f in export.document(made).schema.fields])
    doc = export.json_document(made).select(F.from_json("json", kind).alias("d"))
    text = lambda *c: F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("-")) for x in c])
    line = lambda section, value: F.struct(F.lit(section).alias("section"), value.alias("value"))
    listed = lambda section, path, *names: F.transform(
        F.col(path), lambda x: line(section, text(*[x[n] if n != "peak_request_rate" else F.round(x[n], 4) for n in names])))
    mapped = lambda section: F.transform(
        F.map_entries(F.col(f"d.log_statistics.{section}")), lambda x: line(section, text(x["key"], x["value"])))
    summary = [F.col(f"d.summary.{c}") for c in ("total_logs", "security_score", "security_status")] + [
        F.col(f"d.summary.threat_summary.{c}") for c in ("total_threats", "critical_threats", "high_threats", "medium_threats", "low_threats")]
    lines = F.concat(
        F.array(line("summary", text(*summary)), line("report", text(F.col("d.report_type"), F.col("d.period.start"), F.col("d.period.end")))),
        mapped("severity_distribution"), mapped("event_type_distribution"), mapped("protocol_distribution"),
        listed("top_source_ips", "d.log_statistics.top_source_ips", "source_ip", "count", "high", "medium", "low"),
        listed("top_ports", "d.log_statistics.top_ports", "port", "count", "protocol"),
        listed("brute_force_attacks", "d.threat_detections.brute_force_attacks", "source_ip", "total_attempts", "severity",
               "first_attempt", "last_attempt"),
        listed("ddos_attacks", "d.threat_detections.ddos_attacks", "attack_type", "source_ip_count", "total_requests",
               "peak_request_rate", "target_port", "target_protocol", "severity", "first_request", "last_request"),
        listed("port_scan_attacks", "d.threat_detections.port_scan_attacks", "source_ip", "total_attempts",
               "unique_ports_attempted", "severity", "first_attempt", "last_attempt"),
        listed("top_threat_sources", "d.top_threat_sources", "ip", "total_attempts", "severity"),
        F.transform("d.recommendations", lambda x: line("recommendations", x)),
    )
    return doc.select(F.inline(lines))


def _ranked(logs: DataFrame) -> DataFrame:
    """The place of each detection in its detector's order."""
    found = _found(logs)
    placed = lambda kind, frame, order, key, size: frame.select(
        F.lit(kind).alias("detector"), F.row_number().over(Window.orderBy(*order())).alias("place"),
        key.alias("key"), F.col(size).alias("size"))
    return (
        placed("brute_force", found.brute_force, brute_force.detection_order, F.col("source_ip"), "total_attempts")
        .union(placed("port_scan", found.port_scans, port_scan.detection_order, F.col("source_ip"), "total_attempts"))
        .union(placed("ddos", found.floods, floods.detection_order, F.array_join("source_ips", ","), "total_requests")))


def _scan_enriched(logs: DataFrame) -> DataFrame:
    found = reputation.enrich(port_scan.detect_port_scan(logs, **WHOLE), _half(logs))
    return found.select("source_ip", "total_attempts", "severity", "reputation.threat_level")


def _new_table(logs: DataFrame) -> str:
    return f"{shared_folder(logs.sparkSession)}/palisade/table-{uuid.uuid4().hex}"


def _stored(logs: DataFrame) -> str:
    """The log in a table's own folders: two loads, one of them written twice."""
    path, even = _new_table(logs), F.col("log_id") % 2 == 0
    for load, rows in (("even", logs.where(even)), ("odd", logs.where(~even)), ("even", logs.where(even))):
        append_logs(rows, path, load)
    return path


def _exported(rows: DataFrame, kind: str) -> DataFrame:
    """Rows after they were written as files for others and read back by their names."""
    path = f"{shared_folder(rows.sparkSession)}/palisade/export-{uuid.uuid4().hex}"
    export_rows(rows, path, kind)
    files = rows.sparkSession.read.schema(rows.schema)
    # An empty text is written with quotes, a missing one without.
    return files.json(path) if kind == "json" else files.option("header", True).option("emptyValue", "").csv(path)


def _stored_and_read(logs: DataFrame) -> DataFrame:
    return read_table(logs.sparkSession, _stored(logs)).select(*logs.columns)


def _stored_page(logs: DataFrame) -> DataFrame:
    """A page by time of a stored table, whose days are known from its folders."""
    spark, path = logs.sparkSession, _stored(logs)
    return browse.page(read_table(spark, path), 3, 50, days=rollup.days(spark, path)).select(*logs.columns)


def _stored_hours(logs: DataFrame) -> DataFrame:
    spark, path = logs.sparkSession, _stored(logs)
    return rollup.logs_by_hour(
        rollup.read_rollup(spark, path), read_table(spark, path), datetime(2024, 1, 5, 0, 2, 30), datetime(2024, 1, 29, 0, 3))


def _stored_cut(logs: DataFrame) -> DataFrame:
    """The cut of a stored table, from its rollup and single hours."""
    spark, path = logs.sparkSession, _stored(logs)
    table = read_table(spark, path)
    return _cut_rows(table, retention.find_cut(table, _limit(logs), RETENTION_BATCH, rollup.read_rollup(spark, path)))


def _ingested(logs: DataFrame) -> DataFrame:
    """The log table after its lines came in as two loads that bring no ids."""
    path, even = _new_table(logs), F.col("log_id") % 2 == 0
    for rows in (logs.where(even), logs.where(~even)):
        ingest.ingest_lines(rows.select(F.col("raw_log").alias("line")), path, REFERENCE_TIME)
    table = read_table(logs.sparkSession, path)
    ids = table.agg(F.min("log_id").alias("first_id"), F.max("log_id").alias("last_id"), F.countDistinct("log_id").alias("ids"))
    # One row beside each record.
    return table.select(*[c for c in logs.columns if c != "log_id"], F.lit(1).alias("one")).join(
        ids.withColumn("one", F.lit(1)), "one").drop("one")


def _reputation_stored(logs: DataFrame) -> DataFrame:
    """The reputation table after three stores, the last of them a repetition."""
    path = f"{shared_folder(logs.sparkSession)}/palisade/reputation-{uuid.uuid4().hex}"
    answers = reputation.normalize(provider_answers(logs))
    early = answers.where(F.col("cached_at") <= ntz(AS_OF))
    for part in (early, answers, answers):
        reputation.store(part, path)
    return _flat_reputation(reputation.read_reputation(logs.sparkSession, path))


def _odd_lines(logs: DataFrame) -> DataFrame:
    """Lines of shapes that the rendered log does not have: blank, padded, and three of syslog."""
    ip, kind = F.col("source_ip"), F.col("log_id") % 5
    text = (
        F.when(kind == 0, F.lit("   \t "))
        .when(kind == 1, F.concat(F.lit("   gw app: hello from "), ip, F.lit("  ")))
        .when(kind == 2, F.concat(F.lit("Mar  3 04:05:06 gw sshd[7]: Invalid user bob from "), ip))
        .when(kind == 3, F.concat(F.lit("mysql login failed for "), ip))
        .otherwise(F.concat(F.lit("2024-02-03T04:05:06 gw app: traffic blocked from "), ip)))
    lines = logs.select(F.col("log_id").alias("line_id"), text.alias("line"), F.lit("syslog").alias("log_source_hint"))
    return parsers.records(parsers.parse_lines(lines, REFERENCE_TIME))


def queries() -> dict[str, Query]:
    return {
        # brute force
        "brute_force": over_logs(lambda t: brute_force.detect_brute_force(t, **WHOLE)),
        "brute_force_windows": over_logs(lambda t: brute_force.brute_force_windows(t, **WHOLE)),
        "brute_force_attempts": over_logs(lambda t: brute_force.window_attempts(t, **WHOLE)),
        "brute_force_usernames": over_logs(
            lambda t: brute_force.usernames_tried(brute_force.failed_logins(t, **WHOLE))),
        "ip_timeline": over_logs(lambda t: brute_force.timeline(t, "10.0.0.3", **WHOLE)),
        "ip_timeline_total": over_logs(lambda t: brute_force.timeline_total(t, "10.0.0.3", **WHOLE)),
        # port scan
        "port_scan": over_logs(_port_scan),
        "port_scan_windows": over_logs(lambda t: port_scan.port_scan_windows(t, **WHOLE)),
        "port_scan_window_details": over_logs(_scan_details),
        # floods
        "single_flood_windows": over_logs(
            lambda t: rounded(floods.single_flood_windows(t, **SINGLE), "request_rate_per_min")),
        "single_ip_flood": over_logs(_single_flood),
        "single_flood_window_counts": over_logs(lambda t: floods.single_flood_window_counts(t, **SINGLE)),
        "distributed_flood_windows": over_logs(_distributed_windows),
        "distributed_flood": over_logs(_distributed_flood),
        # filters and browsing
        "log_filter": over_logs(lambda t: filters.filter_logs(
            t, severity="HIGH", protocol="TCP", destination_port=3306,
            start=datetime(2024, 1, 3), end=datetime(2024, 1, 20, 0, 3))),
        "log_search": over_logs(lambda t: filters.search(t, r"INVALID user|10\.0\.0\.[37]$")),
        "log_page": over_logs(lambda t: browse.page(t, 3, 50)),
        "log_page_by_severity": over_logs(lambda t: browse.page(t, 3, 40, sort_by="severity")),
        "log_page_stored": over_logs(_stored_page),
        "logs_by_hour_stored": over_logs(_stored_hours),
        "log_page_info": over_logs(lambda t: browse.page_info(filters.filter_logs(t, severity="HIGH"), 3, 50)),
        "log_lookup": over_logs(lambda t: browse.lookup(t, 77)),
        "log_defaults": over_logs(_defaults),
        "recent_activity": over_logs(lambda t: browse.recent(t, 50)),
        "log_date_range": over_logs(lambda t: filters.filter_logs(
            t, severity="HIGH", **dict(zip(("start", "end"), parse_range("2024-01-03", "2024-01-20T00:03:00Z"))))),
        "log_date_range_whole_day": over_logs(lambda t: filters.filter_logs(
            t, severity="HIGH", **dict(zip(("start", "end"), parse_range("2024-01-03", "2024-01-04", end_of_day=True))))),
        "log_export_csv": over_logs(lambda t: _exported(filters.filter_logs(t, severity="HIGH"), "csv")),
        "log_export_json": over_logs(lambda t: _exported(filters.filter_logs(t, severity="HIGH"), "json")),
        "threat_export_csv": over_logs(lambda t: _exported(brute_force.detect_brute_force(t, **WHOLE), "csv")),
        # statistics
        "total_logs": over_logs(lambda t: t.agg(F.count("*").alias("total_logs"))),
        "severity_counts": over_logs(lambda t: stats.count_by(t, "severity")),
        "event_type_counts": over_logs(lambda t: stats.count_by(t, "event_type")),
        "protocol_counts": over_logs(lambda t: stats.count_by(t, "protocol")),
        "logs_by_hour": over_logs(lambda t: stats.logs_by_hour(t, **WHOLE)),
        "top_ips": over_logs(stats.top_ips),
        "top_ports": over_logs(stats.top_ports),
        "severity_share": over_logs(stats.severity_share),
        "top_event_types": over_logs(stats.top_event_types),
        "stats_bundle": over_logs(lambda t: stats.statistics(t, as_of=AS_OF)),
        "time_breakdown": over_logs(lambda t: stats.time_breakdown(t, **WHOLE)),
        # parsing
        "parse_auth": over_lines("auth"),
        "parse_ufw": over_lines("ufw"),
        "parse_iptables": over_lines("iptables"),
        "parse_sql": over_lines("sql"),
        "parse_syslog": over_lines("syslog"),
        "parse_routed": over_lines(),
        "parse_unhinted": over_lines(hints=False),
        "parse_specific_first": over_lines(hints=False, router="specific_first"),
        "parse_failures": over_logs(lambda t: parsers.failures(_parsed(t, "ufw"))),
        "ingest_batch": over_logs(_ingested),
        "ingest_summary": over_logs(lambda t: ingest.ingest_summary(_parsed(t, "auth"))),
        # reputation
        "reputation_normalize": over_logs(
            lambda t: _flat_reputation(reputation.normalize(provider_answers(t)))),
        "reputation_latest": over_logs(lambda t: _flat_reputation(_reputation(t))),
        "reputation_known_at": over_logs(lambda t: reputation.known_at(
            reputation.normalize(provider_answers(t)), AS_OF).select("ip", "threat_level", "cached_at", "is_fresh")),
        "reputation_lookup": over_logs(_lookup),
        "logs_enriched": over_logs(_enriched),
        "brute_force_enriched": over_logs(_brute_enriched),
        "flood_reputation": over_logs(_flood_reputation),
        # threats, reports and the dashboard
        "flood_detections": over_logs(_flood_detections),
        "flood_filter": over_logs(_flood_filter),
        "threat_summary": over_detections(threats.threat_summary),
        "threat_levels": over_detections(threats.threat_levels),
        "active_threats": over_detections(lambda d: threats.active_threats(threats.threat_summary(d))),
        "security_score": over_detections(lambda d: threats.security_score(threats.threat_summary(d))),
        "threat_sources": over_detections(threats.threat_sources),
        "top_threat_sources": over_detections(threats.top_threat_sources),
        "threat_source_reputation": over_logs(_top_with_reputation),
        "malicious_ip_analysis": over_logs(_malicious),
        "threat_labels": over_logs(_labels),
        "active_alerts": over_detections(threats.active_alerts),
        "recommendations": over_logs(lambda t: _report(t).recommendations.select("rule_no", "text")),
        "report_summary": over_logs(lambda t: _report(t).summary),
        "report_sections": over_logs(lambda t: _lines(export.csv_sections(_report(t)))),
        "report_print_sections": over_logs(lambda t: _lines(export.print_sections(_report(t)))),
        "report_json": over_logs(_report_values),
        "report_export_print": over_logs(_report_file),
        "dashboard_top_ips": over_logs(lambda t: dashboard.top_ips(t, AS_OF)),
        "health_24h": over_logs(lambda t: dashboard.health(t, AS_OF)),
        "health_24h_stored": over_logs(lambda t: dashboard.health(read_table(t.sparkSession, _stored(t)), AS_OF)),
        "dashboard_top_ips_stored": over_logs(lambda t: dashboard.top_ips(read_table(t.sparkSession, _stored(t)), AS_OF)),
        "dashboard_score": over_logs(_dashboard_score),
        "log_page_deep": over_logs(lambda t: browse.page(t, 150, 50)),
        "log_page_deep_by_severity": over_logs(lambda t: browse.page(t, 200, 40, sort_by="severity")),
        "log_page_by_source": over_logs(lambda t: browse.page(t, 100, 30, "source_ip", "desc", strict_direction=True)),
        "detection_order": over_logs(_ranked),
        "port_scan_enriched": over_logs(_scan_enriched),
        "brute_force_last_day": over_logs(lambda t: brute_force.detect_brute_force(t, as_of=AS_OF)),
        "port_scan_last_day": over_logs(lambda t: port_scan.port_scan_windows(t, as_of=AS_OF)),
        "single_flood_last_hour": over_logs(lambda t: rounded(
            floods.single_flood_windows(t, 60, 8, as_of=AS_OF), "request_rate_per_min")),
        "daily_report": over_logs(lambda t: report.daily_report(t, _half(t), as_of=AS_OF, settings=SETTINGS).summary),
        "weekly_report": over_logs(lambda t: report.weekly_report(t, _half(t), as_of=AS_OF, settings=SETTINGS).summary),
        "dashboard_top_ips_all_time": over_logs(lambda t: dashboard.top_ips(t, datetime(2030, 1, 1))),
        "table_round_trip": over_logs(_stored_and_read),
        "reputation_stored": over_logs(_reputation_stored),
        "parse_odd_lines": over_logs(_odd_lines),
        # streams
        "stream_ingest": over_logs(lambda t: streams.ingested(t, REFERENCE_TIME)),
        "stream_hourly": over_logs(streams.hourly),
        "stream_brute_force": over_logs(streams.brute_force),
        "stream_port_scan": over_logs(streams.port_scan),
        "stream_port_scan_total": over_logs(streams.port_scan_total),
        "stream_distributed_flood": over_logs(streams.distributed_flood),
        "stream_alerts": over_logs(streams.alerts),
        "stream_enriched": over_logs(lambda t: streams.enriched(t, _half(t))),
        # retention
        "retention_keep": over_logs(lambda t: _retained(t).select("log_id", "timestamp", "source_ip", "raw_log")),
        "retention_cut": over_logs(_cut),
        "retention_cut_stored": over_logs(_stored_cut),
    }
