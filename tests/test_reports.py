"""Scores, reputation, exports, paging and the log table."""

import glob
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palisade.functions import times
from palisade.functions.severity import lift
from palisade.operators import browse, filters, reputation, stats
from palisade.plans import dashboard, export, report, threats
from palisade.plans.threats import DetectorSettings
from palisade.schema import REPUTATION_SCHEMA
from palisade.sources.event_view import read_logs
from palisade.sources.ingest import ingest
from palisade.sources.tables import append_logs, export_rows, read_lines
from palisade.sources.tables import read_logs as read_table

COUNTS = "critical_threats int, high_threats int, medium_threats int, low_threats int"


@pytest.mark.parametrize("row,want", [((1, 2, 0, 3), (57, "WARNING")), ((5, 0, 0, 0), (20, "CRITICAL")),
                                      ((0, 0, 0, 0), (100, "SECURE")), ((9, 9, 9, 99), (0, "CRITICAL")),
                                      ((0, 4, 0, 0), (60, "MODERATE"))])
def test_security_score(spark, row, want):
    assert threats.security_score(spark.createDataFrame([row], COUNTS)).first()[:] == want


@pytest.mark.parametrize("row,want", [((1, 2, 200, 50), 74), ((0, 0, 0, 0), 100), ((9, 9, 10, 10), 25)])
def test_dashboard_score(spark, row, want):
    frame = spark.createDataFrame([row], "c int, h int, t int, s int")
    assert frame.select(threats.dashboard_score(F.col("c"), F.col("h"), F.col("t"), F.col("s"))).first()[0] == want


@pytest.mark.parametrize("severity,level,detected,want", [
    ("LOW", "HIGH", True, "HIGH"), ("LOW", "MEDIUM", True, "MEDIUM"), ("LOW", "CRITICAL", True, "CRITICAL"),
    ("HIGH", "MEDIUM", True, "HIGH"), ("LOW", "CRITICAL", False, "LOW"), ("CRITICAL", "HIGH", True, "CRITICAL"),
    ("LOW", "LOW", True, "LOW"), ("MEDIUM", None, None, "MEDIUM"), ("ODD", "MEDIUM", True, "MEDIUM"), ("ODD", "LOW", True, "ODD")])
def test_lift(spark, severity, level, detected, want):
    frame = spark.createDataFrame([(severity, level, detected)], "s string, l string, d boolean")
    assert frame.select(lift("s", "l", "d")).first()[0] == want


def provider(malicious, suspicious, undetected):
    return json.dumps({"data": {"id": "x", "attributes": {"last_analysis_stats": {
        "malicious": malicious, "suspicious": suspicious, "undetected": undetected}}}})


def test_reputation_records(spark):
    now = datetime(2024, 1, 2)
    feed = spark.createDataFrame([
        ("a", now, provider(8, 2, 50)), ("b", now, provider(0, 1, 60)), ("c", now, None), ("d", now, "not json"),
        ("e", now, '{"data": {"attributes": {}}}'), ("f", now, provider(29, 0, 71)),
        ("a", now - timedelta(hours=30), provider(0, 0, 1))],
        "ip string, cached_at timestamp_ntz, body string")
    records = reputation.normalize(feed)
    assert records.schema.names == REPUTATION_SCHEMA.names
    got = {r.ip: r for r in reputation.latest(records).collect()}
    assert (got["a"].total_engines, got["a"].reputation_score, got["a"].threat_level, got["a"].detected) == (60, 13, "HIGH", True)
    assert (got["b"].reputation_score, got["b"].threat_level, got["b"].detected) == (0, "LOW", False)
    assert (got["c"].threat_level, got["c"].malicious_count, got["c"].categories) == ("UNKNOWN", None, [])
    assert "d" not in got and got["e"].threat_level == "CLEAN" and got["e"].country == ""
    # In binary floating point 29 / 100 * 100 is a little less than 29.
    assert got["f"].reputation_score == 28
    ips = spark.createDataFrame([("a",), ("b",), ("c",), ("z",), ("",), ("a",)], "ip string")
    classes = {r.ip: r["class"] for r in reputation.classify(reputation.lookup(ips, reputation.latest(records))).collect()}
    assert classes == {"a": "malicious", "b": "suspicious", "c": "clean", "z": "unknown"}
    known = {r.ip: r.is_fresh for r in reputation.known_at(records, now - timedelta(hours=6)).collect()}
    assert known == {"a": False}
    again = reputation.upsert(reputation.latest(records), records.where("ip = 'a'"))
    assert again.count() == 5


def test_pages(spark, small):
    logs = read_logs(spark, small)
    newest = [r.log_id for r in logs.orderBy(F.desc("timestamp"), "log_id").collect()]
    ids = lambda frame: [r.log_id for r in frame.collect()]
    assert ids(browse.page(logs, 2, 30)) == newest[30:60]
    assert ids(browse.page(logs, 1, 30, sort_by="nonsense", direction="asc")) == newest[:30]
    for number in (1, 20, 34, 40):
        assert ids(browse.page(logs, number, 30)) == newest[30 * (number - 1):30 * number]
    oldest = [r.log_id for r in logs.orderBy("timestamp", "log_id").collect()]
    assert ids(browse.page(logs, 3, 30, direction="asc")) == oldest[60:90]
    assert browse.lookup(logs, "no id").count() == 0 and browse.lookup(logs, "5").first().log_id == 5
    first = browse.page(logs, 1, 5, sort_by="severity", direction="desc")
    assert {r.severity for r in first.collect()} == {"CRITICAL"}
    strict = browse.page(logs, 1, 5, sort_by="severity", direction="desc", strict_direction=True)
    assert {r.severity for r in strict.collect()} == {"MEDIUM"}


def test_filters(spark, small):
    logs = read_logs(spark, small)
    assert filters.filter_logs(logs, severity="", destination_port=0, source_ip=None).count() == 1000
    assert filters.filter_logs(logs, pattern="ACCEPTED PASS").count() == logs.where("event_type = 'SSH_LOGIN_SUCCESS'").count()
    with pytest.raises(ValueError):
        filters.filter_logs(logs, user="x")


def test_ranges():
    day = datetime(2024, 1, 3)
    assert times.parse_range("2024-01-01", "2024-01-03T00:00:00Z") == (datetime(2024, 1, 1), day)
    assert times.parse_range("2024-01-01", "2024-01-02", end_of_day=True)[1] == datetime(2024, 1, 2, 23, 59, 59)
    assert times.parse_range("2024-01-01T02:00:00+02:00", "2024-01-02")[0] == datetime(2024, 1, 1)
    for bad in (("2024-01-02", "2024-01-01"), ("x", "2024-01-01")):
        with pytest.raises(ValueError):
            times.parse_range(*bad)
    assert times.week_bounds(None, datetime(2024, 1, 10, 5)) == (day, datetime(2024, 1, 10, 5))
    assert times.day_bounds(day)[1] == datetime(2024, 1, 3, 23, 59, 59, 999999)


def test_table_prunes_days(spark, small, tmp_path):
    table = str(tmp_path / "table")
    append_logs(read_logs(spark, small), table)
    rows = filters.in_range(read_table(spark, table), datetime(2024, 1, 5), datetime(2024, 1, 6))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "log_date" in plan.split("PartitionFilters:")[1].split("]")[0] and "PushedFilters: [IsNotNull(timestamp)" in plan
    assert rows.count() == filters.in_range(read_logs(spark, small), datetime(2024, 1, 5), datetime(2024, 1, 6)).count() > 0


def test_batch_ingest(spark, tmp_path):
    (tmp_path / "in.txt").write_text("Failed password for root from 10.1.1.1\nnothing\n\n")
    lines = read_lines(spark, str(tmp_path / "in.txt"), "auth.log")
    counts = ingest(lines, str(tmp_path / "table"), datetime(2024, 6, 1)).first()
    assert (counts.success, counts.ingested_count, counts.failed_count, counts.total_received) == (True, 1, 2, 3)
    assert counts.message == "Successfully ingested 1 log(s). 2 failed to parse."
    assert read_table(spark, str(tmp_path / "table")).first().source_ip == "10.1.1.1"
    nothing = spark.createDataFrame([(1, "x")], "line_id bigint, line string")
    assert ingest(nothing, str(tmp_path / "none"), datetime(2024, 6, 1)).first().message == "No logs could be parsed from the provided lines"


def test_report_files(spark, small, tmp_path):
    logs = read_logs(spark, small)
    nobody = spark.createDataFrame([], REPUTATION_SCHEMA)
    made = report.weekly_report(logs, nobody, datetime(2024, 1, 2), as_of=datetime(2024, 1, 9),
                                settings=DetectorSettings(floods={"single_ip_threshold": 8}))
    for kind in ("csv", "json", "json_sections", "print"):
        export.export_report(made, str(tmp_path / kind), kind)
    text = "".join(open(f).read() for f in sorted(glob.glob(str(tmp_path / "csv" / "part-*"))))
    lines = text.split("\n")
    assert lines[:6] == ["Firewall Security Report", "Generated:,2024-01-09T00:00:00", "Report Type:,WEEKLY",
                         "Period:,2024-01-02T00:00:00 to 2024-01-09T00:00:00", "", "SUMMARY"]
    assert lines.index("TOP SOURCE IPs") < lines.index("BRUTE FORCE ATTACKS") < lines.index("RECOMMENDATIONS")
    assert lines[lines.index("BRUTE FORCE ATTACKS") + 2].startswith("10.0.0.0,")
    with pytest.raises(ValueError):
        export.export_report(made, str(tmp_path / "x"), "pdf")
    whole = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert len(whole) == 1 and whole[0]["period"] == {"start": "2024-01-02T00:00:00", "end": "2024-01-09T00:00:00"}
    assert set(whole[0]["log_statistics"]["severity_distribution"]) <= {"CRITICAL", "HIGH", "MEDIUM", "LOW"}
    assert whole[0]["threat_detections"]["brute_force_attacks"][0]["source_ip"] == "10.0.0.0"
    sections = {r.section for r in spark.read.text(str(tmp_path / "json_sections")).select("section").distinct().collect()}
    assert {"report", "brute_force_attacks", "recommendations"} <= sections
    assert made.malicious_ips.first().unknown_ips == 1


def test_csv_quoting(spark):
    frame = spark.createDataFrame([(["a,b", 'say "x"', "plain", ""],)], "cells array<string>")
    assert frame.select(export.csv_line(F.col("cells"))).first()[0] == '"a,b","say ""x""",plain,'


def test_quiet_report(spark, small):
    nothing = read_logs(spark, small).where("false")
    made = report.daily_report(nothing, spark.createDataFrame([], REPUTATION_SCHEMA), as_of=datetime(2024, 1, 2, 5))
    assert [r.text[:11] for r in made.recommendations.collect()] == ["No critical"]
    assert (made.start, made.end) == times.day_bounds(datetime(2024, 1, 2))
    row = made.summary.first()
    assert (row.total_logs, row.security_score, row.total_threats) == (0, 100, 0)
    assert made.malicious_ips.first().total_ips_checked == 0


def test_dashboard(spark, small):
    logs = read_logs(spark, small)
    made = dashboard.dashboard(logs, datetime(2024, 1, 20, 0, 30))
    busy = dashboard.dashboard(logs, datetime(2024, 1, 20, 0, 30), DetectorSettings(
        brute_force={"threshold": 2}, floods={"single_ip_threshold": 2}, port_scan={"unique_ports_threshold": 2}))
    assert {r.type for r in busy.alerts.collect()} <= {"BRUTE_FORCE", "DDOS", "PORT_SCAN"}
    assert busy.threats.first().total_threats == 3
    assert made.health.first().total_logs_24h > 0 and 0 <= made.score.first().score <= 100
    # No row in the seven days before: the whole log is used.
    late = dashboard.top_ips(logs, datetime(2024, 6, 1)).first()
    assert late.total_logs == 1000 and late.last_seen == logs.agg(F.max("timestamp")).first()[0]


def test_export_rows_and_maps(spark, small, tmp_path):
    logs = read_logs(spark, small)
    top = stats.severity_map(stats.top_ips(logs, 1))
    assert set(top.first().severity_breakdown) == {"HIGH", "MEDIUM", "LOW"}
    export_rows(top, str(tmp_path / "csv"), "csv")
    export_rows(logs.limit(3), str(tmp_path / "json"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().source_ip == "10.0.0.0"
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    with pytest.raises(ValueError):
        export_rows(top, str(tmp_path / "x"), "xml")


def test_scratch_leaves_nothing_behind(spark, small):
    from pathlib import Path

    from palisade.operators import port_scan
    from palisade.session import scratch, shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:")) / "palisade"
    before = set(folder.iterdir()) if folder.exists() else set()
    with scratch(spark):
        port_scan.port_scan_windows(read_logs(spark, small), start=datetime(2000, 1, 1), end=datetime(2100, 1, 1)).count()
        assert set(folder.iterdir()) > before
    assert set(folder.iterdir()) == before


def test_a_report_reads_its_log_once(spark):
    """Every row of the period passes once, whatever reads it: detectors, counts and top lists."""
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=i), f"10.0.0.{i % 2}", 8000 + i % 15, "TCP", "auth.log", "SSH_FAILED_LOGIN", "HIGH",
             f"user{i % 3}", "x") for i in range(200)]
    logs = spark.createDataFrame(
        rows, "log_id long, timestamp timestamp_ntz, source_ip string, destination_port int, protocol string, "
              "log_source string, event_type string, severity string, username string, raw_log string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    nobody = spark.createDataFrame([], REPUTATION_SCHEMA)
    made = report.custom_report(logs.mapInArrow(counted, logs.schema), nobody, start, start + timedelta(days=1))
    document = json.loads(export.json_document(made).first()["json"])
    assert document["summary"]["total_logs"] == 200
    assert {x["source_ip"] for x in document["threat_detections"]["port_scan_attacks"]} == {"10.0.0.0", "10.0.0.1"}
    assert read.value == 200
