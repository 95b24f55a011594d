"""All detectors together, and what reports derive from their detections.

Detections are few compared with log rows. ``detect_all`` writes them once, so that the
many summaries built on them do not run the detectors again. Before that it writes the columns
of the period that are read, since the detectors together read them many times: what has to be
done for a log row, to decode or derive it, is done once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.severity import of_rank, rank
from palisade.operators import brute_force, floods, port_scan
from palisade.operators.filters import in_range
from palisade.operators.reputation import classify, lookup
from palisade.session import settle, together

# What detectors and reports read of a log.
COLUMNS = ("timestamp", "source_ip", "destination_port", "protocol", "event_type", "severity", "username")
TOP_SOURCES = 20
ALERTS_PER_DETECTOR = 5
ALERTS = 10
ALERT_SEVERITIES = ("CRITICAL", "HIGH")


@dataclass(frozen=True)
class DetectorSettings:
    """Parameters of the three detectors; the defaults are those of the reports."""

    brute_force: dict = field(default_factory=dict)
    port_scan: dict = field(default_factory=dict)
    floods: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Detections:
    brute_force: DataFrame
    floods: DataFrame
    port_scans: DataFrame


def period(logs: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """The rows of a period with what detectors and reports read of them, written once."""
    return settle(in_range(logs, start, end).select(*[c for c in logs.columns if c in COLUMNS]), "period")


def detect_all(
    logs: DataFrame,
    start: datetime,
    end: datetime,
    settings: DetectorSettings = DetectorSettings(),
) -> Detections:
    """Run the detectors over a period of a log, which is read once."""
    return detect_in(period(logs, start, end), start, end, settings)


def detect_in(rows: DataFrame, start: datetime, end: datetime, settings: DetectorSettings = DetectorSettings()) -> Detections:
    """Run the detectors over what ``period`` wrote."""
    scope = {"start": start, "end": end}
    return Detections(*together(
        lambda: settle(brute_force.detect_brute_force(rows, **settings.brute_force, **scope), "brute-force"),
        lambda: settle(floods.detect_floods(rows, **settings.floods, **scope), "floods"),
        lambda: settle(port_scan.detect_port_scan(rows, **settings.port_scan, **scope), "port-scans"),
    ))


def _listed(found: Detections) -> DataFrame:
    """Detector and severity of every detection."""
    of = lambda frame, name: frame.select(F.lit(name).alias("detector"), "severity")
    return (of(found.brute_force, "brute_force").unionByName(of(found.floods, "ddos"))
            .unionByName(of(found.port_scans, "port_scan")))


def threat_summary(found: Detections) -> DataFrame:
    """Detections per detector and per severity, as one row."""
    severity, detector = F.col("severity"), F.col("detector")
    return _listed(found).agg(
        F.count_if(detector == "brute_force").alias("total_brute_force_attacks"),
        F.count_if(detector == "ddos").alias("total_ddos_attacks"),
        F.count_if(detector == "port_scan").alias("total_port_scan_attacks"),
        F.count("*").alias("total_threats"),
        F.count_if(severity == "CRITICAL").alias("critical_threats"),
        F.count_if(severity == "HIGH").alias("high_threats"),
        F.count_if(severity == "MEDIUM").alias("medium_threats"),
        F.count_if(~F.coalesce(severity.isin("CRITICAL", "HIGH", "MEDIUM"), F.lit(False))).alias("low_threats"),
    )


def threat_levels(found: Detections) -> DataFrame:
    """Detections per detector and severity, with totals per detector and overall (null keys)."""
    return _listed(found).rollup("detector", "severity").agg(F.count("*").alias("detections"))


def active_threats(summary: DataFrame) -> DataFrame:
    """Critical and high detections together."""
    return summary.select((F.col("critical_threats") + F.col("high_threats")).alias("active_threats"))


def security_score(summary: DataFrame) -> DataFrame:
    """Score 0 to 100 and status, from the threat summary row.

    Every severity takes points off, each up to its own limit.
    """
    # Points per threat, and the most a severity can take.
    points = {"critical": (20, 80), "high": (10, 60), "medium": (5, 40), "low": (1, 20)}
    lost = sum((F.least(F.col(f"{s}_threats") * p, F.lit(limit)) for s, (p, limit) in points.items()), F.lit(0))
    scored = summary.select(F.greatest(F.lit(100) - lost, F.lit(0)).alias("security_score"))
    score = F.col("security_score")
    return scored.withColumn(
        "security_status",
        F.when(score >= 80, "SECURE").when(score >= 60, "MODERATE").when(score >= 40, "WARNING").otherwise("CRITICAL"))


def dashboard_score(critical: Column, high: Column, total_logs: Column, high_logs: Column) -> Column:
    """The dashboard's own score: the mean of a threat score and a log score, half rounded up."""
    threats = F.greatest(F.lit(0), 100 - (critical * 20 + high * 10))
    logs = F.greatest(F.lit(0.0), 100 - (high_logs / total_logs) * 50)
    return F.when(total_logs == 0, 100).otherwise(F.floor((threats + logs) / 2 + 0.5)).cast("bigint")


def threat_sources(found: Detections) -> DataFrame:
    """What each source took part in. A flood counts in full for every source it lists; a
    scan adds attempts only."""
    def part(frame: DataFrame, ip: Column, brute: int, ddos: int, attempts: str) -> DataFrame:
        return frame.select(
            ip.alias("ip"), F.lit(brute).alias("b"), F.lit(ddos).alias("d"),
            F.col(attempts).alias("a"), rank("severity").alias("r"))

    parts = (
        part(found.brute_force, F.col("source_ip"), 1, 0, "total_attempts")
        .unionByName(part(found.floods, F.explode("source_ips"), 0, 1, "total_requests"))
        .unionByName(part(found.port_scans, F.col("source_ip"), 0, 0, "total_attempts"))
    )
    return parts.groupBy("ip").agg(
        F.sum("b").alias("brute_force_attacks"),
        F.sum("d").alias("ddos_attacks"),
        F.sum("a").alias("total_attempts"),
        of_rank(F.greatest(F.max("r"), F.lit(1))).alias("severity"),
    )


def top_threat_sources(found: Detections, limit: int = TOP_SOURCES) -> DataFrame:
    """The sources with most attempts."""
    return threat_sources(found).orderBy(F.desc("total_attempts"), "ip").limit(limit)


def source_reputations(top: DataFrame, reputation: DataFrame) -> DataFrame:
    """Reputation and class of the top sources."""
    ranked = top.select("ip", "total_attempts")
    return ranked.join(classify(lookup(top.select("ip"), reputation)), "ip")


def malicious_ip_analysis(top: DataFrame, reputation: DataFrame) -> DataFrame:
    """Sources per class as one row, with the malicious ones listed (at most the top twenty)."""
    found = source_reputations(top, reputation)
    of = lambda kind: F.count_if(F.col("class") == kind).alias(f"{kind}_ips")
    entry = F.struct((-F.col("total_attempts")).alias("order"), "ip", "threat_level", "reputation_score",
                     "malicious_count", "country", "categories")
    listed = F.array_sort(F.collect_list(F.when(F.col("class") == "malicious", entry)))
    return found.agg(
        F.count("*").alias("total_ips_checked"), of("malicious"), of("suspicious"), of("clean"), of("unknown"),
        F.transform(listed, lambda x: x.dropFields("order")).alias("malicious_ip_list"))


def active_alerts(found: Detections) -> DataFrame:
    """The alert list: five detections of each detector in its own order, of these the
    critical and high ones, the ten most severe and newest of all."""
    columns = ("type", "source_ip", "severity", "detected_at", "description", "threat_count")

    def alerts(ordered: DataFrame, kind: str, ip: Column, at: str, text: Column, count: str) -> DataFrame:
        first = ordered.limit(ALERTS_PER_DETECTOR)
        return first.where(F.col("severity").isin(*ALERT_SEVERITIES)).select(
            F.lit(kind).alias("type"), ip.alias("source_ip"), "severity", F.col(at).alias("detected_at"),
            text.alias("description"), F.col(count).alias("threat_count"))

    # The texts of the alerts.
    brute_text = F.format_string("Brute force attack: %d failed login attempts", "total_attempts")
    flood_text = F.when(
        F.col("attack_type") == "DISTRIBUTED_FLOOD",
        F.format_string("Distributed DDoS: %d IPs, %d requests", "source_ip_count", "total_requests"),
    ).otherwise(F.format_string("Single IP flood: %d requests", "total_requests"))
    scan_text = F.format_string("Port scan detected: %d unique ports attempted", "unique_ports_attempted")
    first_source = F.coalesce(F.get("source_ips", F.lit(0)), F.lit("Multiple IPs"))
    every = (
        alerts(brute_force.ordered(found.brute_force), "BRUTE_FORCE", F.col("source_ip"), "last_attempt",
               brute_text, "total_attempts")
        .unionByName(alerts(floods.ordered(found.floods), "DDOS", first_source, "last_request",
                            flood_text, "total_requests"))
        .unionByName(alerts(port_scan.ordered(found.port_scans), "PORT_SCAN", F.col("source_ip"), "last_attempt",
                            scan_text, "total_attempts"))
    )
    return every.select(*columns).orderBy(
        F.desc(rank("severity")), F.desc("detected_at"), "type", "source_ip", "description").limit(ALERTS)


