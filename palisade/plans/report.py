"""The security report: statistics, detections, score, sources and advice of a period."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.times import day_bounds, midnight, week_bounds
from palisade.operators import stats
from palisade.plans import threats
from palisade.plans.threats import Detections, DetectorSettings
from palisade.session import settle, together

# Ports worth a warning among the busiest ones.
WARNED_PORTS = (22, 23, 1433, 3306, 3389)
ADVICE_IPS = 5


@dataclass(frozen=True)
class Report:
    """A report as frames: large parts stay distributed, small ones are single rows."""

    kind: str
    start: datetime
    end: datetime
    generated: datetime
    summary: DataFrame
    severities: DataFrame
    event_types: DataFrame
    protocols: DataFrame
    top_ips: DataFrame
    top_ports: DataFrame
    time_breakdown: DataFrame
    detections: Detections
    top_sources: DataFrame
    malicious_ips: DataFrame
    recommendations: DataFrame


def security_report(
    logs: DataFrame,
    reputation: DataFrame,
    start: datetime,
    end: datetime,
    kind: str = "CUSTOM",
    generated: datetime | None = None,
    settings: DetectorSettings = DetectorSettings(),
) -> Report:
    """All parts of a report over one period."""
    scope = threats.period(logs, start, end)
    found = threats.detect_in(scope, start, end, settings)
    summary, top, profile, ports = together(
        lambda: settle(threats.threat_summary(found), "threat-summary"),
        lambda: settle(threats.top_threat_sources(found), "threat-sources"),
        lambda: settle(stats.profile(scope, start, end, kind), "profile"),
        lambda: settle(stats.top_ports(scope), "top-ports"))
    severities = stats.profile_counts(profile, "severity")
    malicious = settle(threats.malicious_ip_analysis(top, reputation), "malicious-ips")
    return Report(
        kind, start, end, generated or end,
        summary=report_summary(profile, summary),
        severities=severities,
        event_types=stats.profile_counts(profile, "event_type"),
        protocols=stats.profile_counts(profile, "protocol"),
        top_ips=stats.top_ips(scope),
        top_ports=ports,
        time_breakdown=stats.profile_times(profile),
        detections=found,
        top_sources=top,
        malicious_ips=malicious,
        recommendations=recommendations(summary, severities, ports, malicious),
    )


def daily_report(logs: DataFrame, reputation: DataFrame, day: datetime | None = None, *,
                 as_of: datetime, **more) -> Report:
    start, end = day_bounds(day if day is not None else midnight(as_of))
    return security_report(logs, reputation, start, end, "DAILY", as_of, **more)


def weekly_report(logs: DataFrame, reputation: DataFrame, start: datetime | None = None, *,
                  as_of: datetime, **more) -> Report:
    """A week so far: it ends at ``as_of``, whatever its start."""
    begin, end = week_bounds(start, as_of)
    return security_report(logs, reputation, begin, end, "WEEKLY", as_of, **more)


def custom_report(logs: DataFrame, reputation: DataFrame, start: datetime, end: datetime, *,
                  as_of: datetime | None = None, **more) -> Report:
    if start >= end:
        raise ValueError("start must be before end")
    return security_report(logs, reputation, start, end, "CUSTOM", as_of, **more)


def report_summary(profile: DataFrame, summary: DataFrame) -> DataFrame:
    """Total rows, score, status and threat counts as one row."""
    total = profile.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_logs"))
    one = F.lit(1).alias("one")
    scored = threats.security_score(summary).select(one, "*")
    return (
        total.select(one, "*").join(scored, "one").join(summary.select(one, "*"), "one").drop("one")
    )


def recommendations(
    summary: DataFrame,
    severities: DataFrame,
    top_ports: DataFrame,
    malicious: DataFrame,
) -> DataFrame:
    """Advice as rows (rule_no, place, text); a default line when no rule applies.

    All inputs are single rows or short lists, so the result has a few rows.
    """
    def rule(number: int, frame: DataFrame, condition, text, place=F.lit(0)) -> DataFrame:
        return frame.where(condition).select(
            F.lit(number).alias("rule_no"), place.cast("bigint").alias("place"), text.alias("text"))

    c = F.col
    high = severities.where(c("severity") == "HIGH")
    first_ips = F.array_join(F.transform(F.slice("malicious_ip_list", 1, ADVICE_IPS), lambda x: x["ip"]), ", ")
    # The texts of the advice.
    rules = [
        rule(1, summary, c("critical_threats") > 0, F.format_string(
            "CRITICAL: %d critical threat(s) detected. "
            "Immediate action required - consider blocking source IPs and reviewing firewall rules.",
            "critical_threats")),
        rule(2, summary, c("total_brute_force_attacks") > 10, F.format_string(
            "High number of brute force attacks detected (%d). "
            "Consider implementing IP-based rate limiting and fail2ban.", "total_brute_force_attacks")),
        rule(3, summary, c("total_ddos_attacks") > 0, F.format_string(
            "DDoS attacks detected (%d). "
            "Consider implementing DDoS protection services and rate limiting at the firewall level.",
            "total_ddos_attacks")),
        rule(4, high, c("count") > 1000, F.format_string(
            "High volume of HIGH severity logs (%d). "
            "Review and optimize firewall rules to reduce false positives.", "count")),
        rule(5, top_ports, c("port").isin(*WARNED_PORTS), F.format_string(
            "High traffic on port %d detected. "
            "Ensure this port is properly secured and access is restricted.", "port"), place=-c("count")),
        rule(6, malicious, c("malicious_ips") > 0, F.concat(F.format_string(
            "CRITICAL: %d known malicious IP(s) detected in threat sources. "
            "Immediately block these IPs in your firewall: ", "malicious_ips"), first_ips)),
        rule(7, malicious, c("suspicious_ips") > 0, F.format_string(
            "Warning: %d suspicious IP(s) detected. "
            "Monitor these IPs closely and consider implementing additional security measures.", "suspicious_ips")),
        rule(99, summary, F.lit(True), F.lit(
            "No critical issues detected. Continue monitoring and maintain current security posture.")),
    ]
    every = rules[0]
    for more in rules[1:]:
        every = every.unionByName(more)
    first = F.min("rule_no").over(Window.partitionBy())
    return every.withColumn("first", first).where((c("rule_no") < 99) | (c("first") == 99)).drop("first")


def ordered_advice(advice: DataFrame) -> DataFrame:
    return advice.orderBy("rule_no", "place", "text")
