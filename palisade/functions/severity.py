"""Severity ranks, and the rules that turn detection figures into a severity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from lowest to highest.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

# A detection takes the first level of which it reaches any bound.
BRUTE_FORCE_BOUNDS = {
    "CRITICAL": {"total_attempts": 50, "window_count": 5},
    "HIGH": {"total_attempts": 20, "window_count": 3},
    "MEDIUM": {"total_attempts": 10},
}
PORT_SCAN_BOUNDS = {
    "CRITICAL": {"unique_ports_attempted": 50, "window_count": 6, "total_attempts": 500},
    "HIGH": {"unique_ports_attempted": 25, "window_count": 4, "total_attempts": 200},
    "MEDIUM": {"unique_ports_attempted": 10, "window_count": 2, "total_attempts": 50},
}
SINGLE_FLOOD_BOUNDS = {
    "CRITICAL": {"peak_request_rate": 1000, "window_count": 10},
    "HIGH": {"peak_request_rate": 500, "window_count": 5},
    "MEDIUM": {"peak_request_rate": 200, "window_count": 3},
}
DISTRIBUTED_FLOOD_BOUNDS = {
    "CRITICAL": {"peak_request_rate": 2000, "source_ip_count": 50, "window_count": 10},
    "HIGH": {"peak_request_rate": 1000, "source_ip_count": 25, "window_count": 5},
    "MEDIUM": {"peak_request_rate": 500, "source_ip_count": 15, "window_count": 3},
}


def by_bounds(bounds: dict[str, dict[str, int]]) -> Column:
    """The severity of a row under one of the tables above; LOW when no bound is reached."""
    result = F.lit("LOW")
    for level in SEVERITIES:
        if level in bounds:
            reached = F.lit(False)
            for column, bound in bounds[level].items():
                reached = reached | (F.col(column) >= bound)
            result = F.when(reached, level).otherwise(result)
    return result


def rank(severity: Column | str) -> Column:
    """1 for LOW up to 4 for CRITICAL, 0 for anything else."""
    severity = F.col(severity) if isinstance(severity, str) else severity
    result = F.lit(0)
    for position, name in enumerate(SEVERITIES, start=1):
        result = F.when(severity == name, position).otherwise(result)
    return result


def of_rank(value: Column | str) -> Column:
    """The severity name for a rank."""
    return F.get(F.array(F.lit(None).cast("string"), *[F.lit(s) for s in SEVERITIES]), value)


def lift(severity: Column | str, threat_level: Column | str, detected: Column | str) -> Column:
    """Raise a severity to the threat level of a detected source; never lower it.

    Only the levels MEDIUM and above raise, and an unknown severity counts as LOW.
    """
    severity, threat_level, detected = (
        F.col(c) if isinstance(c, str) else c for c in (severity, threat_level, detected))
    raises = F.coalesce(detected, F.lit(False)) & (rank(threat_level) >= 2)
    return F.when(raises & (rank(threat_level) > F.greatest(rank(severity), F.lit(1))), threat_level).otherwise(severity)
