"""Parameter bounds of the detectors."""

from __future__ import annotations


def bounded(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, not {value}")
    return value


# Fixed values: (lowest, highest) accepted value of each parameter.
BOUNDS = {
    "window_minutes": (1, 1440),
    "threshold": (1, 1000),
    "unique_ports_threshold": (2, 65535),
    "min_total_attempts": (1, 1_000_000),
    "window_seconds": (1, 3600),
    "single_ip_threshold": (1, 100_000),
    "distributed_ip_count": (2, 1000),
    "distributed_request_threshold": (1, 1_000_000),
}


def check(**values: int) -> None:
    for name, value in values.items():
        bounded(name, value, *BOUNDS[name])
