"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import queries  # noqa: E402
from palisade import build_session  # noqa: E402

HEADLINE = (
    "brute_force", "port_scan", "single_ip_flood", "distributed_flood", "top_ips", "top_ports", "stats_bundle",
    "log_search", "log_page", "parse_routed", "parse_unhinted", "logs_enriched", "threat_summary", "report_sections",
    "retention_keep",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "palisade-bench", spark_sql_shuffle_partitions=cpus, spark_driver_memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds = queries(), {}
    # Start-up of the session is not part of any query.
    known["total_logs"](spark, folder).collect()
    for name in HEADLINE:
        began = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
