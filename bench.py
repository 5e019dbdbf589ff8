"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3). Each
query runs once to warm up; the median of the timed runs counts. Results go to the noop sink, so
every row is produced and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from tests.session import make_session  # noqa: E402

HEADLINE = (
    "a05_dedup_events", "a05_dedup_hot_keys", "a07_latest_per_asset", "a10_normalize_winevent",
    "a14_normalize_redfish", "a17_collector_state", "a22_csb_fields", "b01_upsert", "c01_document_line_clusters",
    "c04_cluster_totals", "c05_top_clusters", "c11_anomalies_ranked", "c12_log_insight", "c13_analytics_overview",
    "d03_policy_dry_run", "d05_policy_audit_diff", "e02_correlations", "e05_dependency_edges", "e07_incident_briefs",
    "e09_recommendations", "f03_source_mix", "f05_daily_trend", "f08_asset_table", "g01_evaluate_access",
    "g05_reject_telemetry", "k02_touched",
)


def run_once(spark, name: str, sf_dir: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    os.environ.setdefault("SHUFFLE_PARTITIONS", cpus)
    spark = make_session(cpus)
    times = {}
    for name in HEADLINE:
        run_once(spark, name, sf_dir)
        times[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
