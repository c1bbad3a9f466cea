"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
Every query is run to its last row once to warm up and once timed.
"""

from __future__ import annotations

import json
import os
import re
import time

from checks.queries import QUERIES
from tidelog.session import get_session

HEADLINE = [
    "parse_clf", "parse_json", "parse_csv", "parse_mixed", "detect_format", "read_lines", "filter_combined", "search_regex",
    "kpis", "latency_percentiles", "golden_signals", "status_distribution", "top_endpoints", "requests_over_time",
    "latency_histogram", "traffic_heatmap", "endpoint_baselines", "detect_anomalies", "cluster_logs", "windowed_signals",
]


def run(spark, name: str, sf: str) -> float:
    start = time.time()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "tidelog-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    timings = {}
    for name in HEADLINE:
        run(spark, name, sf)
        timings[name] = run(spark, name, sf)
    scale = re.search(r"sf([0-9.]+)", sf)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
