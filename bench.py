"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  test data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    runs per query (default 2); the reported time is the fastest
Every run executes the whole plan and discards the rows.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from spendlake.plans.registry import QUERIES
from spendlake.session import build_session

HEADLINE = (
    "spend_by_fy_agency_top20", "total_spend_filtered", "latest_contract_versions", "contract_version_flags",
    "search_contracts", "find_companies", "batch_spend_lookup", "entity_semi_join_spend",
    "answer_spend_questions", "uncovered_months", "window_range_join", "dedupe_composite", "ocds_notices",
    "csv_header_mapping", "portal_vic_notices", "lake_roundtrip_pruned", "stream_latest_version",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        timings[name] = round(best, 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
