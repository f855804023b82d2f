"""Time the headline queries: one JSON line. BENCH_SF_DIR picks the data, BENCH_CPUS the cores."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "search_topk", "search_versions", "text_search", "coverage_summary", "coverage_sweep", "agree_bundle",
    "qc_summary", "qc_distribution", "qc_issue_fields", "first_turns", "scan_stats", "json_paths", "dense_ids",
)


def main() -> None:
    from traincover import build_session
    from traincover.plans.on_tables import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").collect()  # session start is not part of any query
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1].strip("/"),
    }))


if __name__ == "__main__":
    main()
