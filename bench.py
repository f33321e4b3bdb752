"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  folder of the tables      (default /root/testdata/sf0.1)
BENCH_CPUS    local cores               (default 8)
BENCH_RUNS    runs per query, best kept (default 2)
BENCH_ALL     1 = every registered query
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.plans import catalogue  # noqa: E402

HEADLINE = (
    "column_profile_orders", "rules_customer", "pii_scan_documents", "suggest_rules", "win_numeric", "win_categorical", "dq_basic",
    "dq_histogram", "dq_quantiles", "dq_mi", "gap_fill", "derived_features", "rolling", "denormalise", "anomaly_score", "hist_numeric",
    "js_drift", "season_layer", "decompose", "ecod", "seq_score", "detect_periods", "group_summary", "explanations", "schema_changes",
    "lof", "stable_features", "importance_summary", "lineage_closure", "cblof", "mahalanobis", "quality_pipeline",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("plumbline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = catalogue.by_name()
    names = list(known) if os.environ.get("BENCH_ALL") == "1" else list(HEADLINE)
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(runs):
            t = time.perf_counter()
            known[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name} {best:.2f}", file=sys.stderr)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "plumbline_headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
