"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed completely with the ``noop`` sink (all rows are
produced, none are collected), after one warm-up run of the flagship so
JVM start-up and code generation warm-up are not charged to a query.
Non-model queries report the median of three runs; model queries run once
(a repeat would reuse the session's fitted model and hide the fit).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigilo.plans.ml_queries import QUERIES as ML_QUERIES  # noqa: E402
from vigilo.plans.registry import QUERIES  # noqa: E402
from vigilo.session import build_session  # noqa: E402

REPEATS = 3
HEADLINE = [
    "sensor_anomalies",      # flagship stream rules, batch form
    "user_anomalies",
    "dead_letters",
    "all_predictions",
    "stream_sensor",         # the same rules as a Structured Streaming run
    "food_clean",
    "food_profile",
    "food_features",
    "portion_nutrients",
    "prediction_stats",
    "encode_alpha",
    "stratified_split",
    "standardize",
    "metric_sum_by",
    "metric_rate",
    "topic_totals",
    "latest_file_rows",
    "kmeans_scaled",         # k-means fit + assign (M8)
    "rf_predictions",        # 50-tree forest fit + predict (M5)
]


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", app="vigilo-bench",
                          shuffle_partitions=max(8, 2 * int(cpus)))
    run(spark, "sensor_anomalies", sf_dir)  # warm-up
    times = {}
    for name in names:
        runs = 1 if name in ML_QUERIES else REPEATS
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    events = spark.read.parquet(os.path.join(sf_dir, "events.parquet")).count()
    items = spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet")).count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "rows_per_sec": {
            "sensor_anomalies": round(events / times["sensor_anomalies"], 1)
            if "sensor_anomalies" in times else None,
            "food_features": round(items / times["food_features"], 1)
            if "food_features" in times else None,
        },
        "cpus": int(cpus),
        "runs": f"median of {REPEATS} (model queries: 1)",
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
