"""Benchmark the headline queries.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] (default 8), executing the full plan into the ``noop``
sink (no driver collect), and prints ONE JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "customer_base", "features", "scored", "first_call_list", "threshold_sweep", "auc_exact",
    "average_precision", "split_membership", "batch_scores", "top_factors", "global_importance",
    "cohort_churn", "kpis", "call_list", "profile", "contract_violations", "stream_scored", "model_scores",
    "sampled_shapley", "leaderboard",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from retainspark.plans.registry import load_all
    from retainspark.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                          conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    queries, _ = load_all()
    # warm the JVM (class loading, codegen caches) on the smallest data set
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        queries["first_call_list"](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
