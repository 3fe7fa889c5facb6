"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_REPEAT the timed
runs per query (the median counts). Results are written to the ``noop`` sink, which
computes every row and column and stores none. Fitted models are not shared between
runs: every run starts from the tables, but churn_importance takes the 300 trees that
churn_scores fitted before it.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from subscope.plans import registry
from subscope.session import session

HEADLINE = [
    "q1_monthly_revenue", "q2_value_tiers", "q3_top_customers_per_city", "q4_tariff_changes",
    "q5_cohort_retention", "q6_churn_by_segment", "q7_days_to_next",
    "rfm_scores", "rfm_merged", "kpi_overview", "describe_numeric", "corr_matrix", "box_monetary_by_churn",
    "drift_report", "ab_arpu_test", "star_fact", "constraint_report", "gen_transactions",
    "ratings", "rec_similar", "rec_hybrid_coldstart", "rec_hybrid", "segments_kmeans", "silhouette", "dbscan_summary",
    "binary_metrics", "churn_scores", "churn_importance", "latency_buckets", "stream_request_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    wanted = sys.argv[1:] or HEADLINE
    spark = session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()

    def run(name: str, fitted: bool = False) -> float:
        if not fitted:
            registry.forget_models()
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("q1_monthly_revenue")  # start the JVM's compilers and the Python workers
    run("ab_conversion_test")
    slow = {"segments_kmeans", "dbscan_summary", "rec_hybrid"}
    #: one fit serves both, and is reported by itself
    scorings = {"churn_scores", "churn_importance"}
    times = {}
    for name in wanted:
        if name in scorings:
            whole = 0.0 if "churn_fit" in times else run(name)
            times[name] = round(run(name, fitted=True), 3)
            if whole:
                times["churn_fit"] = round(whole - times[name], 3)
        else:
            times[name] = round(statistics.median(run(name) for _ in range(1 if name in slow else repeat)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
