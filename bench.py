"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the test tables (default sf0.1) and BENCH_CPUS the local
threads. Each query is run BENCH_RUNS times after one warm-up of the session and
the best time counts; results are fetched in full.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from touchtally.plans.catalog import QUERIES

HEADLINE = (
    "J4_journeys", "J8_T2_path_summary", "R0_touch_weights", "R7_credit_table", "D3_markov", "D5_shapley",
    "V4_roi_table", "V5_reallocation_plan", "V7_attribution_matrix", "V8_T3_recovery_scores",
    "M1_mart_user_journeys", "M2_mart_channel_roi", "M3_mart_experiment_metrics", "X5_X9_srm_check",
    "X8_reproducibility", "X13_X15_cuped", "X19_X20_interim_looks", "X21_aa_audit", "X24_X27_guardrails",
    "X28_X29_readout", "P1_P6_design_table",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("touchtally-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="touchtally-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["S1_raw_scans"](spark, sf_dir).collect()
    times = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).collect()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
