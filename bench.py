"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from motiontables.plans.registry import full_catalog  # noqa: E402

HEADLINE = (
    "review_ranges", "view_summary", "align_two_views", "select_observations", "fill_timeline", "fill_rotation",
    "quaternion_signs", "acceleration", "hopping_windows", "numeric_gate", "robust_scale", "residual_stats",
    "vector_median", "threshold_sweep", "debounce_states", "identity_tracks", "interval_overlap_pairs",
    "interval_union_length", "interior_share", "contract_violations", "reconcile", "exact_copies", "top4_renormalised",
    "kinematics_chain", "periodogram_peak", "near_duplicate_pairs", "job_latest", "mesh_audit", "lsq_translation",
)


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("motiontables-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.driver.host", "127.0.0.1").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = full_catalog().queries
    spark.read.parquet(f"{base}/lineitem.parquet").count()  # JVM and file-system warm-up
    seconds = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, base).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(base.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
