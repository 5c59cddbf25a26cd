"""Headline queries, timed to completion with a no-op sink; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from eventloom.plans import load
from eventloom.session import build_session

HEADLINE = [
    "interval_merge_events",
    "storm_clusters",
    "point_in_first_interval",
    "series_gap_fill",
    "wet_spell_events",
    "interval_overlap_features",
    "series_window_features",
    "temporal_conflict",
    "clean_requests",
    "dimension_chain",
    "numeric_summary",
    "rank_bins",
    "class_metrics",
    "bias_by_group",
    "leakage_audit",
    "nearest_point",
    "within_distance_counts",
    "components",
    "bfs_labels",
    "cpt",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false", "spark.sql.codegen.cache.maxEntries": "2000",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = load(), {}
    queries["projected_scan"].build(spark, sf_dir).count()  # start-up cost stays out of the numbers
    for name in HEADLINE:
        t = time.perf_counter()
        queries[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    sf = float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
