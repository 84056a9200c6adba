"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

HEADLINE = [
    "flagship_failure_rates", "a02_dataset_summary", "a10_aggregate_window", "j02_last_resume", "j05_select_history",
    "j07_nearest", "j09_duplicate_runs", "j12_prior_baseline", "j13_match_events", "w04_segment_ids", "w13_smooth",
    "w17_insights", "w18_context_validity", "w20_alert_episodes", "w28_thin", "e02_auroc", "e04_weighted_ece",
    "e10_alert_metrics", "e12_paired_intervals", "m14_score_members", "p11_frame_vector", "p19_lane_stacks",
    "p30_clear_events", "snk02_upsert_predictions", "st03_live_status",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from foretide.plans.catalogue import QUERIES

    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()  # warm the JVM
    took: dict[str, float] = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begin, 3)
    # The reference's only published figure: one window (32 frames x 27 features, so 135 aggregates)
    # scored by five members at seven horizons in under 500 ms.
    import numpy as np

    from foretide.streaming.live import LiveModel

    rng = np.random.default_rng(1)
    model, frames = LiveModel(rng.normal(0, 0.1, (5, 7, 135)), rng.normal(0, 1, (5, 7))), rng.random((32, 27))
    samples = []
    for _ in range(30):
        begin = time.perf_counter()
        model.remaining(np.median(model.members(frames), axis=0))
        samples.append((time.perf_counter() - begin) * 1000)
    total = round(sum(took.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "live_score_p95_ms": round(float(np.quantile(samples, 0.95)), 3),
            }
        )
    )
    spark.stop()


main()
