"""Headline timings: warm runs of the hot operators, one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans.catalog import CATALOG  # noqa: E402

HEADLINE = [
    "impute_and_log",
    "scaler_statistics",
    "index_maps",
    "apply_index_maps",
    "apply_large_index_maps",
    "normalise_like_train",
    "enrich_items",
    "exact_field_quantiles",
    "histogram",
    "drift_report",
    "batch_metrics",
    "auc_of_many_levels",
    "spline_basis",
    "curve_values",
    "fit_curves",
    "field_summary",
    "monotonicity",
    "envelope_round_trip",
    "upsert_results",
    "score_in_batches",
    "trained_model_metrics",
    "stream_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    folder = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark-bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.local.dir", folder)
        .config("spark.checkpoint.dir", f"{folder}/checkpoints")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        run = CATALOG[name].run

        def once(run=run) -> float:
            started = time.monotonic()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.monotonic() - started

        once()  # warm up: class loading and code generation
        seconds[name] = round(statistics.median(once() for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_s": {n: round(rows / s) for n, s in seconds.items() if s > 0},
                "lineitem_rows": rows,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
