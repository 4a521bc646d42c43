"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1) and
BENCH_QUERIES (comma-separated names) can be set. Each query is built and fully computed into
a sink that discards rows; the reported time is the median of the runs, building included.
"""

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from depthlog.operators import learning  # noqa: E402
from depthlog.plans import catalog, fixture, learning_queries  # noqa: E402
from depthlog.schema import feature_names  # noqa: E402

HEADLINE = [
    "well_table", "clean_curves", "rolling_features", "feature_table", "training_feature_table", "forward_gradient",
    "class_report", "overall_metrics", "well_metrics", "error_pairs", "pairwise_kappa", "consensus", "reliability",
    "rolling_accuracy", "boundary_accuracy", "disagreement_intervals", "label_runs", "value_runs", "bed_thickness",
    "transitions", "gap_rows", "curve_summary", "describe_curves", "missingness_summary", "lithology_mix",
    "depth_composition", "spearman", "split_attach", "impute_medians", "grid_cells", "threshold_sweep", "las_scan",
]


def time_training(spark, sf_dir: str) -> dict:
    """Seconds of the feature table with medians, of one fit of the forest and of scoring all rows outside TRAIN."""
    marks = [time.perf_counter()]
    df = learning_queries.training_input(spark, sf_dir)
    marks.append(time.perf_counter())
    model = learning_queries.fitted(spark, sf_dir, df)
    marks.append(time.perf_counter())
    scored = learning.predict(learning_queries.unseen(df), {"forest": model}, feature_names())
    scored.write.format("noop").mode("overwrite").save()
    marks.append(time.perf_counter())
    seconds = dict(zip(("input", "fit", "score"), (round(b - a, 3) for a, b in zip(marks, marks[1:]))))
    return seconds | {"fit_rows": learning_queries.train_rows(df).count(), "scored_rows": learning_queries.unseen(df).count()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("depthlog-bench")
             .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="depthlog-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the JVM
    took = {}
    start = time.perf_counter()
    fixture.wells_by_depth(spark, sf_dir)  # sorts and writes the well table, in both orders
    took["prepare_well_table"] = round(time.perf_counter() - start, 3)
    for name in names:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times), 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)
    training = {} if os.environ.get("BENCH_QUERIES") else time_training(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "rows": rows,
                      "training": training, "cpus": int(cpus), "driver_memory": "16g",
                      "rows_per_sec": {n: round(rows / t) for n, t in took.items() if t}}))


if __name__ == "__main__":
    main()
