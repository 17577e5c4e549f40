"""Time the headline queries: one JSON line on stdout.

Two queries warm the session up; then each query is timed (median of BENCH_REPEATS runs, 1 by default),
writing its whole result to a sink that discards it. BENCH_QUERIES times others, comma-separated.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cohortlens.checks.all import QUERIES  # noqa: E402
from cohortlens.session import local_session, release  # noqa: E402

HEADLINE = [
    "gpa",
    "term_aggregate",
    "term_cumulative",
    "load_index",
    "major_change",
    "agg_map",
    "demographics",
    "student_master",
    "test_scores",
    "student_features",
    "chunk_t0",
    "chunk_sizes",
    "describe",
    "corr_pairs",
    "roc_auc",
    "accuracy_matrix",
    "ratings_clean",
    "min_support",
    "ratings_density",
    "user_similarity",
    "baseline_bias",
    "knn_predict",
    "topk_recs",
    "prediction_support",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, partitions=8 if cpus == "*" else max(int(cpus), 2))
    seconds: dict[str, float] = {}
    for name in (HEADLINE[0], "baseline_rmse"):
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
    for name in names:
        runs = []
        for _ in range(repeats):
            started = time.perf_counter()
            QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
            release(spark)
        seconds[name] = round(statistics.median(runs), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(root).name.removeprefix("sf"),
                "spark": spark.version,
                "cpus": cpus,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
