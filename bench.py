"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default ``/root/testdata/sf0.1``),
``BENCH_CPUS`` the local cores (default 8). Every query is run once to warm up
and timed on its second run, writing all rows to the no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from cellgauge.catalog import queries
from cellgauge.session import local_session

HEADLINE = (
    "m00_full_suite",        # all metrics, 3 methods x 5 folds x 3 levels, one pass
    "l00_leaderboard",       # metrics to ranked scores
    "m02_per_class",
    "n03_zscore",
    "n08_clip_quantile",
    "p20_drop_outlier_rows",
    "a08_expression_by_type",
    "a20_rank_markers_wilcoxon",
    "c13_signature_scores",
    "k01_stratified_kfold",
    "k02_stratified_group_kfold",
    "j10_radius_pairs",
    "j11_knn_points",
    "j11_knn_vectors",
    "c17_composition_radius",
    "a24_vectors_from_tiles",
)


def shuffled(spark) -> int:
    """Shuffle bytes written since the session started."""
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", **{"spark.sql.shuffle.partitions": str(cpus if cpus.isdigit() else 8)})
    registered, seconds, shuffle_mb = queries(), {}, {}
    for name in HEADLINE:
        for _ in range(2):
            start, written = time.perf_counter(), shuffled(spark)
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
            shuffle_mb[name] = round((shuffled(spark) - written) / 2**20, 2)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "shuffle_mb": shuffle_mb, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
