"""Seconds per query at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line on standard output.

Headline queries run once to warm up and then three times; the median counts. The others run once
to warm up and once for the clock, forests once. Results
go to a sink that computes every row and keeps none.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

import pyspark

from tonetape.plans.queries import QUERIES
from tonetape.session import local_session

HEADLINE = (
    "bin_end_summary",
    "bin_start_day_summary",
    "lookback_anchor_summary",
    "rolling_weighted_sentiment",
    "explode_companies",
    "ticker_semi_join",
    "top_domain_dummies",
    "domain_summary",
    "labelled_events",
    "panel_returns",
    "lag_delta_features",
    "chronological_split",
    "threshold_sweep",
    "model_threshold_curves",
)
# Fits take many small jobs: they are run after the others.
ONCE = (
    *("rf_predictions", "rf_report", "rf_importances", "rf_grid_search", "learner_facts", "learner_search", "fold_predictions"),
    *("event_return_chain", "sentiment_return_chain", "day_folders", "rolled_step_by_step"),
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    memory = os.environ.get("BENCH_MEMORY", "16g")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, memory=memory)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or list(QUERIES)
    seconds = {}
    for name in sorted(names, key=lambda n: n in ONCE):
        if name in ONCE:
            seconds[name] = run(spark, name, folder)
        else:
            run(spark, name, folder)
            seconds[name] = statistics.median(run(spark, name, folder) for _ in range(3 if name in HEADLINE else 1))
        print(f"{name:30s} {seconds[name]:.3f}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "sum of warm seconds over all queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {name: round(s, 3) for name, s in seconds.items()},
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cores": cores,
                "driver_memory": memory,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                "spark": pyspark.__version__,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
