"""Headline timings: one JSON line.

Each query runs once to warm the JVM (training excepted) and once timed, full result collected, on
``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR``.  The names mirror the published stages:
profile, descriptive workflow, training, scoring with drift.
"""

from __future__ import annotations

import json
import os
import time

from tabsight.catalog import load
from tabsight.catalog.registry import QUERIES
from tabsight.session import local_session

HEADLINE = [
    "overview", "column_profile", "value_frequency", "duplicate_rows", "numeric_summary",
    "correlations", "group_summary", "trend_year", "anomaly_rows", "multi_value", "unit_summary",
    "target_assoc_ranked", "workflow", "text_date_flags",
    "leak_auc", "leakage_report", "feat_frequency", "holdout_split", "stratified_sample",
    "metrics_ap_auc_lines", "entity_overlap", "drift_categorical", "drift_level",
    "model_cv", "score_rows",
]

# Training runs for most of a minute; its JVM is warm by then and one run is enough.
RUN_ONCE = {"model_cv", "score_rows"}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    load()
    spark = local_session(cpus, int(cpus))
    times = {}
    for name in names:
        for _ in range(1 if name in RUN_ONCE else 2):
            start = time.perf_counter()
            QUERIES[name](spark, sf).collect()
            times[name] = round(time.perf_counter() - start, 3)
            spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "total_warm_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
