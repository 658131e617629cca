"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query is
built, planned and run to a sink that takes every row.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from riskloom.plans import catalog  # noqa: E402
from riskloom.session import build_session  # noqa: E402

HEADLINE = [
    "load_change_log",
    "dedupe_change_file",
    "windowed_labels",
    "process_features",
    "process_features_pairs",
    "process_snapshot",
    "source_as_of",
    "match_modules_to_history",
    "cap_positive_rate",
    "impute_group_median",
    "monthly_activity",
    "pearson_pairs",
    "mutual_information",
    "stratified_kfold",
    "auc_roc",
    "threshold_sweep",
    "pr_points",
    "global_importance",
    "ast_nodes",
    "train_boosted_trees",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = catalog.queries()
    # Start-up cost (JVM, first code generation) belongs to no query.
    runs["label_stats"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        runs[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(folder)),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
