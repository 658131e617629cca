"""Run log and leaderboard."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.sources.committed import write_committed

RUN_SCHEMA = (
    "run_id string, experiment string, run_name string, kind string, name string, "
    "value double, text string, logged_at timestamp_ntz"
)
RUNS_PER_EXPERIMENT = 10


def run_rows(
    spark: SparkSession,
    run_id: str,
    experiment: str,
    run_name: str,
    params: Mapping[str, object],
    metrics: Mapping[str, float],
) -> DataFrame:
    """Parameters and metrics of one run in long form."""
    rows = [
        (run_id, experiment, run_name, "param", k, None, str(v)) for k, v in params.items()
    ] + [(run_id, experiment, run_name, "metric", k, float(v), None) for k, v in metrics.items()]
    schema = RUN_SCHEMA.rsplit(", ", 1)[0]
    return spark.createDataFrame(rows, schema).withColumn(
        "logged_at", F.current_timestamp().cast("timestamp_ntz")
    )


def log_run(rows: DataFrame, path: str) -> DataFrame:
    """Add runs to the run-log table and return the whole table.

    A run is one partition of a committed table: logging it again replaces it, and a
    run that fails while it is logged leaves the table as it was.
    """
    return write_committed(rows, path, "run_id")


def metrics_wide(log: DataFrame) -> DataFrame:
    """One row per run with the metrics the leaderboard needs."""
    def metric(name: str):
        return F.max(F.when((F.col("kind") == "metric") & (F.col("name") == name), F.col("value")))

    def param(name: str):
        return F.max(F.when((F.col("kind") == "param") & (F.col("name") == name), F.col("text")))

    return log.groupBy("experiment", "run_id", "run_name").agg(
        metric("AUC").alias("AUC"),
        metric("cv_mean_auc").alias("cv_mean_auc"),
        metric("F1").alias("F1"),
        metric("cv_mean_f1").alias("cv_mean_f1"),
        metric("Precision_at_20").alias("Precision_at_20"),
        param("n_features").try_cast("int").alias("n_features"),
        F.max("logged_at").alias("started"),
    )


def run_leaderboard(runs: DataFrame, per_experiment: int = RUNS_PER_EXPERIMENT) -> DataFrame:
    """Best runs of every experiment, best first; fallback metric names fill gaps."""
    order = Window.partitionBy("experiment").orderBy(F.desc_nulls_last("AUC"), F.asc("run_id"))
    best = runs.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= per_experiment
    )

    def first_of(*names: str):
        return F.round(F.coalesce(*[F.col(n) for n in names], F.lit(0.0)), 4)

    return best.select(
        "experiment",
        "run_id",
        F.coalesce("run_name", F.substring("run_id", 1, 8)).alias("run_name"),
        first_of("AUC", "cv_mean_auc").alias("auc"),
        first_of("F1", "cv_mean_f1").alias("f1"),
        first_of("Precision_at_20").alias("precision_at_20"),
        F.coalesce("n_features", F.lit(0)).alias("n_features"),
    ).orderBy(F.desc("auc"), "experiment", "run_id")
