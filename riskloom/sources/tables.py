"""Parquet tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.session import pin_utc


#: Rows of one input that a task takes at most on average, so that its memory does not grow with the input.
TASK_ROWS = 500_000


def deal_out(rows: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` in as many tasks as ``n_rows`` asks for; unchanged if the session's partitions are enough."""
    tasks = -(-n_rows // TASK_ROWS)
    if tasks <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows
    return rows.repartition(tasks, *keys)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{folder}/{name}.parquet")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Write and hand back the stored copy, so later steps read the file."""
    writer = df.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """Out-of-fold scores: ``file_path, is_buggy, oof_prob, oof_pred``."""
    return spark.read.schema("file_path string, is_buggy int, oof_prob double, oof_pred int").parquet(path)
