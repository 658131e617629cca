"""Tables written to the shared folder, so that later steps and lost executors read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskloom.session import fresh_path


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back: its plan starts at the files."""
    path = fresh_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def sized_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; else a plain join is left to Spark."""
    return df.hint("broadcast") if df.limit(limit + 1).count() <= limit else df
