"""Benchmark module tables: static metrics with a label per module."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.ordering import rank_in_groups, with_value_bucket
from riskloom.operators.cleaning import impute_global_median
from riskloom.schema import BENCHMARK_NAMES


def read_benchmark_csv(spark: SparkSession, path: str) -> DataFrame:
    """Metric CSV with an input position, taken from the file split and row order."""
    header = spark.read.csv(path, header=True)
    fields = [
        T.StructField(c, T.StringType() if BENCHMARK_NAMES.get(c) == "is_buggy" else T.DoubleType())
        for c in header.columns
    ]
    rows = spark.read.csv(path, schema=T.StructType(fields), header=True)
    return rows.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("__at"),
    )


def label_from_text(text):
    """true/yes and false/no; anything else is null, not silently true."""
    low = F.lower(text)
    return F.when(low.isin("true", "yes"), F.lit(True)).when(low.isin("false", "no"), F.lit(False))


def rename_benchmark_columns(raw: DataFrame) -> DataFrame:
    columns = []
    for name in raw.columns:
        column = F.col(f"`{name}`")
        target = BENCHMARK_NAMES.get(name, name.lower().replace(" ", "_"))
        if target == "is_buggy" and raw.schema[name].dataType == T.StringType():
            column = label_from_text(column)
        columns.append(column.alias(target))
    return raw.select(*columns)


def load_benchmark_modules(raw: DataFrame, dataset: str, position: str) -> DataFrame:
    """Renamed metrics with an id from the input row number.

    ``position`` is a column that gives the input order: a number, or the struct
    (file, block, row) of :func:`read_benchmark_csv`.
    """
    if isinstance(raw.schema[position].dataType, T.StructType):
        at = F.col(f"`{position}`")
        buckets = [at["file"], at["block"]]
        numbered = rank_in_groups(raw, [], buckets, [at["row"]], "__row")
    else:
        bucketed = with_value_bucket(raw, position, "__pb")
        numbered = rank_in_groups(
            bucketed, [], [F.col("__pb")], [F.col(f"`{position}`")], "__row"
        ).drop("__pb")
    named = rename_benchmark_columns(numbered.drop(position))
    return named.withColumns(
        {
            "file_path": F.concat(F.lit(f"{dataset}_module_"), (F.col("__row") - 1).cast("string")),
            "repo_name": F.lit(dataset),
            "dataset_source": F.lit("PROMISE"),
        }
    ).drop("__row")


def drop_sparse_rows(df: DataFrame, share: float = 0.7) -> DataFrame:
    """Rows with at least ``share`` of all columns present."""
    return df.na.drop(thresh=math.ceil(share * len(df.columns) - 1e-9))


def clean_benchmark_modules(df: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Drop sparse rows, then fill the remaining numeric gaps with the median."""
    kept = drop_sparse_rows(df)
    numeric = metrics or [
        f.name for f in kept.schema.fields if isinstance(f.dataType, T.NumericType)
    ]
    return impute_global_median(kept, numeric)
