"""Aggregation reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ordering import exact_quantiles
from riskloom.functions.timing import minus_months
from riskloom.operators.predicates import feature_groups


def mining_summary(log: DataFrame) -> DataFrame:
    """Distinct changes and files, with their fix counterparts, and the date range."""
    fix = F.coalesce(F.col("is_bug_fix"), F.lit(False))
    # One group-by per kind of thing counted; several distinct counts at once would copy every row for each.
    changes = log.groupBy("commit_hash").agg(
        F.max(fix).alias("fix"), F.min("commit_date").alias("lo"), F.max("commit_date").alias("hi")
    )
    files = log.groupBy("repo_name", "file_path").agg(F.max(fix).alias("fix"))
    named = F.col("repo_name").isNotNull() & F.col("file_path").isNotNull()
    counted = files.agg(F.struct(F.count_if(named).alias("files"), F.count_if("fix").alias("buggy"))).scalar()
    row = changes.agg(
        F.count("commit_hash").alias("total_commits"),
        F.count_if(F.col("fix") & F.col("commit_hash").isNotNull()).alias("bug_fix_commits"),
        F.to_date(F.min("lo")).alias("first_date"),
        F.to_date(F.max("hi")).alias("last_date"),
    ).withColumns({"total_files": counted.getField("files"), "buggy_files": counted.getField("buggy")})
    return row.withColumn(
        "bug_ratio", F.round(F.try_divide("buggy_files", "total_files"), 3)
    )


def repo_breakdown(matrix: DataFrame) -> DataFrame:
    positive = F.sum(F.col("is_buggy").cast("bigint"))
    total = F.count("file_path")
    return (
        matrix.groupBy("repo_name")
        .agg(
            total.alias("files"),
            positive.alias("buggy"),
            F.round(F.avg(F.col("is_buggy").cast("int")), 6).alias("bug_rate"),
        )
        .orderBy(F.desc("files"), "repo_name")
    )


def monthly_activity(log: DataFrame) -> DataFrame:
    """Distinct changes per month, all and fixes; months without any are zero."""
    month = F.date_trunc("month", F.col("commit_date")).cast("date")
    per_change = (
        log.filter(F.col("commit_date").isNotNull())
        .groupBy(month.alias("month"), "commit_hash")
        .agg(F.max(F.col("is_bug_fix").cast("bigint")).alias("fix"))
    )
    per_month = per_change.groupBy("month").agg(
        F.count("commit_hash").alias("changes"), F.sum("fix").alias("fix_changes")
    )
    span = log.agg(
        F.date_trunc("month", F.min("commit_date")).cast("date").alias("lo"),
        F.date_trunc("month", F.max("commit_date")).cast("date").alias("hi"),
    )
    spine = span.select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month"))
    return spine.join(per_month, "month", "left").select(
        "month",
        F.coalesce("changes", F.lit(0)).cast("bigint").alias("changes"),
        F.coalesce("fix_changes", F.lit(0)).cast("bigint").alias("fix_changes"),
    )


def describe(df: DataFrame, value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of one column, as one row."""
    long = df.select(F.col(value).cast("double").alias("value"))
    quartiles = exact_quantiles(long, [], [0.25, 0.5, 0.75])
    lookup = quartiles.agg(
        F.map_from_entries(F.collect_list(F.struct("probability", "quantile")))
    ).scalar()  # three entries
    row = long.agg(
        F.count("value").alias("n"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.stddev_samp("value"), 6).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return row.select(
        "n",
        "mean",
        "std",
        "min",
        *[F.round(lookup[F.lit(p)], 6).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)],
        "max",
    )


def files_per_fix_change(log: DataFrame) -> DataFrame:
    return log.filter("is_bug_fix").groupBy("commit_hash").agg(F.count("file_path").alias("files"))


def largest_fix_changes(log: DataFrame, k: int = 10) -> DataFrame:
    return files_per_fix_change(log).orderBy(F.desc("files"), "commit_hash").limit(k)


def rows_per_file(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("repo_name", "file_path").agg(F.count(F.lit(1)).alias("rows"))


def holdout_sweep(matrix: DataFrame, months: Sequence[int], date: str = "window_end") -> DataFrame:
    """Train and test sizes for several holdout lengths, in one pass."""
    newest = matrix.agg(F.max(date)).scalar()
    d = F.col(date)
    positive = F.col("is_buggy").cast("bigint")
    aggs: list[Column] = []
    for m in months:
        cutoff = minus_months(newest, m)
        aggs += [
            F.count_if(d <= cutoff).alias(f"train_{m}"),
            F.count_if(d > cutoff).alias(f"test_{m}"),
            F.coalesce(F.sum(F.when(d > cutoff, positive)), F.lit(0)).alias(f"pos_{m}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("test_months"),
                F.col(f"train_{m}").alias("train_rows"),
                F.col(f"test_{m}").alias("test_rows"),
                F.col(f"pos_{m}").cast("bigint").alias("buggy_in_test"),
            )
            for m in months
        ]
    )
    return matrix.agg(*aggs).select(F.inline(rows))


def matrix_inventory(matrix: DataFrame, features: Sequence[str], date: str = "window_end") -> DataFrame:
    """Size, balance, repositories and date range of a matrix."""
    positive = F.sum(F.col("is_buggy").cast("bigint"))
    total = F.count(F.lit(1))
    return matrix.agg(
        total.alias("rows"),
        F.lit(len(features)).cast("bigint").alias("features"),
        positive.alias("buggy"),
        (total - positive).alias("clean"),
        F.count_distinct("repo_name").alias("repos"),
        F.to_date(F.min(date)).alias("first_date"),
        F.to_date(F.max(date)).alias("last_date"),
    )


def feature_inventory(matrix: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature names by group with their non-null counts."""
    counts = matrix.agg(*[F.count(c).alias(c) for c in features])
    rows = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).alias("present_rows")) for c in features]
    )
    return feature_groups(counts.select(F.inline(rows)))


def real_vs_synthetic_dates(matrix: DataFrame, threshold: datetime, date: str) -> DataFrame:
    """Rows and positive rate on either side of a date."""
    limit = F.lit(threshold).cast("timestamp_ntz")
    side = F.when(F.col(date) < limit, "real").when(F.col(date) >= limit, "synthetic")
    return (
        matrix.filter(F.col(date).isNotNull())
        .groupBy(side.alias("date_kind"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.round(F.avg(F.col("is_buggy").cast("int")) * 100, 1).alias("buggy_percent"),
        )
    )
