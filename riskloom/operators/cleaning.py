"""Missing values, sparse columns, leaky columns and quality audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ordering import exact_quantiles, melt, null_safe_join
from riskloom.schema import require_columns
from riskloom.session import fresh_path
from riskloom.sources.tables import write_table

MAX_NULL_SHARE = 0.50
OUTLIER_RATIO = 10


def drop_leaky_columns(df: DataFrame, leaky: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in leaky if c in df.columns])


def null_shares(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Null share of every column from one pass; one row reaches the driver."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns]).first()
    return {c: (row[c] or 0.0) for c in columns}


def drop_sparse_columns(
    df: DataFrame, columns: Sequence[str] | None = None, limit: float = MAX_NULL_SHARE
) -> DataFrame:
    """Drop columns whose null share is above ``limit``."""
    shares = null_shares(df, columns or df.columns)
    return df.drop(*[c for c, share in shares.items() if share > limit])


def _number(name: str) -> Column:
    """The column as a double; NaN is null."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def impute_global_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls of the listed columns with the exact column median."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    medians = exact_quantiles(melt(df, [], present), ["feature"], [0.5])
    wide = medians.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "quantile")))
    ).scalar()  # one entry per listed column
    return df.withColumns({c: F.coalesce(_number(c), wide[c]) for c in present})


def impute_group_median(
    df: DataFrame, columns: Sequence[str], group: str = "repo_name"
) -> DataFrame:
    """Group median first, then the median of the partly filled column.

    Medians are taken of columns with gaps only; one pass finds these. The group medians
    are stored once: the fill joins them, and only a column for which some group has no
    median needs the second, global pass.
    """
    spark = df.sparkSession
    gaps = df.agg(*[F.count_if(_number(c).isNull()).alias(c) for c in columns]).first() if columns else {}
    full, columns = [c for c in columns if not gaps[c]], [c for c in columns if gaps[c]]
    df = df.withColumns({c: _number(c) for c in full})
    if not columns:
        return df
    medians = exact_quantiles(melt(df, [group], columns), [group, "feature"], [0.5])
    listed = medians.groupBy(group).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("quantile"))).alias(f"__m_{c}") for c in columns]
    )
    every = df.select(group).distinct()
    wide = write_table(
        null_safe_join(every, listed, [group], "left"), fresh_path(spark, "group-medians")
    )
    lacking = wide.agg(*[F.count_if(F.col(f"__m_{c}").isNull()).alias(c) for c in columns]).first()
    filled = null_safe_join(df, wide, [group], "left")
    filled = filled.withColumns(
        {c: F.coalesce(_number(c), F.col(f"__m_{c}")) for c in columns}
    ).drop(*[f"__m_{c}" for c in columns])
    return impute_global_median(filled, [c for c in columns if lacking[c]])


def null_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count and percentage per column, from one pass."""
    total = F.count(F.lit(1))
    counts = df.agg(total.alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(c).alias("null_count"),
                F.round(F.try_divide(F.col(c) * 100, F.col("__n")), 1).alias("null_percent"),
            )
            for c in columns
        ]
    )
    return counts.select(F.inline(rows))


def validate_no_nulls(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Raise if label or id is missing or a feature still has nulls."""
    require_columns(df, ["is_buggy", "file_path"], "feature matrix")
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in features]).first()
    left = {c: row[c] for c in features if row[c]}
    if left:
        raise ValueError(f"nulls remain after imputation: {left}")
    return df


def quality_report(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Per numeric column: nulls, range, moments, zero-variance and outlier flags."""
    aggs = []
    for c in numeric:
        x = F.col(c).cast("double")
        aggs += [
            F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"),
            F.min(x).alias(f"{c}__min"),
            F.max(x).alias(f"{c}__max"),
            F.avg(x).alias(f"{c}__mean"),
            F.stddev_samp(x).alias(f"{c}__std"),
        ]
    one = df.agg(*aggs)

    def part(c: str, name: str):
        return F.col(f"{c}__{name}")

    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                part(c, "nulls").alias("null_count"),
                F.round(part(c, "min"), 4).alias("min_value"),
                F.round(part(c, "max"), 4).alias("max_value"),
                F.round(part(c, "mean"), 4).alias("mean_value"),
                F.round(part(c, "std"), 4).alias("std_value"),
                F.coalesce(part(c, "min") == part(c, "max"), F.lit(False)).alias("zero_variance"),
                F.coalesce(
                    (part(c, "mean") > 0) & (part(c, "max") > OUTLIER_RATIO * part(c, "mean")),
                    F.lit(False),
                ).alias("heavy_outliers"),
            )
            for c in numeric
        ]
    )
    return one.select(F.inline(rows))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row: all rows minus distinct rows."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__c"))
    return groups.agg(
        F.sum("__c").alias("total_rows"),
        F.sum(F.col("__c") - 1).alias("duplicate_rows"),
    )


def group_coverage(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Percentage of rows with any value in each column group."""
    one = df.agg(
        *[
            F.avg(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull().cast("int")).alias(name)
            for name, columns in groups.items()
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_group"),
                F.lit(len(columns)).alias("columns_in_group"),
                F.round(F.col(name) * 100, 1).alias("coverage_percent"),
            )
            for name, columns in groups.items()
        ]
    )
    return one.select(F.inline(rows))


def matrix_views(df: DataFrame, features: Sequence[str]) -> dict[str, DataFrame]:
    """The three projections of a finished matrix."""
    return {
        "clean": df.select("file_path", "is_buggy", *features),
        "with_repo": df.select("repo_name", "file_path", "is_buggy", *features),
        "final": df.select("repo_name", "file_path", "is_buggy", "commit_date", *features),
    }
