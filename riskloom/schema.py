"""Column contracts, fixed column lists and schema checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of a change log.
CHANGE_LOG = T.StructType(
    [
        T.StructField("commit_hash", T.StringType()),
        T.StructField("commit_date", T.TimestampNTZType()),
        T.StructField("commit_message", T.StringType()),
        T.StructField("author_email", T.StringType()),
        T.StructField("author_name", T.StringType()),
        T.StructField("is_bug_fix", T.BooleanType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("lines_added", T.LongType()),
        T.StructField("lines_deleted", T.LongType()),
        T.StructField("lines_changed", T.LongType()),
        T.StructField("complexity", T.LongType()),
        T.StructField("nloc", T.LongType()),
        T.StructField("source_code", T.StringType()),
        T.StructField("repo_name", T.StringType()),
    ]
)

# Benchmark metric names and the names they are given here.
BENCHMARK_NAMES = {
    "loc": "lines_of_code",
    "v(g)": "cyclomatic_complexity",
    "ev(g)": "essential_complexity",
    "iv(g)": "design_complexity",
    "n": "halstead_length",
    "v": "halstead_volume",
    "l": "halstead_level",
    "d": "halstead_difficulty",
    "i": "halstead_intelligence",
    "e": "halstead_effort",
    "b": "halstead_bugs",
    "t": "halstead_time",
    "lOCode": "lines_of_code_clean",
    "lOComment": "lines_of_comments",
    "lOBlank": "lines_blank",
    "lOCodeAndComment": "lines_code_and_comment",
    "uniq_Op": "unique_operators",
    "uniq_Opnd": "unique_operands",
    "total_Op": "total_operators",
    "total_Opnd": "total_operands",
    "branchCount": "branch_count",
    "defects": "is_buggy",
}

# Right-skewed benchmark columns that get a log1p transform.
SKEWED_METRICS = [
    "lines_of_code",
    "halstead_length",
    "halstead_volume",
    "halstead_effort",
    "halstead_time",
    "total_operators",
    "total_operands",
]

# Columns derived from the label, per entry point.
LEAKY_FOR_MATRIX = [
    "total_commits",
    "bug_fix_commits",
    "bug_fix_count_90d",
    "first_seen",
    "last_seen",
    "dataset_source",
    "commits_in_window",
    "bug_fix_commits_in_window",
    "window_end",
]
# Name parts that mark a process feature.
PROCESS_KEYWORDS = [
    "churn", "commit_count", "author_count", "fix_density",
    "days_since", "burst", "ownership",
]

# Columns that name or label a row.
IDENTITY_COLUMNS = ["file_path", "is_buggy", "repo_name", "commit_date"]


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    """Fail early, naming every missing column."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def feature_columns(df: DataFrame, extra_drop: Iterable[str] = ()) -> list[str]:
    """Every column that is neither an identity column nor listed as dropped."""
    drop = {*IDENTITY_COLUMNS, *extra_drop}
    return [c for c in df.columns if c not in drop]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means "no value" in text sources; Spark would sort it as the largest."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(
        *[
            F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floating else F.col(f"`{c}`")
            for c in df.columns
        ]
    )
