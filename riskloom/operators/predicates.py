"""Row filters and per-row derived columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ordering import null_safe_join
from riskloom.functions.text import any_of, base_name
from riskloom.functions.timing import plus_days
from riskloom.schema import PROCESS_KEYWORDS, SKEWED_METRICS

# File kinds and names that mining keeps or ignores.
SOURCE_SUFFIXES = (".py",)
IGNORED_NAME_PARTS = ("test_", "_test", "tests/", "test/", "conftest")
EXCLUDED_PATH_PARTS = (
    "/test_", "_test.py", "/tests/", "/test/",
    "/migrations/", "/conftest", "setup.py",
    "__pycache__", ".pyc",
)
MAX_SOURCE_BYTES = 100_000
MAX_FILES_PER_FIX = 15

# Score bounds of the risk buckets.
HIGH_RISK = 0.70
MEDIUM_RISK = 0.40


def keep_source_files(
    log: DataFrame, suffixes: Sequence[str] = SOURCE_SUFFIXES, ignored: Sequence[str] = IGNORED_NAME_PARTS
) -> DataFrame:
    """Files of a kept kind whose base name holds none of the ignored parts."""
    name = base_name(F.col("file_path"))
    kept = any_of([F.endswith(name, F.lit(s)) for s in suffixes])
    skipped = any_of([F.contains(F.lower(name), F.lit(part)) for part in ignored])
    return log.filter(kept & ~skipped)


def keep_repo_paths(
    log: DataFrame,
    roots: Mapping[str, Sequence[str]],
    excluded: Sequence[str] = EXCLUDED_PATH_PARTS,
) -> DataFrame:
    """Source paths under one of the roots listed for their repository.

    The roots are configuration, one short list per repository, so they travel
    as a literal map instead of a join. A root of ``.`` keeps every path.
    """
    path = F.col("file_path")
    entries: list[Column] = []
    for repo, paths in roots.items():
        entries += [F.lit(repo), F.array(*[F.lit(p) for p in paths])]
    own_roots = F.create_map(*entries)[F.col("repo_name")]
    under = F.exists(
        own_roots,
        lambda root: (root == ".")
        | F.startswith(path, F.concat(root, F.lit("/")))
        | F.contains(F.concat(F.lit("/"), path), F.concat(F.lit("/"), root, F.lit("/"))),
    )
    bad = any_of([F.contains(path, F.lit(part)) for part in excluded])
    return log.filter(F.endswith(path, F.lit(".py")) & ~bad & F.coalesce(under, F.lit(False)))


def max_size_filter(log: DataFrame, text: str = "source_code", limit: int = MAX_SOURCE_BYTES) -> DataFrame:
    """Drop rows whose UTF-8 text is larger than ``limit``; null text stays."""
    return log.filter(F.coalesce(F.octet_length(text), F.lit(0)) <= limit)


def history_range(
    log: DataFrame,
    since: datetime | None = None,
    until: datetime | None = None,
    last_days: int | None = None,
    ref: datetime | None = None,
    since_year: int | None = None,
    date: str = "commit_date",
) -> DataFrame:
    """Plain date bounds, so they reach the Parquet scan."""
    if since_year is not None:
        since = datetime(since_year, 1, 1)
    if last_days is not None:
        if ref is None:
            raise ValueError("last_days needs a reference date")
        log = log.filter(F.col(date) >= plus_days(F.lit(ref).cast("timestamp_ntz"), -last_days))
    if since is not None:
        log = log.filter(F.col(date) >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        log = log.filter(F.col(date) <= F.lit(until).cast("timestamp_ntz"))
    return log


def large_change_gate(
    log: DataFrame, flag: str = "is_bug_fix", max_files: int = MAX_FILES_PER_FIX, change: str = "commit_hash"
) -> DataFrame:
    """A fix that touches more than ``max_files`` kept files is not a fix.

    The count is combined before the shuffle and joined back, so a change with
    very many files is not gathered in one task. Rows without a repository or a
    change stay; those that agree in both count as one change.
    """
    sizes = log.groupBy("repo_name", change).agg(F.count(F.lit(1)).alias("files_in_change"))
    return null_safe_join(log, sizes, ["repo_name", change], "left").withColumn(
        flag, F.col(flag) & (F.col("files_in_change") <= max_files)
    )


def log1p_transform(df: DataFrame, columns: Sequence[str] = SKEWED_METRICS) -> DataFrame:
    """``log1p(max(x, 0))`` in place; nulls stay null."""
    return df.withColumns(
        {
            c: F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))))
            for c in columns
            if c in df.columns
        }
    )


def risk_bucket(score: Column, high: float = HIGH_RISK, medium: float = MEDIUM_RISK) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def align_features(
    df: DataFrame,
    features: Sequence[str],
    keep: Sequence[str] = (),
    constants: Mapping[str, float] | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """The model's columns in order; an absent column becomes 0.0."""
    constants = dict(constants or {})
    out = []
    for name in features:
        if name in drop:
            continue
        if name in df.columns:
            out.append(F.col(name).cast("double").alias(name))
        else:
            out.append(F.lit(float(constants.pop(name, 0.0))).alias(name))
    out += [F.lit(float(v)).alias(k) for k, v in constants.items()]
    return df.select(*keep, *out)


def feature_groups(features: DataFrame, name: str = "feature") -> DataFrame:
    """Tag feature names as process or structure."""
    process = any_of([F.contains(F.col(name), F.lit(k)) for k in PROCESS_KEYWORDS])
    return features.withColumn("feature_group", F.when(process, "process").otherwise("structure"))


def coerce_numeric(df: DataFrame, columns: Sequence[str], label: str | None = None) -> DataFrame:
    """Non-numeric text becomes null; a null label becomes 0."""
    changed = {c: F.col(c).try_cast("double") for c in columns if c in df.columns}
    if label:
        as_number = F.col(label).cast("string").try_cast("double")
        changed[label] = F.coalesce(as_number, F.lit(0.0)).cast("int")
    return df.withColumns(changed)
