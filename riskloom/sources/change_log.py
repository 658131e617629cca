"""Change-log scans, unions and upserts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from riskloom.functions.text import forward_slashes
from riskloom.functions.timing import as_naive_utc
from riskloom.schema import CHANGE_LOG, require_columns


def read_change_log_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV scan; dates stay text so that bad ones can be dropped, not guessed."""
    schema = "".join(
        f"{f.name} {'string' if f.name == 'commit_date' else f.dataType.simpleString()}, "
        for f in CHANGE_LOG.fields
    ).rstrip(", ")
    raw = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')
    return clean_change_log(raw)


def clean_change_log(raw: DataFrame) -> DataFrame:
    """UTC-naive dates (unparseable rows dropped) and neutral values for nulls."""
    require_columns(raw, ["commit_date", "is_bug_fix", "lines_changed", "file_path"], "change log")
    dated = raw.withColumn("commit_date", as_naive_utc(F.col("commit_date").cast("string")))
    return (
        dated.filter(F.col("commit_date").isNotNull())
        .withColumn("is_bug_fix", F.coalesce("is_bug_fix", F.lit(False)))
        .withColumn("lines_changed", F.coalesce("lines_changed", F.lit(0).cast("bigint")))
        .withColumn("file_path", forward_slashes(F.coalesce("file_path", F.lit("unknown"))))
    )


def union_sources(
    sources: Mapping[str, DataFrame | Callable[[], DataFrame]],
    tag: str = "dataset_source",
    allow_failed: bool = False,
) -> tuple[DataFrame, dict[str, str]]:
    """(union of all sources, each row tagged with its source; reasons by failed source).

    A source that cannot be opened is an error, unless the caller allows it.
    """
    opened, failed = [], {}
    for name, source in sources.items():
        try:
            df = source() if callable(source) else source
            opened.append(df.withColumn(tag, F.lit(name)))
        except (AnalysisException, OSError, ValueError) as error:
            failed[name] = str(error).splitlines()[0]
    if not opened or (failed and not allow_failed):
        raise ValueError(f"sources that could not be loaded: {failed}")
    result = opened[0]
    for df in opened[1:]:
        result = result.unionByName(df, allowMissingColumns=True)
    return result, failed


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    ``row_number() = 1`` is planned with a group limit before the shuffle, so a
    key with very many copies sends one row per task.
    """
    ranked = df.withColumn(
        "__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return ranked.filter(F.col("__rn") == 1).drop("__rn")


def dedupe_changes(log: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    """Earliest row per (change, repo, file)."""
    order = [F.asc("commit_date"), *[F.asc(c) for c in tie_break]]
    return keep_first(log, ["commit_hash", "repo_name", "file_path"], order)


def merge_keep_latest(
    existing: DataFrame,
    new: DataFrame,
    keys: Sequence[str] = ("repo_name", "file_path"),
    date: str = "window_end",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Upsert: the row with the newest date per key; new rows win a tie."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(
        new.withColumn("__new", F.lit(1)), allowMissingColumns=True
    )
    order = [F.desc_nulls_last(date), F.desc("__new"), *[F.asc(c) for c in tie_break]]
    return keep_first(both, keys, order).drop("__new")


def fill_missing_from_secondary(
    primary: DataFrame, secondary: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """All primary rows, plus secondary rows whose key the primary lacks."""
    extra = secondary.join(primary.select(*keys), list(keys), "left_anti")
    return primary.unionByName(extra)


def path_overlap(left: DataFrame, right: DataFrame, key: str = "file_path") -> DataFrame:
    """Distinct keys on each side and in both, in one pass over both."""
    sides = left.select(F.col(key), F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(F.col(key), F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per_key.filter(F.col(key).isNotNull()).agg(
        F.sum("l").alias("left_keys"),
        F.sum("r").alias("right_keys"),
        F.sum(F.col("l") * F.col("r")).alias("overlap"),
    )


def change_row_defaults(raw: DataFrame, message_chars: int | None = None) -> DataFrame:
    """Row shape of a mined change: named author, non-null sizes, message cut to ``message_chars`` if asked for.

    Fix flags belong before such a cut, as they would miss words after it.
    """
    message = F.coalesce("commit_message", F.lit(""))
    if message_chars is not None:
        message = F.substring(message, 1, message_chars)
    added = F.coalesce("lines_added", F.lit(0)).cast("bigint")
    deleted = F.coalesce("lines_deleted", F.lit(0)).cast("bigint")
    return (
        raw.withColumn("commit_message", message)
        .withColumn("author_email", F.coalesce("author_email", F.lit("unknown")))
        .withColumn("lines_changed", added + deleted)
        .withColumn("lines_added", added)
        .withColumn("lines_deleted", deleted)
        .withColumn("file_path", F.coalesce("new_path", "old_path"))
        .drop("new_path", "old_path")
    )
