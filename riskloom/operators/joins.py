"""Joins that put labels, metrics, sources and vectors together."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.text import base_name
from riskloom.functions.timing import plus_days
from riskloom.operators.history import BLANK, KEYS, History
from riskloom.session import fresh_path
from riskloom.sources.tables import write_table


def match_modules_to_history(modules: DataFrame, log: DataFrame) -> DataFrame:
    """A date per module: exact path, else bare file name, else the newest date.

    ``has_git_match`` is true for the first two. Modules that already carry
    ``window_end`` keep it.
    """
    if "window_end" in modules.columns:
        return modules.withColumn("has_git_match", F.lit(True))
    by_path = log.groupBy("file_path").agg(F.max("commit_date").alias("__path_date"))
    by_name = log.groupBy(F.col("filename").alias("__name")).agg(
        F.max("commit_date").alias("__name_date")
    )
    newest = log.agg(F.max("commit_date")).scalar()
    return (
        modules.withColumn("__name", base_name(F.col("file_path")))
        .join(by_path, "file_path", "left")
        .join(by_name, "__name", "left")
        .withColumn("__own", F.coalesce("__path_date", "__name_date"))
        .withColumn("has_git_match", F.col("__own").isNotNull())
        .withColumn("window_end", F.coalesce(F.col("__own"), newest))
        .drop("__name", "__path_date", "__name_date", "__own")
    )


def _newest_until(
    refs: DataFrame, log: DataFrame, keys: Sequence[str], payload: str, bounded: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """Per (keys, ref date): the newest ``payload`` dated at or before the ref, with ``carry``, as ``found``.
    Of equal dates the largest payload counts.

    As-of join without pairing rows: refs and revisions are ordered together. With
    ``bounded`` keys one window holds a key; else refs and revisions are ordered per
    (keys, day), and the last revision of earlier days comes from a summary with
    one row per day, so a key with very many revisions is split by day.
    """
    both = (
        log.filter(F.col("commit_date").isNotNull() & F.col(payload).isNotNull())
        .select(
            # Keys under new names of their own let the union keep how both sides are dealt out.
            *[F.col(k).alias(k) for k in keys],
            F.col("commit_date").alias("at"),
            F.lit(0).alias("is_ref"),
            F.struct("commit_date", payload, *carry).alias("found"),
        )
        .unionByName(
            refs.select(*keys, F.col("window_end").alias("at"), F.lit(1).alias("is_ref")).distinct(),
            allowMissingColumns=True,
        )
    )
    so_far = Window.orderBy("at", "is_ref", "found").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if bounded:
        newest = F.last("found", ignorenulls=True).over(so_far.partitionBy(*keys))
        return both.select(*keys, "at", "is_ref", newest.alias("found")).filter("is_ref = 1").select(
            *keys, F.col("at").alias("window_end"), "found"
        )
    both = both.withColumn("day", F.to_date("at"))
    inside = so_far.partitionBy(*keys, "day")
    earlier = (
        Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    )
    days = (
        both.groupBy(*keys, "day")
        .agg(F.max("found").alias("last_of_day"))
        .select(*keys, "day", F.max("last_of_day").over(earlier).alias("carried"))
    )
    return (
        both.withColumn("same_day", F.max("found").over(inside))
        .filter("is_ref = 1")
        .join(days, [*keys, "day"])
        .select(
            *keys,
            F.col("at").alias("window_end"),
            F.coalesce("same_day", "carried").alias("found"),
        )
    )


def _files_sharing_a_name(*tables: DataFrame) -> DataFrame:
    """Files of which another one in the same repository has the same bare name; stored, so that few are broadcast."""
    files = reduce(DataFrame.unionAll, [t.select(*KEYS).distinct() for t in tables]).distinct()
    files = files.withColumn("__name", base_name(F.col("file_path")))
    shared = files.groupBy("repo_name", "__name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = files.join(shared, ["repo_name", "__name"], "left_semi").select(*KEYS)
    return write_table(found, fresh_path(files.sparkSession, "shared-names"))


def source_digest_as_of(
    refs: DataFrame, history: History, match_names: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """``digest`` of the newest source text at or before each ref; null if there is none or it is blank.

    ``refs`` holds ``repo_name, file_path, window_end`` and, optionally,
    ``has_git_match`` (false skips the lookup). With ``match_names`` a revision of
    the same bare file name also counts and the newer one wins. No text is read.
    ``carry`` names columns that the digest determines.
    """
    keys = list(KEYS)
    revisions = history.changes
    wanted = refs
    if "has_git_match" in refs.columns:
        wanted = refs.filter("has_git_match")
    wanted = history.placed(wanted.select(*keys, "window_end").distinct())
    found = _newest_until(wanted, revisions, keys, "digest", history.buckets is not None, carry)
    if match_names:
        # A name that one file has finds nothing that its path does not.
        twins = history.placed(_files_sharing_a_name(revisions, wanted))
        named_refs = wanted.withColumn("__name", base_name(F.col("file_path")))
        named = revisions.join(twins, keys, "left_semi").withColumn("__name", base_name(F.col("file_path")))
        shared_refs = named_refs.join(twins, keys, "left_semi")
        by_name = _newest_until(shared_refs, named, ["repo_name", "__name"], "digest", carry=carry)
        found = (
            named_refs.join(found, [*keys, "window_end"], "left")
            .join(by_name.withColumnRenamed("found", "found_name"), ["repo_name", "__name", "window_end"], "left")
            .withColumn("found", F.greatest("found", "found_name"))
            .drop("__name", "found_name")
        )
    digest = F.when(~F.col("found.digest").endswith(BLANK), F.col("found.digest"))
    named = {"digest": digest, **{c: F.col(f"found.{c}") for c in carry}}
    return refs.join(found.withColumns(named).drop("found"), [*keys, "window_end"], "left")


def source_as_of(refs: DataFrame, history: History, match_names: bool = False) -> DataFrame:
    """Newest source text at or before each ref, with its digest; blank text becomes null.

    Only digests go through the as-of step; the texts found are fetched at the end.
    """
    return history.fetched(source_digest_as_of(refs, history, match_names))


def assemble_matrix(
    labels: DataFrame,
    process: DataFrame,
    structure: DataFrame,
    keys: Sequence[str],
    structure_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Labels with process and structure columns; the left name wins a clash."""
    result = labels
    for right, on in ((process, keys), (structure, structure_keys or keys)):
        fresh = [c for c in right.columns if c in on or c not in result.columns]
        result = result.join(right.select(*fresh), list(on), "left")
    return result


def rename_structure_columns(structure: DataFrame) -> DataFrame:
    """Prefix the two structure columns that clash with benchmark metrics."""
    for name in ("cyclomatic_complexity", "cognitive_complexity"):
        if name in structure.columns:
            structure = structure.withColumnRenamed(name, f"ast_{name}")
    return structure


def lookup_vector_or_zero(
    rows: DataFrame,
    vectors: DataFrame,
    keys: Sequence[str] = ("repo_name", "file_path"),
    dim: int = 0,
    features: Sequence[str] = (),
    missing: float = -1.0,
) -> DataFrame:
    """Vector per row, zeros where there is none, after the tabular columns.

    ``keys`` name a vector: equal paths of two repositories do not mix. A missing
    tabular value is ``missing``, as for the tabular model.
    """
    keys = list(keys)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    joined = rows.join(vectors.select(*keys, "embedding"), keys, "left").withColumn(
        "embedding", F.coalesce("embedding", zeros)
    )
    if not features:
        return joined
    tabular = F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(missing).cast("float")) for c in features])
    return joined.withColumn("hybrid", F.concat(tabular, F.col("embedding")))


def widened_vectors(
    rows: DataFrame, vectors: DataFrame, keys: Sequence[str], features: Sequence[str], names: Sequence[str]
) -> DataFrame:
    """Tabular values as the hybrid model sees them, then one column per vector dimension in ``names``."""
    joined = lookup_vector_or_zero(rows, vectors, keys, len(names))
    tabular = {c: F.col(c).cast("float").cast("double") for c in features}
    wide = {name: F.col("embedding")[i].cast("double") for i, name in enumerate(names)}
    return joined.withColumns({**tabular, **wide}).drop("embedding")


def repair_dates(
    df: DataFrame,
    history: DataFrame,
    ref: datetime,
    threshold: datetime,
    default_days: int | None = None,
    keys: Sequence[str] = ("repo_name", "file_path"),
) -> DataFrame:
    """Replace missing or implausibly new ``last_seen`` dates.

    A date before ``threshold`` stays. Otherwise the file's newest history date
    is taken, else ``ref - days_since_last_change``; a history date at or past
    the threshold is estimated as well. ``default_days`` stands in for a missing
    age.
    """
    limit = F.lit(threshold).cast("timestamp_ntz")
    newest = history.groupBy(*keys).agg(F.max("commit_date").alias("__newest"))
    age: Column = F.col("days_since_last_change")
    if default_days is not None:
        age = F.coalesce(age, F.lit(default_days))
    estimate = plus_days(F.lit(ref).cast("timestamp_ntz"), -age)
    first = F.when(F.col("last_seen") < limit, F.col("last_seen")).otherwise(
        F.coalesce(F.date_trunc("day", F.col("__newest")).cast("timestamp_ntz"), estimate)
    )
    fixed = df.join(newest, list(keys), "left").withColumn("__first", first)
    again = F.when(F.col("__first") >= limit, estimate).otherwise(F.col("__first"))
    return fixed.withColumn("last_seen", again).drop("__newest", "__first")


def real_date_share(df: DataFrame, threshold: datetime, date: str = "last_seen") -> DataFrame:
    limit = F.lit(threshold).cast("timestamp_ntz")
    real = F.count_if(F.col(date) < limit)
    total = F.count(F.lit(1))
    return df.agg(
        real.alias("real_dates"),
        total.alias("total_rows"),
        F.round(F.try_divide(real * 100, total), 1).alias("real_percent"),
    )


def choose_event_date(df: DataFrame) -> DataFrame:
    """``commit_date`` from ``last_seen``, else from ``window_end``."""
    if "last_seen" in df.columns:
        return df.withColumnRenamed("last_seen", "commit_date").drop("window_end")
    if "window_end" in df.columns:
        return df.withColumnRenamed("window_end", "commit_date")
    return df


def date_lookup_join(
    df: DataFrame, dates: DataFrame, keys: Sequence[str] = ("repo_name", "file_path")
) -> DataFrame:
    """Earliest non-null date per file of another table."""
    lookup = dates.groupBy(*keys).agg(F.min("window_end").alias("window_end"))
    return df.join(lookup, list(keys), "left")


def coverage_join(matrix: DataFrame, covered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many matrix rows have a partner in ``covered``."""
    flags = covered.select(*keys).distinct().withColumn("__hit", F.lit(1))
    total = F.count(F.lit(1))
    hits = F.count("__hit")
    return matrix.select(*keys).join(flags, list(keys), "left").agg(
        hits.alias("covered_rows"),
        total.alias("total_rows"),
        F.round(F.try_divide(hits * 100, total), 1).alias("covered_percent"),
    )


def non_zero_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.exists("embedding", lambda x: x != 0))


def at_risk_with_attributions(
    scored: DataFrame,
    attributions: DataFrame,
    importance: DataFrame,
    k: int = 10,
    n_features: int = 3,
    ids: str = "id",
    score: str = "score",
) -> DataFrame:
    """Top ``k`` rows with their attributions to the globally strongest features."""
    top = scored.orderBy(F.desc(score), F.asc(ids)).limit(k)
    strongest = importance.orderBy(F.desc("importance"), F.asc("feature")).limit(n_features)
    wanted = attributions.join(F.broadcast(strongest.select("feature")), "feature").select(
        ids, "feature", "attribution"
    )
    return top.join(wanted, ids, "left")
