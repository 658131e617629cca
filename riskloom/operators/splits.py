"""Train/test splits and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ordering import exact_quantiles, rank_in_groups
from riskloom.functions.timing import micros, minus_months

TEST_MONTHS = 12
TEST_SHARE = 0.2
FOLDS = 5
HASH_BUCKETS = 10_007


def id_hash(ident: Column) -> Column:
    """Spread integer ids over ``HASH_BUCKETS`` values, the same in any engine."""
    return F.pmod(ident * 7919, F.lit(HASH_BUCKETS))


def text_hash(*columns: str) -> Column:
    """Spread text ids over ``HASH_BUCKETS`` values."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(HASH_BUCKETS))


def temporal_split(df: DataFrame, months: int = TEST_MONTHS, date: str = "commit_date") -> DataFrame:
    """Add ``split``: rows after (newest date - months) are test, others train.

    Rows without a date are train. Every row keeps its place in one table; the
    two sides are filters on ``split``.
    """
    cutoff = minus_months(df.agg(F.max(date)).scalar(), months)
    is_test = F.coalesce(F.col(date) > cutoff, F.lit(False))
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def temporal_split_quantile(df: DataFrame, p: float = 0.8, date: str = "commit_date") -> DataFrame:
    """The same with the date quantile as cutoff."""
    at = micros(F.col(date))
    long = df.select(at.cast("double").alias("value"))
    cutoff = exact_quantiles(long, [], [p]).select("quantile").scalar()
    is_test = F.coalesce(at > cutoff, F.lit(False))
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def _ranked_in_class(df: DataFrame, ids: Sequence[str], label: str, hashed: Column) -> DataFrame:
    return rank_in_groups(df, [label], [hashed], [F.col(c) for c in ids], "__rank")


def stratified_holdout(
    df: DataFrame,
    ids: Sequence[str],
    hashed: Column,
    label: str = "is_buggy",
    share: float = TEST_SHARE,
) -> DataFrame:
    """Add ``split``: the first ``ceil(share * n)`` rows of each class are test.

    Order within a class is an id hash, so the split is repeatable; the rank is
    taken per hash bucket and never sorts a whole class in one task. Rows without
    a label are a class of their own.
    """
    # One row per class, read as a map: the table is not joined on its few labels.
    name = F.coalesce(F.col(label).cast("string"), F.lit("no label"))
    counts = df.groupBy(name.alias("__class")).agg(F.count(F.lit(1)).alias("__n"))
    sizes = counts.agg(F.map_from_entries(F.collect_list(F.struct("__class", "__n")))).scalar()
    ranked = _ranked_in_class(df, ids, label, hashed)
    in_test = F.col("__rank") <= F.ceil(F.lit(share) * F.element_at(sizes, name))
    return ranked.withColumn("split", F.when(in_test, "test").otherwise("train")).drop("__rank")


def stratified_kfold(
    df: DataFrame, ids: Sequence[str], hashed: Column, label: str = "is_buggy", k: int = FOLDS
) -> DataFrame:
    """Add ``fold`` 0..k-1, balanced within each class."""
    ranked = _ranked_in_class(df, ids, label, hashed)
    return ranked.withColumn("fold", F.pmod(F.col("__rank"), F.lit(k)).cast("int")).drop("__rank")


def split_by_time(
    df: DataFrame,
    ids: Sequence[str],
    months: int = TEST_MONTHS,
    date: str = "commit_date",
    label: str = "is_buggy",
    both_classes: bool = False,
    p: float | None = None,
    otherwise: str | None = None,
) -> DataFrame:
    """Temporal split, with the method used in ``split_method``.

    If it leaves no usable test side, this raises, unless the caller asks for a
    stratified split in that case (``otherwise="stratified"``).
    """
    if otherwise not in (None, "stratified"):
        raise ValueError(f"unknown method {otherwise}")

    def instead(why: str) -> DataFrame:
        if otherwise is None:
            raise ValueError(f"no temporal split: {why}")
        split = stratified_holdout(df, ids, text_hash(*ids), label)
        return split.withColumn("split_method", F.lit("stratified"))

    if date not in df.columns:
        return instead(f"there is no column {date}")
    split = temporal_split_quantile(df, p, date) if p else temporal_split(df, months, date)
    test = split.filter("split = 'test'").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("classes")
    ).first()
    if test["n"] == 0:
        return instead("the test side is empty")
    if both_classes and test["classes"] < 2:
        return instead("the test side has one class only")
    return split.withColumn("split_method", F.lit("temporal"))


def class_weights(df: DataFrame, label: str = "is_buggy", given: float | None = None) -> DataFrame:
    """Add ``weight``: 1 for negatives, ``round(neg / pos, 2)`` for positives."""
    if given is not None:
        weight = F.lit(float(given))
    else:
        positive = F.sum(F.col(label).cast("bigint"))
        weight = df.agg(
            F.coalesce(
                F.round(F.try_divide(F.count(F.lit(1)) - positive, positive), 2), F.lit(1.0)
            )
        ).scalar()
    return df.withColumn("weight", F.when(F.col(label).cast("int") == 1, weight).otherwise(1.0))
