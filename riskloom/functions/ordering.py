"""Exact order statistics, ranks and running totals without one-task windows.

A window over a whole table, or over one group that may hold a third of it, runs
in a single task. The helpers here cut the ordering into buckets first:

* counts per bucket are a small aggregate (combined before the shuffle),
* a running sum over that small aggregate gives each bucket its offset,
* only the rows of one bucket are ordered together.

Buckets are pure functions of a row's own values (given cut points that are
literals in the plan), so a recomputed task always lands in the same bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import fresh_path
from riskloom.sources.tables import write_table

BUCKETS = 256
#: Rows of a range that are ordered in one task before the range is cut again.
BUCKET_ROWS = 2_000_000
SKETCH_ACCURACY = 100_000


def value_cuts(df: DataFrame, value: str, n_buckets: int, offset: float = 0.0) -> list[float]:
    """Cut points that split ``value`` into about ``n_buckets`` equal parts.

    They come from a mergeable quantile sketch; at most ``n_buckets`` numbers reach
    the driver. ``offset`` moves all cuts down by that share of a part.
    """
    probabilities = [p for i in range(1, n_buckets + (offset > 0)) if 0 < (p := (i - offset) / n_buckets) < 1]
    if not probabilities:
        return []
    source = df.select(F.col(value).cast("double").alias(value))
    return sorted(set(source.approxQuantile(value, probabilities, 1.0 / (4 * n_buckets))))


def with_cut_bucket(df: DataFrame, value: str, out: str, cuts: Sequence[float]) -> DataFrame:
    """Add the number of the range between ``cuts`` that ``value`` falls into, as a double."""
    if not cuts:
        return df.withColumn(out, F.lit(0.0))
    as_double = f"__{out}_double"
    splits = [float("-inf"), *cuts, float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol=as_double, outputCol=out, handleInvalid="keep")
    return bucketizer.transform(df.withColumn(as_double, F.col(value).cast("double"))).drop(as_double)


def with_value_bucket(
    df: DataFrame, value: str, out: str, n_buckets: int = BUCKETS, sample: DataFrame | None = None
) -> DataFrame:
    """Add an order-preserving bucket number with about equal rows per bucket.

    The cut points come from ``sample`` (or ``df``). They only balance the buckets:
    results that use them stay exact whatever the cut points are.
    """
    return with_cut_bucket(df, value, out, value_cuts(df if sample is None else sample, value, n_buckets))


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on keys that may be null, keeping the left copy of the keys."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__r_{key}")
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{key}" for key in keys])


def rank_in_groups(
    df: DataFrame,
    group: Sequence[str],
    bucket: Sequence[Column],
    order: Sequence[Column],
    out: str = "row_rank",
) -> DataFrame:
    """1-based row number per group, ordered by ``(bucket..., order...)``.

    ``bucket`` are orderable columns that split a group finely enough for one
    task to sort one (group, bucket).
    """
    names = [f"__b{i}" for i in range(len(bucket))]
    tagged = df.select("*", *[b.alias(n) for b, n in zip(bucket, names)])
    keys = [*group, *names]
    counts = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    ranked = tagged.withColumn("__local", F.row_number().over(inside))
    return (
        null_safe_join(ranked, offsets, keys)
        .withColumn(out, (F.col("__before") + F.col("__local")).cast("bigint"))
        .drop("__before", "__local", *names)
    )


def _finer(tagged: DataFrame, value: str, levels: Sequence[str], below: str, n_buckets: int, bucket_rows: int) -> DataFrame:
    """Cut every range of ``levels`` that holds more than ``bucket_rows`` rows again; ``below`` numbers its parts.

    The cut points of a range come from a sketch of its own rows: one row per range.
    """
    shares = [i / n_buckets for i in range(1, n_buckets)]
    as_double = F.col(value).cast("double")
    cuts = (
        tagged.groupBy(*levels)
        .agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx(as_double, shares, 4 * n_buckets).alias("__cuts"))
        .where(F.col("__n") > bucket_rows)
        .drop("__n")
    )
    joined = tagged.join(cuts, list(levels), "left")
    return joined.withColumn(below, F.coalesce(F.size(F.filter("__cuts", lambda c: c < as_double)), F.lit(0))).drop("__cuts")


def scan_ranges(
    df: DataFrame, value: str, n_buckets: int = BUCKETS, sample: DataFrame | None = None, bucket_rows: int = BUCKET_ROWS
) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns that number nested, order-preserving ranges, and their names.

    The last ranges hold at most ``bucket_rows`` distinct values; how many levels that
    takes follows from the row count.
    """
    levels = ["__l0"]
    # The sketch leaves a range at most one and a half times its even share.
    most = (df if sample is None else sample).count() * 2 // n_buckets
    if most > bucket_rows:
        df = write_table(df, fresh_path(df.sparkSession, "distinct-values"))
    tagged = with_value_bucket(df, value, levels[0], n_buckets, sample)
    # Rows without a value are a range below all others.
    tagged = tagged.withColumn(levels[0], F.coalesce(levels[0], F.lit(-1.0)))
    while most > bucket_rows:
        most = most * 2 // n_buckets
        tagged = _finer(tagged, value, levels, f"__l{len(levels)}", n_buckets, bucket_rows)
        levels.append(f"__l{len(levels)}")
    return tagged, levels


def running_totals(
    df: DataFrame,
    value: str,
    measures: Sequence[str],
    descending: bool = True,
    n_buckets: int = BUCKETS,
    sample: DataFrame | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add ``cum_<measure>``: totals over all rows up to and including this one.

    ``df`` must hold one row per distinct ``value`` (NaN and null have a range of their
    own), ``sample`` at least as many. A scan whose number of levels follows the row
    count: values are cut into ``n_buckets`` ranges, and ranges that may hold more than
    ``bucket_rows`` rows are cut again. A level's offsets are running sums over the
    ranges of one range above; only rows of one last range are ordered together.
    ``bucket_rows`` changes no value.
    """
    tagged, levels = scan_ranges(df, value, n_buckets, sample, bucket_rows)
    direction = F.desc if descending else F.asc
    sums = tagged.groupBy(*levels).agg(*[F.sum(m).alias(f"__t_{m}") for m in measures])
    offsets = None
    for depth, level in enumerate(levels):
        above = levels[:depth]
        here = sums
        if depth + 1 < len(levels):
            here = sums.groupBy(*above, level).agg(*[F.sum(f"__t_{m}").alias(f"__t_{m}") for m in measures])
        # At most n_buckets rows per range above.
        before = Window.partitionBy(*above).orderBy(direction(level)).rowsBetween(Window.unboundedPreceding, -1)
        own = [F.coalesce(F.sum(f"__t_{m}").over(before), F.lit(0)).alias(f"__o{depth}_{m}") for m in measures]
        here = here.select(*above, level, *own)
        offsets = here if offsets is None else here.join(offsets, above)
    inside = Window.partitionBy(*levels).orderBy(direction(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = tagged.select("*", *[F.sum(m).over(inside).alias(f"__l_{m}") for m in measures])
    if len(levels) == 1:
        offsets = F.broadcast(offsets)
    found = local.join(offsets, levels)
    totals = []
    for m in measures:
        total = F.col(f"__l_{m}")
        for depth in range(len(levels)):
            total = total + F.col(f"__o{depth}_{m}")
        totals.append(total.alias(f"cum_{m}"))
    return found.select(*df.columns, *totals)


def melt(df: DataFrame, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form ``(keep..., feature, value)`` with double values."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    return df.select(*keep, F.explode(pairs).alias("__p")).select(
        *keep, "__p.feature", "__p.value"
    )


def exact_quantiles(
    long: DataFrame,
    group: Sequence[str],
    probabilities: Sequence[float],
    mode: str = "cont",
    value: str = "value",
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Exact quantiles per group: columns ``group..., probability, quantile``.

    A mergeable sketch gives a bracket that provably holds each quantile (groups
    no larger than ``accuracy`` skip it). Rows below a bracket collapse into one
    count before the shuffle; only the few distinct values inside it are ordered.
    Any valid bracket gives the same result, so a sketch recomputed with other
    bounds cannot change it. ``cont`` interpolates between the two neighbours,
    ``disc`` returns the smallest value whose share reaches p.
    """
    margin = 3.0 / accuracy
    points = list(probabilities)
    edges = []
    for p in points:
        edges += [max(0.0, p - margin), min(1.0, p + margin)]
    # NaN is no value: as a number it would count without lying in any bracket.
    present = long.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    bounds = present.groupBy(*group).agg(
        F.percentile_approx(value, edges, accuracy).alias("__edges"),
        F.count(F.lit(1)).alias("__n"),
    )
    small = F.col("__n") <= accuracy
    brackets = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("probability"),
                F.when(small, F.lit(float("-inf"))).otherwise(F.col("__edges")[2 * i]).alias("lo"),
                F.when(small, F.lit(float("inf")))
                .otherwise(F.col("__edges")[2 * i + 1])
                .alias("hi"),
            )
            for i, p in enumerate(points)
        ]
    )
    if group:
        # Stored, so that few groups are broadcast: dealt out by group, all rows of one would meet in a task.
        bounds = write_table(bounds, fresh_path(long.sparkSession, "quantile-bounds"))
        joined = null_safe_join(present, bounds, group)
    else:
        whole = bounds.select(F.struct("__edges", "__n")).scalar()
        joined = present.withColumn("__s", whole).select(
            value, F.col("__s.__edges").alias("__edges"), F.col("__s.__n").alias("__n")
        )
    exploded = joined.select(
        *group, F.col(value).alias("__v"), "__n", F.explode(brackets).alias("__q")
    ).filter(F.col("__v") <= F.col("__q.hi"))
    counted = (
        exploded.select(
            *group,
            "__n",
            F.col("__q.probability").alias("probability"),
            F.when(F.col("__v") >= F.col("__q.lo"), F.col("__v")).alias("__v"),
        )
        .groupBy(*group, "__n", "probability", "__v")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    running = Window.partitionBy(*group, "probability").orderBy(F.asc_nulls_first("__v"))
    cum = counted.withColumn("__cum", F.sum("__c").over(running))
    if mode == "disc":
        low_rank = F.greatest(F.ceil(F.col("probability") * F.col("__n")), F.lit(1))
        high_rank, fraction = low_rank, F.lit(0.0)
    else:
        position = F.col("probability") * (F.col("__n") - 1)
        low_rank = F.floor(position) + 1
        high_rank = F.ceil(position) + 1
        fraction = position - F.floor(position)
    picked = cum.groupBy(*group, "__n", "probability").agg(
        F.min(F.when(F.col("__cum") >= low_rank, F.col("__v"))).alias("__lo"),
        F.min(F.when(F.col("__cum") >= high_rank, F.col("__v"))).alias("__hi"),
    )
    return picked.select(
        *group,
        "probability",
        (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * fraction).alias("quantile"),
    )
