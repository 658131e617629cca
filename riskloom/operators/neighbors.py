"""Relevance of numeric features to a label, estimated from nearest neighbours.

For each row the distance to its k-th neighbour of the same class is compared with how
many rows of any class lie that close. In one dimension neighbours are neighbours in
sorted order, so everything is done on sorted ranges of values: a range gets the few
rows of its class that lie next to it (its halo), and rows inside an interval are the
difference of two running totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.ordering import melt
from riskloom.session import fresh_path
from riskloom.sources.tables import write_table

NEIGHBORS = 3
RANGES = 256


def digamma(n: Column) -> Column:
    """The digamma function of a whole number of at least 1."""
    shift = 8
    x = n.cast("double") + shift
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8)
    for i in range(shift):
        series = series - 1 / (n.cast("double") + i)
    return series


def _with_range(rows: DataFrame, cuts: DataFrame, value: str) -> DataFrame:
    # One row of cut points per feature; the features are listed in the plan.
    number = F.size(F.filter("cuts", lambda c: c < F.col(value)))
    return rows.join(F.broadcast(cuts), "feature").withColumn("part", number).drop("cuts")


def _radius(placed: DataFrame, k: int) -> DataFrame:
    """Add ``radius``: the distance to the ``wanted``-th other row of the class. Equal values are one row with ``n``."""
    side = ["feature", "label", "part"]
    point = F.struct("value", "n")
    up, down = Window.partitionBy(*side).orderBy("value"), Window.partitionBy(*side).orderBy(F.desc("value"))
    edge = placed.withColumn("i", F.row_number().over(up)).withColumn("j", F.row_number().over(down)).where((F.col("i") <= k) | (F.col("j") <= k))
    # At most 2k rows per range; every range that occurs has one, so k ranges away there are k rows.
    edges = edge.groupBy(*side).agg(
        F.array_sort(F.collect_list(F.when(F.col("i") <= k, point))).alias("first"),
        F.array_sort(F.collect_list(F.when(F.col("j") <= k, point))).alias("last"),
    )
    near = Window.partitionBy("feature", "label").orderBy("part")
    before = F.flatten(F.collect_list("last").over(near.rowsBetween(-k, -1)))
    after = F.flatten(F.collect_list("first").over(near.rowsBetween(1, k)))
    halo = edges.select(*side, before.alias("before"), after.alias("after"))
    halo = halo.select(*side, F.explode(F.concat(F.slice(F.reverse("before"), 1, k), F.slice("after", 1, k))).alias("p"))
    halo = halo.select(*side, "p.value", "p.n", F.lit(True).alias("halo"))
    both = placed.withColumn("halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    around = [F.lag(point, i).over(up) for i in range(1, k + 1)] + [F.lead(point, i).over(up) for i in range(1, k + 1)]
    own = both.withColumn("around", F.array_compact(F.array(*around))).where("not halo").drop("halo")
    apart = F.transform("around", lambda p: F.struct(F.abs(p["value"] - F.col("value")).alias("d"), p["n"].alias("n")))
    own = own.withColumn("apart", apart).drop("around")

    def reached(d: Column) -> Column:
        closer = F.aggregate("apart", F.col("n") - 1, lambda s, z: s + F.when(z["d"] <= d, z["n"]).otherwise(0))
        return closer >= F.col("wanted")

    far_enough = F.array_min(F.transform(F.filter("apart", lambda z: reached(z["d"])), lambda z: z["d"]))
    return own.withColumn("radius", F.when(F.col("n") > F.col("wanted"), 0.0).otherwise(far_enough)).drop("apart")


def neighbor_information(
    df: DataFrame, features: Sequence[str], label: str = "is_buggy", k: int = NEIGHBORS, n_ranges: int = RANGES
) -> DataFrame:
    """``feature, information``: estimated mutual information (natural log, at least 0) of each feature with the label.

    Null and NaN take no part, nor do rows without a label or alone in their class. A
    class with fewer than ``k`` other rows uses those it has. Where the k-th neighbour
    has the same value, the row is compared with all rows of that value: no noise is
    added to tell them apart, so the result is the same every time.
    """
    long = melt(df.withColumn("label", F.col(label).cast("int")).where("label is not null"), ["label"], features)
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    cells = long.groupBy("feature", "label", "value").agg(F.count(F.lit(1)).alias("n"))
    cells = write_table(cells, fresh_path(df.sparkSession, "value-counts"))
    # Features times classes rows, both listed.
    sizes = cells.groupBy("feature", "label").agg(F.sum("n").alias("n_label")).where("n_label > 1")
    cells = cells.join(F.broadcast(sizes), ["feature", "label"]).withColumn("wanted", F.least(F.lit(k), F.col("n_label") - 1))
    shares = [i / n_ranges for i in range(1, n_ranges)]
    cuts = cells.groupBy("feature").agg(F.array_distinct(F.percentile_approx("value", shares, 4 * n_ranges)).alias("cuts"))
    cuts = write_table(cuts, fresh_path(df.sparkSession, "value-cuts"))
    near = _radius(_with_range(cells, cuts, "value"), k).drop("part")
    near = write_table(near, fresh_path(df.sparkSession, "neighbor-distances"))
    tied = F.col("radius") == 0
    none = F.lit(0).cast("bigint")
    carried = [F.col("n"), F.when(tied, F.col("n")).otherwise(F.col("wanted")).alias("k"), F.col("n_label")]
    # Rows below an end come before it, rows at it after; order 1 are the rows themselves.
    upper = near.select(
        "feature", "label", "value", (F.col("value") + F.col("radius")).alias("at"), F.when(tied, 2).otherwise(0).alias("order"),
        none.alias("rows"), F.lit(1).alias("sign"), *carried,
    )
    lower = near.select(
        "feature", "label", "value", (F.col("value") - F.col("radius")).alias("at"), F.when(tied, 0).otherwise(2).alias("order"),
        none.alias("rows"), F.lit(-1).alias("sign"), *[none.alias(c) for c in ("n", "k", "n_label")],
    )
    itself = near.select(
        "feature", "label", "value", F.col("value").alias("at"), F.lit(1).alias("order"), F.col("n").alias("rows"), F.lit(0).alias("sign"),
        *[none.alias(c) for c in ("n", "k", "n_label")],
    )
    events = _with_range(upper.unionByName(lower).unionByName(itself), cuts, "at")
    ahead = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = events.groupBy("feature", "part").agg(F.sum("rows").alias("t")).select(
        "feature", "part", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("feature", "part").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = events.withColumn("below", F.sum("rows").over(inside)).join(F.broadcast(offsets), ["feature", "part"]).where("sign <> 0")
    close = totals.groupBy("feature", "label", "value").agg(
        F.sum(F.col("sign") * (F.col("below") + F.col("before"))).alias("m"), *[F.sum(c).alias(c) for c in ("n", "k", "n_label")]
    )
    terms = digamma(F.col("k")) - digamma(F.col("n_label")) - digamma(F.col("m"))
    by_feature = close.groupBy("feature").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * terms).alias("terms"))
    estimate = digamma(F.col("rows")) + F.col("terms") / F.col("rows")
    return by_feature.select("feature", F.round(F.greatest(estimate, F.lit(0.0)), 6).alias("information"))
