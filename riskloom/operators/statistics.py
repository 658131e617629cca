"""Correlations, histograms, relevance and class balance."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.ordering import exact_quantiles, melt, null_safe_join

IMBALANCE_SHARE = 0.15


def label_correlation(df: DataFrame, features: Sequence[str], label: str = "is_buggy") -> DataFrame:
    """Pearson correlation of every feature with the label, in one pass."""
    y = F.col(label).cast("double")
    one = df.agg(*[F.corr(F.col(c).cast("double"), y).alias(c) for c in features])
    rows = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.round(c, 6).alias("r")) for c in features]
    )
    return one.select(F.inline(rows)).filter(F.col("r").isNotNull() & ~F.isnan("r"))


def strongest_label_correlations(correlations: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most positive and ``k`` most negative correlations."""
    up = correlations.orderBy(F.desc("r"), "feature").limit(k).withColumn("side", F.lit("risk"))
    down = correlations.orderBy("r", "feature").limit(k).withColumn("side", F.lit("protective"))
    return up.unionAll(down)


def pearson_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Correlation of every pair of features over rows that have both, in one pass."""
    pairs = list(combinations(features, 2))
    one = df.agg(
        *[
            F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.round(f"p{i}", 6).alias("r")
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return one.select(F.inline(rows)).filter(F.col("r").isNotNull() & ~F.isnan("r"))


def spearman_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rank correlation of every pair over complete rows (average ranks for ties)."""
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in features]).na.drop()
    vectors = VectorAssembler(inputCols=list(features), outputCol="v").transform(complete)
    matrix = Correlation.corr(vectors.select("v"), "v", "spearman").first()[0].toArray()
    rows = [
        (features[i], features[j], round(float(matrix[i][j]), 6))
        for i, j in combinations(range(len(features)), 2)
    ]  # one row per pair of feature names
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, r double")


def pairs_over(pairs: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """How many pairs reach each absolute threshold, with the largest value."""
    size = F.abs("r")
    one = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(size).alias("top"),
        *[F.count_if(size >= float(t)).alias(f"c{i}") for i, t in enumerate(thresholds)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.col(f"c{i}").alias("pairs"),
                F.round(F.try_divide(f"c{i}", "n"), 6).alias("fraction"),
                F.col("top").alias("max_abs_r"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    return one.select(F.inline(rows))


def correlation_distribution(pairs: DataFrame, bins: int = 40) -> DataFrame:
    """Equal-width histogram of the correlations between their min and max."""
    span = pairs.agg(F.struct(F.min("r").alias("lo"), F.max("r").alias("hi")).alias("s")).scalar()
    width = (span.getField("hi") - span.getField("lo")) / F.lit(float(bins))
    number = F.least(
        F.floor(F.try_divide(F.col("r") - span.getField("lo"), width)), F.lit(bins - 1)
    )
    return pairs.groupBy(F.coalesce(number, F.lit(0)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("pairs")
    )


def class_histogram(
    df: DataFrame, feature: str, label: str = "is_buggy", bins: int = 30, clip: float = 0.95
) -> DataFrame:
    """Per class: equal-width bins of the feature clipped at its quantile.

    Each class has its own range, from its smallest to its largest clipped value.
    """
    long = df.select(F.col(feature).cast("double").alias("value"))
    top = exact_quantiles(long, [], [clip]).select("quantile").scalar()
    clipped = df.filter(F.col(feature).isNotNull()).select(
        F.col(label).cast("int").alias("label"),
        F.least(F.col(feature).cast("double"), top).alias("x"),
    )
    ranges = clipped.groupBy("label").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")
    )  # one row per class
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.coalesce(
        F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)), F.lit(bins - 1)), F.lit(0)
    )
    return (
        null_safe_join(clipped, ranges, ["label"])
        .groupBy("label", "lo", "hi", "n", number.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            "label",
            "bin",
            "rows",
            F.round(F.try_divide(F.col("rows"), F.col("n") * width), 6).alias("density"),
        )
    )


def mutual_information(
    df: DataFrame, features: Sequence[str], label: str = "is_buggy", bins: int = 10
) -> DataFrame:
    """Relevance of each feature to the label on its quantile bins (natural log).

    Bin edges are exact quantiles that occur in the data; a value belongs to the
    bin given by the number of edges below it.
    """
    labeled = df.withColumn("label", F.col(label).cast("int"))
    long = melt(labeled, ["label"], features).filter(F.col("value").isNotNull())
    edges = exact_quantiles(
        long, ["feature"], [i / bins for i in range(1, bins)], mode="disc"
    )
    per_feature = edges.groupBy("feature").agg(
        F.array_sort(F.collect_set("quantile")).alias("edges")
    )  # at most bins - 1 numbers per feature
    bin_no = F.size(F.filter("edges", lambda e: e < F.col("value")))
    cells = (
        long.join(per_feature, "feature")
        .groupBy("feature", "label", bin_no.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most bins x classes rows per feature from here on.
    def total(*keys: str):
        return F.sum("n").over(Window.partitionBy(*keys))

    sized = cells.select(
        "feature",
        "n",
        total("feature", "bin").alias("n_bin"),
        total("feature", "label").alias("n_label"),
        total("feature").alias("n_all"),
    )
    term = (F.col("n") / F.col("n_all")) * F.log(
        F.col("n").cast("double") * F.col("n_all") / (F.col("n_bin").cast("double") * F.col("n_label"))
    )
    return sized.groupBy("feature").agg(F.round(F.sum(term), 6).alias("mutual_information"))


def class_balance(df: DataFrame, label: str = "is_buggy") -> DataFrame:
    """Counts per class, ratio, imbalance and a remark."""
    positive = F.sum(F.col(label).cast("bigint"))
    total = F.count(label)
    remark = F.when(F.col("bug_ratio") < IMBALANCE_SHARE, "HIGH IMBALANCE").otherwise("MANAGEABLE")
    return (
        df.agg(
            (total - positive).alias("clean"),
            positive.alias("buggy"),
            F.round(F.try_divide(positive, total), 4).alias("bug_ratio"),
            F.round(F.try_divide(total - positive, positive), 1).alias("clean_per_buggy"),
        )
        .withColumn("balance", remark)
    )


