"""Additive contributions of features to a row's score."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.training import assemble
from riskloom.session import fresh_path


def linear_attributions(
    df: DataFrame, coefficients: Mapping[str, float], ids: Sequence[str], intercept: float = 0.0
) -> DataFrame:
    """Long form for a linear score: ``coef * (x - mean)`` per row and feature.

    Adds ``base_value`` (the score of the mean row). Means come from one pass and
    travel as a one-row scalar.
    """
    names = list(coefficients)
    means = df.agg(F.struct(*[F.avg(F.col(c).cast("double")).alias(c) for c in names]).alias("m")).scalar()
    filled = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in names], means.alias("__m"))
    base = F.lit(float(intercept))
    for c in names:
        base = base + F.lit(float(coefficients[c])) * F.col(f"__m.{c}")
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(c).alias("value"),
                (
                    F.lit(float(coefficients[c]))
                    * (F.coalesce(F.col(c), F.col(f"__m.{c}")) - F.col(f"__m.{c}"))
                ).alias("attribution"),
            )
            for c in names
        ]
    )
    return filled.select(*ids, base.alias("base_value"), F.inline(rows))


def tree_table(spark: SparkSession, model: GBTClassificationModel) -> pd.DataFrame:
    """All nodes of the fitted trees; its size is fixed by tree count and depth.

    ``cover`` is the weight of the training rows that reached a node.
    """
    path = fresh_path(spark, "trees")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("id"),
        F.col("nodeData.prediction").alias("prediction"),
        F.get(F.col("nodeData.impurityStats"), F.lit(0)).alias("cover"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"),
    )
    return nodes.toPandas().sort_values(["tree", "id"], ignore_index=True)


#: Paths with more distinct features than this get their subset weights per row, not per pattern.
PATTERN_FEATURES = 10


def subset_weights(inside: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley factors of one leaf's value, per row of ``inside`` and path feature.

    ``inside[r, j]`` says whether the row meets all conditions on feature j,
    ``shares[j]`` which share of the training weight does. The weights of all
    feature subsets by size are extended feature by feature; for each feature its
    own extension is then unwound again.
    """
    n, m = inside.shape
    one, zero = inside.astype(float), shares.astype(float)
    weights = np.zeros((n, m + 1))
    weights[:, 0] = 1.0
    for j in range(m):
        size = j + 1
        for k in range(j, -1, -1):
            weights[:, k + 1] += one[:, j] * weights[:, k] * (k + 1) / (size + 1)
            weights[:, k] *= zero[j] * (size - k) / (size + 1)
    factors = np.empty((n, m))
    for j in range(m):
        taken, total, untaken = weights[:, m].copy(), np.zeros(n), np.zeros(n)
        for k in range(m - 1, -1, -1):
            part = taken / (k + 1)
            total += part
            taken = weights[:, k] - part * zero[j] * (m - k)
            if zero[j] > 0:
                untaken += weights[:, k] / (zero[j] * (m - k))
        factors[:, j] = np.where(inside[:, j], total, untaken) * (m + 1) * (one[:, j] - zero[j])
    return factors


@dataclass(frozen=True)
class Leaf:
    """A leaf by the interval ``low < x <= high`` each feature of its path must lie in."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shares: np.ndarray
    value: float
    #: Contribution per pattern of met intervals, or None for very long paths.
    table: np.ndarray | None


def ensemble_leaves(nodes: pd.DataFrame, weights: Sequence[float]) -> tuple[list[Leaf], float]:
    """All leaves of weighted trees, and the mean value of a training row.

    ``nodes`` holds ``tree, id, prediction, cover, left, right, feature, threshold``;
    ids are places within the tree, a negative ``left`` marks a leaf, and a row goes
    left if its value is at most the threshold.
    """
    leaves, base = [], 0.0
    for (_, part), weight in zip(nodes.groupby("tree"), weights, strict=True):
        rows = part.set_index("id")
        open_nodes: list[tuple[int, dict]] = [(rows.index[0], {})]
        root = rows["cover"].iloc[0]
        while open_nodes:
            at, path = open_nodes.pop()
            node = rows.loc[at]
            if node["left"] >= 0:
                feature, cut = int(node["feature"]), float(node["threshold"])
                low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
                for child, bounds in ((node["left"], (low, min(high, cut))), (node["right"], (max(low, cut), high))):
                    step = share * rows.at[int(child), "cover"] / node["cover"]
                    open_nodes.append((int(child), {**path, feature: (*bounds, step)}))
                continue
            value = float(weight * node["prediction"])
            base += value * node["cover"] / root
            if path:
                features = np.array(sorted(path))
                low, high, shares = np.array([path[f] for f in features]).T
                table = None
                if len(features) <= PATTERN_FEATURES:
                    patterns = np.arange(2 ** len(features))[:, None] >> np.arange(len(features)) & 1
                    table = value * subset_weights(patterns == 1, shares)
                leaves.append(Leaf(features, low, high, shares, value, table))
    return leaves, base


def leaf_contributions(x: np.ndarray, leaves: Sequence[Leaf]) -> np.ndarray:
    """Shapley value of every feature for every row of ``x``."""
    out = np.zeros_like(x)
    for leaf in leaves:
        values = x[:, leaf.features]
        inside = (values > leaf.low) & (values <= leaf.high)
        if leaf.table is None:
            out[:, leaf.features] += leaf.value * subset_weights(inside, leaf.shares)
        else:
            out[:, leaf.features] += leaf.table[inside @ (1 << np.arange(inside.shape[1]))]
    return out


def shapley_attributions(
    df: DataFrame, nodes: pd.DataFrame, weights: Sequence[float], features: Sequence[str], ids: Sequence[str]
) -> DataFrame:
    """Long form: path-dependent Shapley values of the weighted trees in ``nodes``.

    A feature that is not known takes both ways of a split by the training weight of
    each; the value is the feature's mean effect over all orders of getting known.
    ``base_value`` plus a row's contributions is its margin. The leaves are few and
    fixed by the fit, so they are broadcast; rows stream through Arrow batches.
    """
    spark = df.sparkSession
    leaves, base = ensemble_leaves(nodes, weights)
    shared = spark.sparkContext.broadcast(leaves)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                batch = batch.drop(columns="x")
                batch["contributions"] = list(leaf_contributions(x, shared.value))
                yield batch

    raw = F.array(*[F.col(c).cast("double") for c in features])
    vectors = assemble(df, features).select(*ids, raw.alias("raw"), vector_to_array("features").alias("x"))
    schema = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in ids)
    wide = vectors.mapInPandas(explain, f"{schema}, raw array<double>, contributions array<double>")
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.when(~F.isnan(F.col("raw")[i]), F.col("raw")[i]).alias("value"),
                F.col("contributions")[i].alias("attribution"),
            )
            for i, c in enumerate(features)
        ]
    )
    return wide.select(*ids, F.lit(base).alias("base_value"), F.inline(rows))


def tree_attributions(
    df: DataFrame, model: GBTClassificationModel, features: Sequence[str], ids: Sequence[str]
) -> DataFrame:
    """Shapley values of fitted boosted trees with respect to their margin."""
    nodes = tree_table(df.sparkSession, model)
    return shapley_attributions(df, nodes, [float(w) for w in model.treeWeights], features, ids)


def attribution_gaps(attributions: DataFrame, margins: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Per row the number of contributions and what they, with the base value, miss of ``margin``."""
    sums = attributions.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("features"), (F.max("base_value") + F.sum("attribution")).alias("total")
    )
    gap = F.round(F.abs(F.col("total") - F.col("margin")), 6)
    return sums.join(margins, list(ids)).select(*ids, "features", gap.alias("gap"))


def wide_attributions(long: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One column per feature, as the stored attribution matrix has them."""
    return long.groupBy(*ids).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("attribution"))).alias(c) for c in features]
    )


def global_importance(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature."""
    return attributions.groupBy("feature").agg(
        F.round(F.avg(F.abs("attribution")), 6).alias("importance")
    )


def explain_row(attributions: DataFrame, where, ids: Sequence[str] = ("id",)) -> DataFrame:
    """One row's contributions by size, with base value and their sum."""
    one = attributions.filter(where)
    if one.isEmpty():
        raise ValueError("no row with this id")
    total = one.agg(F.sum("attribution")).scalar()
    return one.select(
        *ids,
        "feature",
        F.round("attribution", 6).alias("attribution"),
        F.round("base_value", 6).alias("base_value"),
        F.round(total, 6).alias("attribution_sum"),
    )
