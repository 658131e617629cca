"""Boosted-tree training, scoring and calibration on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.ordering import rank_in_groups, with_value_bucket
from riskloom.operators import metrics
from riskloom.operators.joins import lookup_vector_or_zero
from riskloom.operators.splits import class_weights, split_by_time, stratified_holdout, text_hash
from riskloom.session import fresh_path
from riskloom.sources.tables import write_table


@dataclass(frozen=True)
class TreeParams:
    """Defaults of the boosted-tree fits."""

    n_estimators: int = 300
    max_depth: int = 6
    learning_rate: float = 0.05
    subsample: float = 0.8
    min_child_weight: int = 5
    min_gain: float = 0.0
    #: Share of the features that each split may choose from.
    column_share: float = 0.8
    early_stopping_tol: float = 0.01
    positive_weight: float | None = None
    seed: int = 42


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Tabular columns to one vector. Null becomes -1, below every real count.

    Trees split on order, so a value outside the range keeps "missing" apart.
    """
    filled = df.withColumns({f"__f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in features})
    assembler = VectorAssembler(inputCols=[f"__f_{c}" for c in features], outputCol="features")
    return assembler.transform(filled).drop(*[f"__f_{c}" for c in features])


def fit_trees(
    vectors: DataFrame, params: TreeParams, validation: str | None = None, label: str = "is_buggy"
) -> GBTClassificationModel:
    """Fit on ``features``; positives weighted; optional early stop on ``validation``."""
    weighted = class_weights(vectors, label, params.positive_weight)
    columns = ["features", "weight", F.col(label).cast("double").alias("label")]
    if validation:
        columns.append(F.col(validation))
    trees = GBTClassifier(
        labelCol="label",
        weightCol="weight",
        maxIter=params.n_estimators,
        maxDepth=params.max_depth,
        stepSize=params.learning_rate,
        subsamplingRate=params.subsample,
        minInstancesPerNode=params.min_child_weight,
        minInfoGain=params.min_gain,
        featureSubsetStrategy="all" if params.column_share >= 1 else str(params.column_share),
        validationTol=params.early_stopping_tol,
        seed=params.seed,
    )
    if validation:
        trees = trees.setValidationIndicatorCol(validation)
    return trees.fit(weighted.select(*columns))


def score_vectors(model: GBTClassificationModel, vectors: DataFrame) -> DataFrame:
    """Add ``score``, the probability of the positive class."""
    scored = model.transform(vectors)
    return scored.withColumn("score", vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction"
    )


def train_boosted_trees(df: DataFrame, features: Sequence[str], params: TreeParams, **kw):
    return fit_trees(assemble(df, features), params, **kw)


def score_batch(model: GBTClassificationModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    return score_vectors(model, assemble(df, features)).drop("features")


def as_scored(df: DataFrame, ident: Column, label: str = "is_buggy") -> DataFrame:
    return df.select(ident.alias("id"), F.col(label).cast("int").alias("y"), "score")


def cv_oof_scores(
    folded: DataFrame, features: Sequence[str], params: TreeParams, ids: Sequence[str], k: int = 5
) -> tuple[DataFrame, DataFrame, int]:
    """Out-of-fold scores, fold metrics and the mean number of trees.

    Each fold trains with early stopping on its validation rows. Scores are
    stored in the shared folder, so later steps read them instead of refitting.
    """
    spark = folded.sparkSession
    vectors = write_table(
        assemble(folded, features).select(*ids, "is_buggy", "fold", vector_to_array("features").alias("x")),
        fresh_path(spark, "cv-vectors"),
    ).withColumn("features", array_to_vector("x")).drop("x")
    parts, trees = [], []
    for fold in range(k):
        marked = vectors.withColumn("held_out", F.col("fold") == fold)
        model = fit_trees(marked, params, validation="held_out")
        trees.append(model.getNumTrees)
        parts.append(score_vectors(model, vectors.filter(F.col("fold") == fold)).drop("features"))
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    scores = write_table(united, fresh_path(spark, "oof-scores"))
    rows = None
    for fold in range(k):
        one = as_scored(scores.filter(F.col("fold") == fold), F.concat_ws("|", *ids))
        threshold = metrics.best_threshold(one).first()[0]
        row = metrics.evaluate(one, threshold).select(
            F.lit(fold).alias("fold"),
            "auc",
            "f1",
            "precision",
            "recall",
            F.col("average_precision").alias("ap"),
            F.lit(float(threshold)).alias("best_threshold"),
            F.lit(trees[fold]).alias("trees"),
        )
        rows = row if rows is None else rows.unionAll(row)
    folds = write_table(rows, fresh_path(spark, "fold-metrics"))
    mean_threshold = folds.agg(F.avg("best_threshold")).scalar()
    oof = scores.select(
        *ids,
        F.col("is_buggy").cast("int").alias("is_buggy"),
        F.col("score").alias("oof_prob"),
        (F.col("score") >= mean_threshold).cast("int").alias("oof_pred"),
    )
    return oof, folds, sum(trees) // len(trees)


def refit_final(
    df: DataFrame, features: Sequence[str], params: TreeParams, n_trees: int, path: str
) -> GBTClassificationModel:
    """Refit on all rows with a fixed tree count and save model and parameters."""
    final = replace(params, n_estimators=max(n_trees, 1))
    model = train_boosted_trees(df, features, final)
    model.write().overwrite().save(path)
    meta = df.sparkSession.createDataFrame(
        [(list(features), {k: str(v) for k, v in asdict(final).items()})],
        "feature_names array<string>, params map<string,string>",
    )
    meta.write.mode("overwrite").parquet(path + "-meta")
    return model


def load_model(spark: SparkSession, path: str) -> tuple[GBTClassificationModel, list[str]]:
    names = spark.read.parquet(path + "-meta").first()["feature_names"]
    return GBTClassificationModel.load(path), list(names)


def hybrid_vectors(
    df: DataFrame, features: Sequence[str], vectors: DataFrame, keys: Sequence[str], dim: int
) -> DataFrame:
    """Tabular columns followed by the looked-up vector, as one ML vector."""
    joined = lookup_vector_or_zero(df, vectors, keys, dim, features)
    return joined.withColumn("features", array_to_vector(F.col("hybrid").cast("array<double>"))).drop(
        "hybrid", "embedding"
    )


def hybrid_train(
    df: DataFrame,
    features: Sequence[str],
    vectors: DataFrame,
    keys: Sequence[str],
    dim: int,
    params: TreeParams,
) -> tuple[GBTClassificationModel, DataFrame]:
    """Fit on tabular and vector features together; metrics on the training rows."""
    joined = hybrid_vectors(df, features, vectors, keys, dim)
    model = fit_trees(joined, params)
    scored = as_scored(score_vectors(model, joined), F.concat_ws("|", *keys))
    row = metrics.evaluate(scored).select(
        F.col("auc").alias("train_auc"),
        F.col("average_precision").alias("train_ap"),
        F.col("f1").alias("train_f1"),
    )
    return model, row


def hybrid_names(features: Sequence[str], dim: int) -> list[str]:
    return [*features, *[f"gnn_emb_{i}" for i in range(dim)]]


def three_way_comparison(
    df: DataFrame,
    features: Sequence[str],
    vectors: DataFrame,
    keys: Sequence[str],
    dim: int,
    params: TreeParams,
    ids: Sequence[str],
    months: int = 3,
    k: int = 20,
) -> DataFrame:
    """Random split, temporal split and temporal split with vectors, side by side."""
    spark = df.sparkSession
    tabular = list(features)
    random_split = stratified_holdout(df, ids, text_hash(*ids))
    by_time = split_by_time(df, ids, months)
    runs = [
        ("baseline_random_split", random_split, False),
        ("baseline_temporal_split", by_time, False),
        ("hybrid_temporal_split", by_time, True),
    ]
    result = None
    for name, split, hybrid in runs:
        vectored = (
            hybrid_vectors(split, tabular, vectors, keys, dim) if hybrid else assemble(split, tabular)
        )
        model = fit_trees(vectored.filter("split = 'train'"), params)
        test = score_vectors(model, vectored.filter("split = 'test'"))
        scored = write_table(
            as_scored(test, F.concat_ws("|", *ids)), fresh_path(spark, "comparison-scores")
        )
        row = metrics.evaluate(scored, 0.5, k).select(
            F.lit(name).alias("run_name"),
            F.round("auc", 4).alias("auc"),
            F.round("f1", 4).alias("f1"),
            F.round("precision", 4).alias("precision"),
            F.round("recall", 4).alias("recall"),
            F.round("precision_at_k", 4).alias("precision_at_20"),
            F.lit(len(tabular) + (dim if hybrid else 0)).alias("n_features"),
        )
        result = row if result is None else result.unionAll(row)
    baseline = result.filter("run_name = 'baseline_temporal_split'").select("auc").scalar()
    note = F.when(
        (F.col("run_name") == "hybrid_temporal_split") & (F.col("auc") <= baseline),
        "hybrid did not beat the temporal baseline",
    )
    return result.withColumn("warning", note)


def feature_importance(
    spark: SparkSession, model: GBTClassificationModel, names: Sequence[str], k: int = 20
) -> DataFrame:
    """The ``k`` most important features and whether each is a vector dimension."""
    values = model.featureImportances.toArray()
    rows = [(n, round(float(v), 6), n.startswith("gnn_emb_")) for n, v in zip(names, values)]
    table = spark.createDataFrame(rows, "feature string, importance double, is_vector_dim boolean")
    return table.orderBy(F.desc("importance"), "feature").limit(k)


def loss_table(spark: SparkSession, model: GBTClassificationModel, vectors: DataFrame) -> DataFrame:
    """Loss after each tree, one row per step."""
    labeled = class_weights(vectors).select(
        "features", "weight", F.col("is_buggy").cast("double").alias("label")
    )
    losses = model.evaluateEachIteration(labeled)
    return spark.createDataFrame(
        [(i, float(x)) for i, x in enumerate(losses)], "step int, loss double"
    )


def loss_smoothing(
    losses: DataFrame, series: Sequence[str] = (), window: int = 5, below: float = 0.5
) -> DataFrame:
    """Trailing mean of the loss and the first step of each series below a bound.

    ``losses`` holds ``step`` and ``loss``. Rows get their place in the series from
    a bucketed rank; each loss is then added to the next ``window`` places, so a
    long series is never ordered in one task.
    """
    keys = list(series)
    first = losses.filter(F.col("loss") < below).groupBy(*keys).agg(
        F.min("step").alias("first_below")
    )
    placed = rank_in_groups(
        with_value_bucket(losses.select(*keys, "step", "loss"), "step", "__b"),
        keys,
        [F.col("__b")],
        [F.col("step")],
        "place",
    )
    ahead = F.explode(F.array(*[F.lit(i) for i in range(window)]))
    spread = placed.select(*keys, "step", "loss", "place", ahead.alias("ahead"))
    own = F.col("ahead") == 0
    smoothed = (
        spread.groupBy(*keys, (F.col("place") + F.col("ahead")).alias("place"))
        .agg(
            F.max(F.when(own, F.col("step"))).alias("step"),
            F.max(F.when(own, F.col("loss"))).alias("loss"),
            F.round(F.avg("loss"), 6).alias("smoothed"),
        )
        .filter(F.col("step").isNotNull())
        .drop("place")
    )
    if keys:
        return smoothed.join(first, keys, "left")
    return smoothed.withColumn("first_below", first.scalar())
