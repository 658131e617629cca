"""Risk reports and the explanation of one report row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import fixed
from riskloom.operators.predicates import risk_bucket
from riskloom.operators.topk import (
    cosine_neighbors,
    rank_top_k_risk,
    similar_by_score,
    top_features_per_row,
)

FEW_CHANGES = 10


def risk_summary_text(label: Column, score: Column, features: Column, n: int = 3) -> Column:
    """A sentence naming the ``n`` strongest factors.

    ``features`` is an array of structs with ``feature, value, attribution``,
    strongest first. Values are printed with two decimals.
    """
    parts = F.transform(
        F.slice(features, 1, n),
        lambda f: F.format_string(
            "%s %s = %s (%s)",
            F.when(f["attribution"] > 0, "high").otherwise("low"),
            f["feature"],
            fixed(f["value"], 2),
            fixed(f["attribution"], 3, "+"),
        ),
    )
    factors = F.when(
        F.size(F.coalesce(parts, F.array())) > 0, F.array_join(parts, "; ")
    ).otherwise("nothing stands out")
    return F.concat(label, F.lit(" risk, score "), fixed(score, 2), F.lit("; driven by "), factors, F.lit("."))


def strongest_features(attributions: DataFrame, ids: Sequence[str], k: int = 5) -> DataFrame:
    """An array of each row's ``k`` strongest features (at most ``k`` structs)."""
    top = top_features_per_row(attributions, ids, k)
    ordered = F.array_sort(
        F.collect_list(F.struct("feature_rank", "feature", "value", "attribution", "direction"))
    )
    return top.groupBy(*ids).agg(ordered.alias("top_features"))


def report_rows(
    scored: DataFrame,
    attributions: DataFrame,
    k: int = 20,
    ids: str = "id",
    details: Sequence[str] = (),
) -> DataFrame:
    """Ranked report rows with bucket, strongest features and row details."""
    kept = scored.select(ids, "score", *details)
    top = kept.orderBy(F.desc("score"), F.asc(ids)).limit(k)
    bucketed = top.withColumn("risk_label", risk_bucket(F.col("score")))
    ranked = rank_top_k_risk(bucketed, k, "score", ids)
    wanted = attributions.join(F.broadcast(ranked.select(ids)), ids, "left_semi")
    return ranked.join(strongest_features(wanted, [ids]), ids, "left")


def risk_report(
    scored: DataFrame,
    rows: DataFrame,
    change_count: Column,
    threshold: float,
    model_used: str,
    model_auc: Column,
    report_id: str,
    wanted_model: str | None = None,
) -> DataFrame:
    """One nested row: totals, ranked rows, model and warnings.

    ``wanted_model`` is the model the caller asked for; the report warns if another one was used.
    """
    totals = scored.agg(
        F.count(F.lit(1)).alias("total_files_analyzed"),
        F.count_if(F.col("score") >= F.lit(float(threshold))).alias("buggy_files_predicted"),
    )
    ranked = rows.agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in rows.columns if c != "rank"])))).scalar()
    counted = totals.withColumn("__changes", change_count)
    notes = F.array(
        F.when(F.col("__changes") < FEW_CHANGES, F.lit("Few changes found; results may be unreliable.")),
        F.when(F.col("buggy_files_predicted") == 0, F.lit("No file is above the threshold.")),
        F.lit("Vectors unavailable - using the tabular model." if wanted_model not in (None, model_used) else None).cast("string"),
    )
    return counted.select(
        F.lit(report_id).alias("report_id"),
        F.lit("completed").alias("status"),
        F.lit(model_used).alias("model_used"),
        F.round(model_auc, 4).alias("model_auc"),
        "total_files_analyzed",
        "buggy_files_predicted",
        ranked.alias("top_k_results"),
        F.filter(notes, lambda n: n.isNotNull()).alias("warnings"),
    )


def file_explanation(
    rows: DataFrame, vectors: DataFrame | None = None, ids: str = "id", n: int = 3
) -> DataFrame:
    """Per report row: waterfall, summary, rows with a similar score, neighbours."""
    base = rows.select(
        ids,
        "rank",
        "score",
        "risk_label",
        F.col("top_features").alias("waterfall"),
        risk_summary_text(F.col("risk_label"), F.col("score"), F.col("top_features")).alias("summary"),
    )
    ranked = rows.select(ids, "rank", "score")
    result = base.join(similar_by_score(ranked, n, ids).drop("rank"), ids, "left")
    if vectors is None:
        return result.withColumn("neighbors", F.array().cast("array<string>"))
    return result.join(cosine_neighbors(ranked, vectors, n, ids).drop("rank"), ids, "left")
