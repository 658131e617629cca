"""Distinct keys, ranked reports and nearest rows of a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_REPORT_ROWS = 200


def distinct_pairs(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct keys that later, heavier steps have to run for."""
    return labels.select(*keys).distinct()


def rank_top_k_risk(scored: DataFrame, k: int, score: str = "score", tie_break: str = "id") -> DataFrame:
    """Top ``k`` rows by score, ranked from 1, score rounded to 4 places.

    The limit runs first (top-k per task, then merged); the ranking window sees
    at most ``MAX_REPORT_ROWS`` rows.
    """
    if not 1 <= k <= MAX_REPORT_ROWS:
        raise ValueError(f"k must be between 1 and {MAX_REPORT_ROWS}")
    order = [F.desc(score), F.asc(tie_break)]
    top = scored.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn(
        score, F.round(score, 4)
    )


def top_features_per_row(
    attributions: DataFrame, ids: Sequence[str] = ("id",), k: int = 5
) -> DataFrame:
    """The ``k`` largest absolute attributions of each row, with a direction."""
    order = Window.partitionBy(*ids).orderBy(F.desc(F.abs("attribution")), F.asc("feature"))
    return (
        attributions.withColumn("feature_rank", F.row_number().over(order))
        .filter(F.col("feature_rank") <= k)
        .withColumns(
            {
                "direction": F.when(F.col("attribution") > 0, "increases_risk").otherwise(
                    "decreases_risk"
                ),
                "attribution": F.round("attribution", 6),
                "value": F.round("value", 4),
            }
        )
    )


def as_report(ranked: DataFrame, ids: str = "id", extra: Sequence[str] = ()) -> DataFrame:
    """One row holding the ranked rows as an array (at most ``MAX_REPORT_ROWS``)."""
    return ranked.agg(
        F.array_sort(F.collect_list(F.struct("rank", ids, "score", *extra))).alias("rows")
    )


def _nearest(rows: Column, this: Column, distance, n: int, id_name: str) -> Column:
    """Ids of the ``n`` closest other rows of a report; report order breaks ties."""
    others = F.filter(rows, lambda o: o["rank"] != this["rank"])
    keyed = F.array_sort(
        F.transform(
            others,
            lambda o: F.struct(
                distance(this, o).alias("d"), o["rank"].alias("r"), o[id_name].alias("i")
            ),
        )
    )
    kept = F.filter(keyed, lambda s: s["d"].isNotNull())
    return F.transform(F.slice(kept, 1, n), lambda s: s["i"])


def similar_by_score(ranked: DataFrame, n: int = 3, ids: str = "id") -> DataFrame:
    """For each report row, the other rows with the nearest score."""
    report = as_report(ranked, ids)
    nearest = _nearest(
        F.col("rows"), F.col("this"), lambda a, b: F.abs(a["score"] - b["score"]), n, ids
    )
    return report.select("rows", F.explode("rows").alias("this")).select(
        F.col(f"this.{ids}").alias(ids), "this.rank", nearest.alias("similar")
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def cosine_neighbors(ranked: DataFrame, vectors: DataFrame, n: int = 3, ids: str = "id") -> DataFrame:
    """For each report row, the nearest other rows by vector.

    Rows without a vector, or with a zero vector, neither have nor are neighbours.
    """
    with_vectors = ranked.join(vectors.select(ids, "embedding"), ids, "left").withColumn(
        "embedding", F.when(F.exists("embedding", lambda x: x != 0), F.col("embedding"))
    )
    report = as_report(with_vectors, ids, extra=["embedding"])

    def distance(a, b):
        usable = a["embedding"].isNotNull() & b["embedding"].isNotNull()
        return F.when(usable, -F.round(cosine(a["embedding"], b["embedding"]), 9))

    nearest = _nearest(F.col("rows"), F.col("this"), distance, n, ids)
    return report.select("rows", F.explode("rows").alias("this")).select(
        F.col(f"this.{ids}").alias(ids), "this.rank", nearest.alias("neighbors")
    )


def top_churned_files(log: DataFrame, k: int = 10) -> DataFrame:
    """Files with the most distinct changes, and how many of those were fixes."""
    per_change = log.groupBy("repo_name", "file_path", "commit_hash").agg(
        F.max(F.col("is_bug_fix").cast("bigint")).alias("fix")
    )
    per_file = per_change.groupBy("repo_name", "file_path").agg(
        F.count("commit_hash").alias("changes"),
        F.sum(F.when(F.col("commit_hash").isNotNull(), F.col("fix"))).alias("fix_changes"),
    )
    return per_file.orderBy(F.desc("changes"), "repo_name", "file_path").limit(k)


def top_variance_features(df: DataFrame, features: Sequence[str], k: int = 5) -> DataFrame:
    """Features with the largest sample variance, from one pass."""
    variances = df.agg(*[F.var_samp(c).alias(c) for c in features])
    rows = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.round(c, 6).alias("variance")) for c in features]
    )
    return (
        variances.select(F.inline(rows))
        .orderBy(F.desc_nulls_last("variance"), "feature")
        .limit(k)
    )


def recent_reports(reports: DataFrame, n: int = 10, created: str = "created_at", tie_break: str = "report_id") -> DataFrame:
    return reports.orderBy(F.desc(created), F.desc(tie_break)).limit(n)
