"""End-to-end flows over a change log: matrix, training matrix, model and report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import line_count
from riskloom.functions.timing import plus_days
from riskloom.operators import (
    attribution,
    cleaning,
    explain,
    joins,
    labels,
    metrics,
    process,
    splits,
    structure,
    training,
)
from riskloom.operators.history import store_history
from riskloom.operators.predicates import align_features
from riskloom.schema import LEAKY_FOR_MATRIX, feature_columns, nan_to_null
from riskloom.session import fresh_path
from riskloom.sources.snapshots import latest_source_snapshot
from riskloom.sources.tables import write_table

FILE_KEYS = ["repo_name", "file_path"]
ROW_KEYS = [*FILE_KEYS, "window_no"]


def windowed_matrix(log: DataFrame, window_days: int = 90, horizon_days: int = 90) -> DataFrame:
    """Windowed labels with activity and structure as of each window end."""
    past = store_history(log, "source_code", shapes=True)
    marked = labels.windowed_labels(past.changes, window_days, horizon_days, span=past.span)
    marked = marked.withColumn("is_buggy", F.col("is_buggy").cast("int"))
    activity = process.process_features(
        marked, past.changes, past.span, window_days, ["is_buggy", "commits_in_window"]
    )
    activity = write_table(activity, fresh_path(log.sparkSession, "activity"))
    # One text of each tree is parsed and never meets the rows: both sides know the tree's digest.
    found = joins.source_digest_as_of(activity.select(*FILE_KEYS, "window_end"), past, carry=["shape"])
    found = write_table(found, fresh_path(log.sparkSession, "source-digests"))
    shapes = joins.rename_structure_columns(structure.structure_by_digest(found, past.shapes(found), missing="zero"))
    keys = [*FILE_KEYS, "window_end"]
    return activity.join(shapes.drop("digest"), keys, "left")


def training_matrix(
    matrix: DataFrame,
    caps: Mapping[str, float] | None = None,
    default_cap: float | None = None,
    ids: Sequence[str] = ("file_path",),
) -> tuple[DataFrame, list[str]]:
    """Event date, no leaky columns, labels capped if asked for, no gaps; with the feature names.

    NaN is a gap like null.
    """
    dated = nan_to_null(joins.choose_event_date(matrix))
    kept = cleaning.drop_leaky_columns(dated, LEAKY_FOR_MATRIX)
    features = feature_columns(kept, extra_drop=[*ids, "window_start", "window_no"])
    capped = labels.cap_positive_rate(kept, caps, default_cap, ids)
    if capped is not kept:
        # Medians and fill read it several times.
        capped = write_table(capped, fresh_path(matrix.sparkSession, "capped"))
    filled = cleaning.impute_group_median(capped, features)
    return filled, features


@dataclass(frozen=True)
class Trained:
    """A fitted model with its out-of-fold scores and fold metrics."""

    model: GBTClassificationModel
    features: list[str]
    oof: DataFrame
    folds: DataFrame
    threshold: float
    path: str


def train(
    matrix: DataFrame,
    features: Sequence[str],
    params: training.TreeParams,
    path: str,
    ids: Sequence[str] = ("file_path",),
    k: int = splits.FOLDS,
) -> Trained:
    """Cross-validated scores, then a refit on all rows with the mean tree count."""
    names = [c for c in features if c in cleaning.drop_sparse_columns(matrix, features).columns]
    folded = splits.stratified_kfold(matrix, list(ids), splits.text_hash(*ids), k=k)
    oof, folds, trees = training.cv_oof_scores(folded, names, params, list(ids), k)
    model = training.refit_final(matrix, names, params, trees, path)
    threshold = folds.agg(F.avg("best_threshold")).first()[0]
    return Trained(model, names, oof, folds, threshold, path)


def evaluation_tables(oof: DataFrame, threshold: float) -> dict[str, DataFrame]:
    """Every metric table of the out-of-fold scores."""
    row = F.concat_ws("|", *[c for c in ROW_KEYS if c in oof.columns])
    scored = oof.select(
        row.alias("id"), F.col("is_buggy").alias("y"), F.col("oof_prob").alias("score")
    )
    return {
        "summary": metrics.evaluate(scored, threshold),
        "classes": metrics.classification_report(scored, threshold),
        "top_k": metrics.pr_table_at_k(scored),
        "roc": metrics.roc_points(scored),
        "pr": metrics.pr_points(scored),
        "calibration": metrics.calibration_bins(scored),
        "thresholds": metrics.threshold_sweep(scored),
    }


def analyze(
    log: DataFrame,
    model: GBTClassificationModel,
    features: Sequence[str],
    ref: datetime,
    since_days: int = 365,
    top_k: int = 20,
    threshold: float = 0.5,
    report_id: str = "report-1",
    model_auc: float | None = None,
    vectors: DataFrame | None = None,
    vector_names: Sequence[str] = (),
    wanted_model: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """On-demand report as of ``ref``: the nested report and its ranked rows.

    ``log`` is read several times, so it should be a stored table.
    With ``vectors`` (an ``embedding`` per file) and a name for each of its dimensions,
    ``model`` is one fitted on ``features`` and vectors together; a file without a
    vector counts as zeros. Contributions then name vector dimensions too.
    """
    spark = log.sparkSession
    past = log.filter(F.col("commit_date") <= F.lit(ref).cast("timestamp_ntz"))
    sources = write_table(latest_source_snapshot(past), fresh_path(spark, "newest-sources"))
    activity = process.process_report(sources, past, ref, since_days)
    # Lines are counted before the joins, which no text has to pass then.
    counted = sources.withColumn("lines_of_code", line_count(F.col("source_code")))
    shapes = joins.rename_structure_columns(
        structure.structure_for(counted, variant="tree", missing="zero")
    )
    files = write_table(
        activity.join(shapes.drop("source_code"), FILE_KEYS),
        fresh_path(spark, "report-features"),
    )
    aligned = align_features(files, features, keep=FILE_KEYS)
    names = list(features)
    if vectors is not None:
        aligned = joins.widened_vectors(aligned, vectors, FILE_KEYS, features, vector_names)
        names += vector_names
    scores = training.score_batch(model, aligned, names).select(*FILE_KEYS, "score")
    ident = F.concat_ws("/", *FILE_KEYS)
    details = files.select(
        *FILE_KEYS,
        "lines_of_code",
        "ast_cyclomatic_complexity",
        F.col("days_since_last_change").alias("last_modified_days_ago"),
    )
    stored = write_table(
        scores.join(details, FILE_KEYS).withColumn("id", ident), fresh_path(spark, "report-scores")
    )
    # Contributions are computed for the report's rows only.
    top = stored.orderBy(F.desc("score"), "id").limit(top_k).select(*FILE_KEYS)
    chosen = aligned.join(F.broadcast(top), FILE_KEYS, "left_semi").withColumn("id", ident)
    long = attribution.tree_attributions(chosen, model, names, ["id"])
    rows = write_table(
        explain.report_rows(
            stored,
            long,
            top_k,
            details=[
                "file_path",
                "lines_of_code",
                "ast_cyclomatic_complexity",
                "last_modified_days_ago",
            ],
        ),
        fresh_path(spark, "report-rows"),
    )
    recent = past.filter(
        F.col("commit_date") >= plus_days(F.lit(ref).cast("timestamp_ntz"), -since_days)
    )
    changes = recent.limit(explain.FEW_CHANGES).agg(F.count(F.lit(1))).scalar()
    used = "baseline" if vectors is None else "hybrid"
    report = explain.risk_report(
        stored, rows, changes, threshold, used, F.lit(model_auc).cast("double"), report_id, wanted_model
    )
    return report, rows
