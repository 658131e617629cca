"""Exact ranking and threshold metrics for scored rows (``id, y, score``).

Everything starts from one row per distinct score. Running totals over it are
taken in score buckets, so no window runs over all scores in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.ordering import running_totals

MIN_RECALL = 0.40
TABLE_KS = (10, 20, 50, 100)
CALIBRATION_BINS = 10

# The threshold grid, in exact hundredths 0.05 .. 0.94.
GRID_LOW = 5
GRID_HIGH = 94


def score_counts(scored: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score."""
    y = F.col("y").cast("bigint")
    return scored.groupBy("score").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def score_curve(scored: DataFrame, n_buckets: int = 256) -> DataFrame:
    """Per distinct score: positives and negatives at or above it."""
    return running_totals(
        score_counts(scored), "score", ["pos", "neg"], n_buckets=n_buckets, sample=scored
    ).select("score", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"))


def class_totals(scored: DataFrame) -> Column:
    """Scalar subquery with fields ``p`` and ``n``."""
    y = F.col("y").cast("bigint")
    return scored.agg(
        F.struct(
            F.coalesce(F.sum(y), F.lit(0)).alias("p"), F.coalesce(F.sum(1 - y), F.lit(0)).alias("n")
        ).alias("s")
    ).scalar()


def curve_areas(scored: DataFrame) -> DataFrame:
    """``auc`` and ``average_precision`` from one pass over the score curve; 0 if a class is absent.

    AUC counts ties half; average precision sums recall steps times precision
    over distinct scores.
    """
    d = F.lit(1.0)
    # A positive beats the negatives below its score and ties with those at it.
    below_or_tied = F.col("neg") / 2 - F.col("fp")
    row = score_curve(scored).agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.sum(F.col("pos") * d * below_or_tied).alias("wins"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("steps"),
    )
    area = (F.col("wins") + F.col("p") * d * F.col("n")) / (F.col("p") * d * F.col("n"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return row.select(
        F.when(both, F.round(area, 6)).otherwise(0.0).alias("auc"),
        F.when(both, F.round(F.col("steps") / F.col("p"), 6)).otherwise(0.0).alias("average_precision"),
    )


def auc_roc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve."""
    return curve_areas(scored).select("auc")


def average_precision(scored: DataFrame) -> DataFrame:
    return curve_areas(scored).select("average_precision")


def _ratio(top: Column, bottom: Column) -> Column:
    """Zero when the denominator is zero."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def prf_columns(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def prf_at_threshold(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and the confusion matrix at a threshold."""
    hit = F.col("score") >= F.lit(float(threshold))
    positive = F.col("y") == 1
    row = scored.agg(
        F.count_if(hit & positive).alias("tp"),
        F.count_if(hit & ~positive).alias("fp"),
        F.count_if(~hit & positive).alias("fn"),
        F.count_if(~hit & ~positive).alias("tn"),
    )
    measures = prf_columns(F.col("tp"), F.col("fp"), F.col("fn"))
    return row.select("tp", "fp", "fn", "tn", *[F.round(m, 6).alias(n) for n, m in measures.items()])


def precision_at_k(scored: DataFrame, k: int) -> DataFrame:
    """Share of positives among the top ``k`` rows (``k`` clamped to the table)."""
    top = scored.orderBy(F.desc("score"), F.asc("id")).limit(max(k, 0))
    return top.agg(
        F.round(F.coalesce(F.avg(F.col("y").cast("double")), F.lit(0.0)), 6).alias("precision_at_k")
    )


def pr_table_at_k(scored: DataFrame, ks: Sequence[int] = TABLE_KS) -> DataFrame:
    """Precision and recall for several budgets; budgets above the table are left out."""
    totals = class_totals(scored)
    order = [F.desc("score"), F.asc("id")]
    # At most max(ks) rows are ranked, whatever the table size.
    top = scored.orderBy(*order).limit(max(ks)).withColumn(
        "rank", F.row_number().over(Window.orderBy(*order))
    )
    found = top.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("y").cast("bigint"))), F.lit(0)).alias(f"k{k}")
            for k in ks
        ]
    ).withColumn("totals", totals)
    p = F.col("totals.p")
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                F.round(F.col(f"k{k}") / F.lit(k), 6).alias("precision_at_k"),
                F.round(F.try_divide(F.col(f"k{k}"), p), 6).alias("recall_at_k"),
                F.col(f"k{k}").alias("bugs_found"),
                p.alias("total_bugs"),
            )
            for k in ks
        ]
    )
    size = F.col("totals.p") + F.col("totals.n")
    return found.select(size.alias("__n"), F.inline(rows)).filter(F.col("k") <= F.col("__n")).drop("__n")


def threshold_counts(scored: DataFrame) -> DataFrame:
    """True and false positives at every grid threshold, and all positives: t (hundredths), tp, fp, p.

    Rows are counted by the highest grid threshold they reach (at most 91
    groups), then cumulated.
    """
    # The product may be rounded to either side of a grid point; the grid value itself decides.
    near = F.floor(F.col("score") * 100).cast("int")
    reach = (
        F.when(F.col("score") >= (near + 1) / F.lit(100.0), near + 1)
        .when(F.col("score") < near / F.lit(100.0), near - 1)
        .otherwise(near)
    )
    slot = F.when(reach < GRID_LOW, F.lit(GRID_LOW - 1)).otherwise(F.least(reach, F.lit(GRID_HIGH)))
    y = F.col("y").cast("bigint")
    counts = scored.groupBy(slot.alias("t")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    grid = scored.sparkSession.range(GRID_LOW - 1, GRID_HIGH + 1, 1, 1).select(
        F.col("id").cast("int").alias("t")
    )
    full = grid.join(counts, "t", "left").na.fill(0, ["pos", "neg"])
    down = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    cum = full.select(
        "t",
        F.sum("pos").over(down).alias("tp"),
        F.sum("neg").over(down).alias("fp"),
        F.sum("pos").over(everything).alias("p"),
    )
    return cum.filter(F.col("t") >= GRID_LOW)


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """Precision, recall and F1 at every grid threshold, rounded for display."""
    measures = prf_columns(F.col("tp"), F.col("fp"), F.col("p") - F.col("tp"))
    return threshold_counts(scored).select(
        (F.col("t") / F.lit(100.0)).alias("threshold"),
        *[F.round(m, 6).alias(n) for n, m in measures.items()],
    )


def best_threshold(scored: DataFrame, min_recall: float = MIN_RECALL) -> DataFrame:
    """Highest precision with enough recall (first wins), else best F1, else 0.5."""
    # Exact values decide; they are rounded only where they are shown.
    measures = prf_columns(F.col("tp"), F.col("fp"), F.col("p") - F.col("tp"))
    sweep = threshold_counts(scored).select(
        (F.col("t") / F.lit(100.0)).alias("threshold"), *[m.alias(n) for n, m in measures.items()]
    )
    enough = (F.col("recall") >= F.lit(float(min_recall))) & (F.col("precision") > 0)
    first = -F.col("threshold")
    row = sweep.agg(
        F.max_by("threshold", F.when(enough, F.struct("precision", first))).alias("main"),
        F.max_by("threshold", F.when(F.col("f1") > 0, F.struct("f1", first))).alias("fallback"),
    )
    return row.select(F.coalesce("main", "fallback", F.lit(0.5)).alias("best_threshold"))


def best_f1_threshold(scored: DataFrame) -> DataFrame:
    sweep = threshold_sweep(scored)
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def roc_points(scored: DataFrame) -> DataFrame:
    """One ROC point per distinct score, plus the origin."""
    totals = class_totals(scored)
    points = score_curve(scored).select(
        F.col("score").alias("threshold"),
        F.round(F.try_divide(F.col("fp"), totals.getField("n")), 6).alias("fpr"),
        F.round(F.try_divide(F.col("tp"), totals.getField("p")), 6).alias("tpr"),
    )
    origin = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionAll(origin)


def pr_points(scored: DataFrame) -> DataFrame:
    """One precision-recall point per distinct score, with the prevalence baseline."""
    totals = class_totals(scored)
    p, n = totals.getField("p"), totals.getField("n")
    return score_curve(scored).select(
        F.col("score").alias("threshold"),
        F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"),
        F.round(F.try_divide(F.col("tp"), p), 6).alias("recall"),
        F.round(F.try_divide(p, p + n), 6).alias("baseline"),
    )


def calibration_bins(scored: DataFrame, bins: int = CALIBRATION_BINS) -> DataFrame:
    """Mean score and positive rate per non-empty uniform bin (right-closed)."""
    edges = [F.lit(i / bins) for i in range(1, bins)]
    number = F.size(F.filter(F.array(*edges), lambda e: e < F.col("score")))
    return scored.groupBy(number.alias("bin")).agg(
        F.round(F.avg("score"), 6).alias("mean_predicted"),
        F.round(F.avg(F.col("y").cast("double")), 6).alias("fraction_positive"),
        F.count(F.lit(1)).alias("rows"),
    )


def classification_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per class and averaged precision, recall, F1 and support."""
    base = prf_at_threshold(scored, threshold).select("tp", "fp", "fn", "tn")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    classes = {
        "Clean": (prf_columns(tn, fn, fp), tn + fp),
        "Buggy": (prf_columns(tp, fp, fn), tp + fn),
    }
    accuracy = _ratio(tp + tn, total)

    def row(name: str, p: Column, r: Column, f: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class_name"),
            F.round(p, 6).alias("precision"),
            F.round(r, 6).alias("recall"),
            F.round(f, 6).alias("f1"),
            support.alias("support"),
        )

    def average(measure: str, weighted: bool) -> Column:
        parts = [
            m[measure] * (support if weighted else F.lit(0.5)) for m, support in classes.values()
        ]
        summed = parts[0] + parts[1]
        return _ratio(summed, total) if weighted else summed

    rows = [row(n, m["precision"], m["recall"], m["f1"], s) for n, (m, s) in classes.items()]
    rows.append(row("accuracy", accuracy, accuracy, accuracy, total))
    for name, weighted in (("macro avg", False), ("weighted avg", True)):
        rows.append(row(name, *[average(m, weighted) for m in ("precision", "recall", "f1")], total))
    return base.select(F.inline(F.array(*rows)))


def evaluate(scored: DataFrame, threshold: float = 0.5, k: int = 20) -> DataFrame:
    """AUC, average precision, F1, precision, recall and precision at ``k`` as one row."""
    fixed = prf_at_threshold(scored, threshold).select("precision", "recall", "f1")
    areas = curve_areas(scored).select(F.struct("auc", "average_precision")).scalar()
    return fixed.withColumns(
        {
            "auc": areas.getField("auc"),
            "average_precision": areas.getField("average_precision"),
            "precision_at_k": precision_at_k(scored, k).scalar(),
        }
    )


def fold_summary(folds: DataFrame, metrics: Sequence[str] = ("auc", "f1", "ap")) -> DataFrame:
    """Mean and population deviation over folds, with a verdict on the mean AUC."""
    row = folds.agg(
        *[F.round(F.avg(m), 6).alias(f"mean_{m}") for m in metrics],
        *[F.round(F.stddev_pop(m), 6).alias(f"std_{m}") for m in metrics],
    )
    auc = F.col("mean_auc")
    verdict = (
        F.when(auc < 0.50, "FAIL: worse than random")
        .when(auc < 0.65, "WARN: below floor")
        .when(auc < 0.70, "WARN: below expected range")
        .otherwise("OK")
    )
    return row.withColumn("verdict", verdict)
