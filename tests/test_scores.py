from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics


def scored(spark, rows):
    return spark.createDataFrame([(i, y, s) for i, (y, s) in enumerate(rows)], "id long, y int, score double")


def brute_auc(rows):
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def brute_ap(rows):
    total, tp, seen, area = sum(y for y, _ in rows), 0, 0, 0.0
    for cut in sorted({s for _, s in rows}, reverse=True):
        at = [y for y, s in rows if s == cut]
        tp, seen = tp + sum(at), seen + len(at)
        area += sum(at) / total * tp / seen
    return area


@pytest.mark.parametrize("seed", range(3))
def test_auc_and_ap_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(int(rng.random() < 0.3), round(rng.random(), rng.choice([1, 3]))) for _ in range(400)]
    df = scored(spark, rows)
    assert metrics.auc_roc(df).first()[0] == pytest.approx(brute_auc(rows), abs=1e-6)
    assert metrics.average_precision(df).first()[0] == pytest.approx(brute_ap(rows), abs=1e-6)
    flipped = df.withColumn("score", 1 - F.col("score"))
    assert metrics.auc_roc(flipped).first()[0] == pytest.approx(1 - brute_auc(rows), abs=2e-6)


def test_all_scores_tied(spark):
    df = scored(spark, [(1, 0.5), (0, 0.5), (0, 0.5), (1, 0.5)])
    assert metrics.auc_roc(df).first()[0] == 0.5
    assert metrics.average_precision(df).first()[0] == 0.5


def test_one_class_only(spark):
    df = scored(spark, [(0, 0.1), (0, 0.9)])
    assert metrics.auc_roc(df).first()[0] == 0.0
    assert metrics.average_precision(df).first()[0] == 0.0
    row = metrics.prf_at_threshold(df).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_precision_at_k_clamps_and_table_skips(spark):
    df = scored(spark, [(1, 0.9), (0, 0.8), (1, 0.7)])
    assert metrics.precision_at_k(df, 20).first()[0] == pytest.approx(2 / 3, abs=1e-6)
    assert metrics.precision_at_k(df, 0).first()[0] == 0.0
    assert [r["k"] for r in metrics.pr_table_at_k(df, [1, 3, 5]).collect()] == [1, 3]


def test_threshold_grid(spark):
    df = scored(spark, [(1, 0.29), (0, 0.28), (1, 0.57), (0, 0.96), (0, 0.01)])
    sweep = {r["threshold"]: r for r in metrics.threshold_sweep(df).collect()}
    assert len(sweep) == 90
    for t, row in sweep.items():
        rows = [(1, 0.29), (0, 0.28), (1, 0.57), (0, 0.96), (0, 0.01)]
        hits = [y for y, s in rows if s >= t]
        assert row["recall"] == pytest.approx(sum(hits) / 2, abs=1e-6)
        assert row["precision"] == pytest.approx(sum(hits) / len(hits) if hits else 0, abs=1e-6)
    # Two thirds precision is first reached just above 0.28.
    assert metrics.best_threshold(df).first()[0] == 0.29


def test_a_hair_below_a_grid_point_does_not_reach_it(spark):
    rows = [(1, t / 100.0 - d) for t in (29, 57, 58) for d in (0.0, 1e-12)]
    sweep = {r["threshold"]: r["recall"] for r in metrics.threshold_sweep(scored(spark, rows)).collect()}
    for t in (0.28, 0.29, 0.57, 0.58, 0.59):
        assert sweep[t] == pytest.approx(sum(s >= t for _, s in rows) / 6, abs=1e-6)


def test_best_threshold_decides_on_exact_recall(spark):
    rows = [(1, 0.9)] * 3999 + [(1, 0.1)] * 6001 + [(0, 0.1)]
    assert metrics.best_threshold(scored(spark, rows)).first()[0] == 0.05


def test_best_threshold_without_any_positive(spark):
    assert metrics.best_threshold(scored(spark, [(0, 0.2), (0, 0.7)])).first()[0] == 0.5


def test_calibration_bins_are_right_closed(spark):
    df = scored(spark, [(1, 0.1), (0, 0.1000001), (1, 0.0), (1, 1.0)])
    got = {r["bin"]: r["rows"] for r in metrics.calibration_bins(df).collect()}
    assert got == {0: 2, 1: 1, 9: 1}
