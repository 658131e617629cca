"""Isotonic calibration against the plain pooling of one sorted list."""

from __future__ import annotations

import numpy as np
import pytest

from riskloom.operators.isotonic import apply_blocks, calibrate_isotonic, isotonic_blocks


def plain_blocks(rows):
    sums = {}
    for score, y in rows:
        p, n = sums.get(score, (0, 0))
        sums[score] = p + y, n + 1
    stack = []
    for score in sorted(sums):
        lo, hi, (p, n) = score, score, sums[score]
        while stack and stack[-1][2] * n >= p * stack[-1][3]:
            lo, _, p0, n0 = stack.pop()
            p, n = p + p0, n + n0
        stack.append((lo, hi, p, n))
    return stack


def plain_value(blocks, score):
    knots = [(x, p / n) for lo, hi, p, n in blocks for x in (lo, hi)]
    return float(np.interp(score, [x for x, _ in knots], [v for _, v in knots]))


def cases():
    rng = np.random.default_rng(11)
    noisy = [(round(float(s), 3), int(rng.random() < s)) for s in rng.random(3000)]
    falling = [(float(s), int(s < 500)) for s in range(1000)]
    rising = [(float(s), int(s >= 500)) for s in range(1000)]
    # A low end that pools everything before it.
    undone = [(float(s), int(i < s // 100)) for s in range(900) for i in range(10)] + [(1000.0, 0)] * 4000
    ties = [(0.5, i % 3 == 0) for i in range(700)] + [(0.25, 1)] * 3 + [(0.75, 0)] * 2
    return {"noisy": noisy, "falling": falling, "rising": rising, "undone": undone, "ties": [(s, int(y)) for s, y in ties]}


@pytest.mark.parametrize("range_rows", [7, 200_000])
@pytest.mark.parametrize("name", cases())
def test_blocks_are_the_plain_ones(spark, name, range_rows):
    rows = cases()[name]
    if name == "undone" and range_rows == 7:
        range_rows = 60
    df = spark.createDataFrame(rows, "score double, y int").repartition(5)
    got = sorted(tuple(r) for r in isotonic_blocks(df, range_rows).collect())
    assert got == plain_blocks(rows)


def test_values_between_and_beyond_blocks(spark):
    rows = cases()["noisy"]
    asked = [(i, s) for i, s in enumerate([-1.0, 0.0, 0.1234567, 0.5, 0.99999, 2.0, None, float("nan"), 0.5])]
    df = spark.createDataFrame(asked, "id int, score double")
    blocks = plain_blocks(rows)
    fitted = spark.createDataFrame(blocks, "lo double, hi double, positives long, rows long")
    for n_ranges in (1, 3, 50):
        got = {r.id: r.calibrated for r in apply_blocks(df, fitted, n_ranges=n_ranges).collect()}
        assert len(got) == len(asked) and got[6] is None and got[7] is None
        for i, s in asked[:6]:
            assert got[i] == pytest.approx(plain_value(blocks, s), abs=1e-12)


def test_rows_without_score_or_label(spark):
    fit = spark.createDataFrame([(0.1, 0), (0.9, 1), (None, 1), (0.5, None), (float("nan"), 0)], "score double, y int")
    asked = spark.createDataFrame([(0.5,), (0.95,)], "score double")
    assert sorted(r.calibrated for r in calibrate_isotonic(fit, asked).collect()) == [pytest.approx(0.5), 1.0]
    nothing = spark.createDataFrame([], "score double, y int")
    assert [r.calibrated for r in calibrate_isotonic(nothing, asked).collect()] == [None, None]
