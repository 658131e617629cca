"""The neighbour estimate against its definition row by row."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.neighbors import digamma, neighbor_information

EULER = 0.5772156649015329


def psi(n):
    return sum(1 / i for i in range(1, int(n))) - EULER


def plain(x, y, k=3):
    known = np.isin(y, [c for c in set(y) if (y == c).sum() > 1])
    x, y = x[known], y[known]
    terms = []
    for i in range(len(x)):
        same = np.abs(np.delete(x[y == y[i]], np.flatnonzero(np.flatnonzero(y == y[i]) == i)) - x[i])
        wanted = min(k, len(same))
        r = np.sort(same)[wanted - 1]
        if r == 0:
            terms.append(psi((same == 0).sum() + 1) - psi((x == x[i]).sum()) - psi((y == y[i]).sum()))
        else:
            terms.append(psi(wanted) - psi(((x > x[i] - r) & (x < x[i] + r)).sum()) - psi((y == y[i]).sum()))
    return max(psi(len(x)) + float(np.mean(terms)), 0.0)


@pytest.mark.parametrize("n_ranges", [2, 7, 256])
def test_equal_to_the_definition(spark, n_ranges):
    rng = np.random.default_rng(2)
    y = (rng.random(2000) < 0.3).astype(int)
    columns = {
        "shifted": rng.normal(y * 2.0, 1.0), "noise": rng.normal(size=2000), "counts": rng.poisson(2 + y * 3).astype(float),
        "constant": np.full(2000, 4.0), "copy": y.astype(float), "skewed": np.round(rng.exponential(1 + y) ** 3, 2),
    }
    rows = [(int(y[i]), *(float(c[i]) for c in columns.values())) for i in range(2000)]
    df = spark.createDataFrame(rows, "is_buggy int, " + ", ".join(f"{c} double" for c in columns))
    got = {r.feature: r.information for r in neighbor_information(df, list(columns), n_ranges=n_ranges).collect()}
    assert got == {c: pytest.approx(plain(x, y), abs=2e-6) for c, x in columns.items()}
    assert got["constant"] == 0 and got["shifted"] > 0.2 > got["noise"] and got["copy"] > 0.55


def test_small_classes_and_gaps(spark):
    rows = [(0, 1.0), (0, 2.0), (1, 5.0), (1, 5.5), (2, 9.0), (None, 3.0), (0, None), (1, float("nan")), (0, 2.5)]
    df = spark.createDataFrame(rows, "is_buggy int, x double")
    x, y = np.array([1.0, 2.0, 5.0, 5.5, 9.0, 2.5]), np.array([0, 0, 1, 1, 2, 0])
    assert [r.information for r in neighbor_information(df, ["x"]).collect()] == [pytest.approx(plain(x, y), abs=1e-6)]
    assert neighbor_information(df.limit(0), ["x"]).count() == 0


def test_digamma(spark):
    rows = spark.range(1, 200).select("id", digamma(F.col("id")).alias("v")).collect()
    assert all(r.v == pytest.approx(psi(r.id), abs=1e-11) for r in rows)
