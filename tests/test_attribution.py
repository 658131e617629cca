"""Shapley values of trees against their definition over all subsets of features."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest

from riskloom.operators import attribution
from riskloom.operators.attribution import ensemble_leaves, leaf_contributions, shapley_attributions


def random_tree(rng, tree, n_features, depth):
    rows = []

    def grow(cover, level):
        at = len(rows)
        rows.append(None)
        if level == depth or (level and rng.random() < 0.2):
            rows[at] = (tree, at, float(rng.normal()), cover, -1, -1, -1, 0.0)
        else:
            share = float(rng.uniform(0.1, 0.9))
            feature, cut = int(rng.integers(n_features)), float(rng.integers(0, 10))
            left = grow(cover * share, level + 1)
            right = grow(cover * (1 - share), level + 1)
            rows[at] = (tree, at, 0.0, cover, left, right, feature, cut)
        return at

    grow(100.0, 0)
    return rows


def forest(rng, n_trees, n_features, depth):
    rows = [r for t in range(n_trees) for r in random_tree(rng, t, n_features, depth)]
    return pd.DataFrame(rows, columns=["tree", "id", "prediction", "cover", "left", "right", "feature", "threshold"])


def expected(nodes, x, known):
    def walk(at):
        _, _, prediction, cover, left, right, feature, cut = nodes[at]
        if left < 0:
            return prediction
        if feature in known:
            return walk(left if x[feature] <= cut else right)
        return (nodes[left][3] * walk(left) + nodes[right][3] * walk(right)) / cover

    return walk(0)


def brute(table, weights, x):
    out = np.zeros(len(x))
    used = sorted({int(f) for f in table["feature"] if f >= 0})
    m = len(used)
    for (_, part), weight in zip(table.groupby("tree"), weights, strict=True):
        nodes = [(int(t), int(i), p, c, int(a), int(b), int(f), cut) for t, i, p, c, a, b, f, cut in part.itertuples(index=False)]
        for f in used:
            rest = [u for u in used if u != f]
            for size in range(m):
                share = factorial(size) * factorial(m - size - 1) / factorial(m)
                for known in combinations(rest, size):
                    out[f] += weight * share * (expected(nodes, x, {*known, f}) - expected(nodes, x, set(known)))
    return out


@pytest.mark.parametrize("patterns", [attribution.PATTERN_FEATURES, 0])
@pytest.mark.parametrize("seed", range(6))
def test_equal_to_all_subsets(seed, patterns, monkeypatch):
    monkeypatch.setattr(attribution, "PATTERN_FEATURES", patterns)
    rng = np.random.default_rng(seed)
    table, weights = forest(rng, 3, 5, 2 + seed % 4), [1.0, 0.5, -0.25]
    leaves, base = ensemble_leaves(table, weights)
    x = rng.integers(-1, 11, (40, 5)).astype(float)
    got = leaf_contributions(x, leaves)
    for row, values in zip(x, got, strict=True):
        assert np.allclose(values, brute(table, weights, row))
    everything = [
        sum(
            w * expected([(0, 0, p, c, int(a), int(b), int(f), cut) for _, _, p, c, a, b, f, cut in part.itertuples(index=False)], row, set(range(5)))
            for (_, part), w in zip(table.groupby("tree"), weights, strict=True)
        )
        for row in x
    ]
    assert np.allclose(base + got.sum(axis=1), everything)


def test_long_paths_sum_to_the_margin():
    # A chain that asks 14 features once each.
    rows, cover = [], 2.0**15
    for f in range(14):
        rows.append((0, 2 * f, 0.0, cover, 2 * f + 1, 2 * f + 2, f, 0.5))
        rows.append((0, 2 * f + 1, float(f), cover / 4, -1, -1, -1, 0.0))
        cover *= 0.75
    rows.append((0, 28, 20.0, cover, -1, -1, -1, 0.0))
    table = pd.DataFrame(rows, columns=["tree", "id", "prediction", "cover", "left", "right", "feature", "threshold"])
    leaves, base = ensemble_leaves(table, [1.0])
    assert {leaf.table is None for leaf in leaves} == {True, False}
    x = (np.random.default_rng(0).random((200, 14)) < 0.8).astype(float)
    margins = [next((f for f in range(14) if row[f] <= 0.5), 20) for row in x]
    assert np.allclose(base + leaf_contributions(x, leaves).sum(axis=1), margins)


def test_rows_with_gaps_and_a_tree_without_splits(spark):
    table = pd.DataFrame(
        [(0, 0, 0.75, 10.0, -1, -1, -1, 0.0), (1, 0, 0.0, 8.0, 1, 2, 1, 0.0), (1, 1, -1.0, 2.0, -1, -1, -1, 0.0), (1, 2, 1.0, 6.0, -1, -1, -1, 0.0)],
        columns=["tree", "id", "prediction", "cover", "left", "right", "feature", "threshold"],
    )
    rows = spark.createDataFrame([("a", 1.0, None), ("b", None, 3.0)], "k string, p double, q double")
    got = {(r.k, r.feature): (r.value, r.attribution, r.base_value) for r in shapley_attributions(rows, table, [1.0, 1.0], ["p", "q"], ["k"]).collect()}
    # A missing value counts as -1 and goes left.
    assert got == {
        ("a", "p"): (1.0, 0.0, 1.25), ("a", "q"): (None, -1.5, 1.25), ("b", "p"): (None, 0.0, 1.25), ("b", "q"): (3.0, 0.5, 1.25),
    }
