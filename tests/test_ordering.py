from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions.ordering import (
    exact_quantiles,
    rank_in_groups,
    running_totals,
    scan_ranges,
    with_value_bucket,
)


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(7)
    # A hot group with heavy ties next to small groups.
    hot = pd.DataFrame({"g": "hot", "value": np.round(rng.exponential(5, 6000), 1)})
    flat = pd.DataFrame({"g": "flat", "value": 3.0}, index=range(500))
    few = pd.DataFrame({"g": "few", "value": [5.0, 1.0, 2.0, 9.0]})
    none = pd.DataFrame({"g": [None] * 3, "value": [1.0, 4.0, 2.0]})
    return pd.concat([hot, flat, few, none], ignore_index=True)


# A low accuracy forces the bracket path even on small groups.
@pytest.mark.parametrize("accuracy", [50, 1000, 100_000])
def test_exact_quantiles_match_numpy(spark, values, accuracy):
    df = spark.createDataFrame(values, "g string, value double")
    points = [0.0, 0.25, 0.5, 0.8, 0.95, 1.0]
    got = {
        (r["g"], r["probability"]): r["quantile"]
        for r in exact_quantiles(df, ["g"], points, accuracy=accuracy).collect()
    }
    for group, part in values.groupby("g", dropna=False):
        key = None if pd.isna(group) else group
        for p in points:
            assert got[(key, p)] == pytest.approx(np.quantile(part["value"], p), abs=1e-9)


@pytest.mark.parametrize("accuracy", [50, 100_000])
def test_discrete_quantiles(spark, values, accuracy):
    df = spark.createDataFrame(values, "g string, value double")
    got = exact_quantiles(df, [], [0.1, 0.5, 0.9], mode="disc", accuracy=accuracy).collect()
    ordered = np.sort(values["value"].to_numpy())
    for row in got:
        rank = max(int(np.ceil(row["probability"] * len(ordered))), 1)
        assert row["quantile"] == ordered[rank - 1]


def test_rank_in_groups_is_a_full_row_number(spark, values):
    frame = values.reset_index(names="id")
    df = spark.createDataFrame(frame, "id long, g string, value double")
    ranked = rank_in_groups(df, ["g"], [F.col("value")], [F.col("id")], "r").toPandas()
    assert len(ranked) == len(frame)
    for _, part in ranked.groupby("g", dropna=False):
        ordered = part.sort_values(["value", "id"])
        assert list(ordered["r"]) == list(range(1, len(part) + 1))


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(spark, values, descending):
    frame = values.groupby("value").size().rename("n").reset_index()
    df = spark.createDataFrame(frame, "value double, n long")
    got = running_totals(df, "value", ["n"], descending, n_buckets=8).toPandas()
    got = got.sort_values("value", ascending=not descending)
    assert list(got["cum_n"]) == list(got["n"].cumsum())


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals_over_several_levels(spark, descending):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"value": np.unique(rng.exponential(2, 3000) ** 4), "n": 1}).assign(n=lambda f: rng.integers(0, 9, len(f)))
    df = spark.createDataFrame(frame.sample(frac=1, random_state=1), "value double, n long")
    tagged, levels = scan_ranges(df, "value", 8, bucket_rows=4)
    sizes = tagged.groupBy(*levels).count().toPandas()["count"]
    assert len(levels) > 2 and sizes.max() <= 4 and sizes.sum() == len(frame)
    got = running_totals(df, "value", ["n"], descending, n_buckets=8, bucket_rows=4).toPandas()
    got = got.sort_values("value", ascending=not descending)
    assert list(got["cum_n"]) == list(got["n"].cumsum())


def test_running_totals_of_null_and_nan(spark):
    df = spark.createDataFrame([(None, 1), (float("nan"), 2), *[(float(i), 1) for i in range(40)]], "value double, n long")
    got = {r.value: r.cum_n for r in running_totals(df, "value", ["n"], False, n_buckets=4, bucket_rows=4).collect() if r.value in range(40)}
    assert len({r.value is None for r in running_totals(df, "value", ["n"], False).collect()}) == 2
    assert sorted(got.values()) == [got[0.0] + i for i in range(40)]


def test_buckets_keep_order(spark, values):
    df = spark.createDataFrame(values, "g string, value double")
    spans = (
        with_value_bucket(df, "value", "b", 16)
        .groupBy("b")
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        .orderBy("b")
        .collect()
    )
    assert all(a["hi"] < b["lo"] for a, b in zip(spans, spans[1:]))


def test_one_value_needs_no_buckets(spark):
    df = spark.createDataFrame([(None,), (None,)], "value double")
    assert with_value_bucket(df, "value", "b").select("b").distinct().count() == 1


def test_rows_of_few_groups_stay_where_they_are(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, "f").otherwise("g").alias("feature"), F.col("id").cast("double").alias("value"))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
        medians = exact_quantiles(rows, ["feature"], [0.5])
        plan = medians._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(tuple(r) for r in medians.collect()) == [("f", 0.5, 99_999.0), ("g", 0.5, 100_000.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
