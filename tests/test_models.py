from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import attribution, explain, isotonic, runs, training
from riskloom.plans import flows

FEATURES = ["a", "b", "c"]
PARAMS = training.TreeParams(n_estimators=4, max_depth=3, learning_rate=0.3, min_child_weight=1)


@pytest.fixture(scope="module")
def matrix(spark):
    i = F.col("id")
    return spark.range(400).select(
        i.cast("string").alias("file_path"),
        (i % 17).cast("double").alias("a"),
        F.when(i % 5 != 0, (i % 23).cast("double")).alias("b"),
        (i % 3).cast("double").alias("c"),
        ((i % 17 > 8) | (i % 23 > 18)).cast("int").alias("is_buggy"),
    )


def test_tree_contributions_add_up_to_the_margin(spark, matrix):
    model = training.train_boosted_trees(matrix, FEATURES, PARAMS)
    long = attribution.tree_attributions(matrix, model, FEATURES, ["file_path"])
    sums = long.groupBy("file_path", "base_value").agg(F.sum("attribution").alias("s"))
    margins = model.transform(training.assemble(matrix, FEATURES)).select(
        "file_path", vector_to_array("rawPrediction")[1].alias("margin")
    )
    worst = sums.join(margins, "file_path").agg(
        F.max(F.abs(F.col("base_value") + F.col("s") - F.col("margin"))), F.count("*")
    ).first()
    assert worst[0] < 1e-9 and worst[1] == 400
    # A missing input stays missing in the report.
    assert long.filter("feature = 'b' and value is null").count() == 80


def test_saved_model_scores_the_same(spark, matrix, tmp_path):
    path = str(tmp_path / "model")
    model = training.refit_final(matrix, FEATURES, PARAMS, 3, path)
    loaded, names = training.load_model(spark, path)
    assert names == FEATURES
    ours = training.score_batch(model, matrix, names).select("file_path", F.col("score").alias("s1"))
    theirs = training.score_batch(loaded, matrix, names).select("file_path", F.col("score").alias("s2"))
    assert ours.join(theirs, "file_path").filter("s1 != s2 or s1 < 0 or s1 > 1").count() == 0


def test_linear_attributions_sum_to_score_minus_base(matrix):
    weights = {"a": 2.0, "b": -1.0}
    long = attribution.linear_attributions(matrix, weights, ["file_path"], intercept=0.5)
    score = long.groupBy("file_path", "base_value").agg(
        F.sum("attribution").alias("s"),
        F.max(F.when(F.col("feature") == "a", F.col("value"))).alias("a"),
        F.max(F.when(F.col("feature") == "b", F.col("value"))).alias("b"),
    )
    wrong = score.filter("b is not null").filter(
        F.abs(F.col("base_value") + F.col("s") - (0.5 + 2 * F.col("a") - F.col("b"))) > 1e-9
    )
    assert wrong.count() == 0


def test_isotonic_calibration_is_monotone(spark):
    rows = [(i, int(i % 7 > 3), i / 100) for i in range(100)]
    scored = spark.createDataFrame(rows, "id long, y int, score double")
    got = isotonic.calibrate_isotonic(scored, scored).orderBy("score").collect()
    values = [r["calibrated"] for r in got]
    assert values == sorted(values)


def test_summary_text(spark):
    df = spark.sql(
        "select 'HIGH' as l, 0.84D as s, array(named_struct('feature', 'churn', 'value', 18.0D, 'attribution', 0.5D), "
        "named_struct('feature', 'age', 'value', 2.0D, 'attribution', -0.25D)) as f, "
        "cast(array() as array<struct<feature:string,value:double,attribution:double>>) as none"
    )
    row = df.select(
        explain.risk_summary_text(F.col("l"), F.col("s"), F.col("f")),
        explain.risk_summary_text(F.col("l"), F.col("s"), F.col("none")),
    ).first()
    assert row[0] == (
        "HIGH risk, score 0.84; driven by high churn = 18.00 (+0.500); low age = 2.00 (-0.250)."
    )
    assert "nothing stands out" in row[1]


def test_numbers_are_printed_as_c_prints_them(spark):
    from riskloom.functions.text import fixed

    values = [i / 1000 + 0.0005 * j for i in range(-1300, 1300, 7) for j in (0, 1)] + [0.125, 0.375, 0.145, 0.585, 2.675, 1e-9, -1e-9, 0.0, 12345.675, 3e9 + 0.125]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for r in df.select("v", fixed(F.col("v"), 2).alias("two"), fixed(F.col("v"), 3, "+").alias("three")).collect():
        if r["v"] is not None:
            assert (r["two"], r["three"]) == (f"{r['v']:.2f}", f"{r['v']:+.3f}")


def test_run_log_appends(spark, tmp_path):
    path = str(tmp_path / "runs")
    for name, auc in (("one", 0.7), ("two", 0.8)):
        rows = runs.run_rows(spark, name, "exp", name, {"n_features": 3}, {"AUC": auc})
        log = runs.log_run(rows, path)
    board = runs.run_leaderboard(runs.metrics_wide(log)).collect()
    assert [(r["run_name"], r["auc"], r["n_features"]) for r in board] == [("two", 0.8, 3), ("one", 0.7, 3)]


def test_report_flow_on_a_small_log(spark):
    start = datetime(2023, 1, 1)
    rows = [
        ("r", f"f{f}.py", f"c{f}-{n}", start + timedelta(days=n * 7 + f), f"d{n % 3}@e.org", (n + f) % 3 == 0, 10 * n, f"def g():\n    return {n}\n")
        for f in range(8)
        for n in range(40)
    ]
    log = spark.createDataFrame(
        rows,
        "repo_name string, file_path string, commit_hash string, commit_date timestamp_ntz, author_email string, is_bug_fix boolean, lines_changed long, source_code string",
    )
    ready, names = flows.training_matrix(flows.windowed_matrix(log), {}, 0.9, ["repo_name", "file_path", "window_no"])
    assert "fix_density" in names and "num_functions" in names and "bug_fix_count_90d" not in names
    model = training.train_boosted_trees(ready, names, PARAMS)
    report, ranked = flows.analyze(log, model, names, datetime(2023, 9, 1), top_k=5, wanted_model="hybrid")
    row = report.first()
    assert row["total_files_analyzed"] == 8 and len(row["top_k_results"]) == 5
    assert [r["rank"] for r in row["top_k_results"]] == [1, 2, 3, 4, 5]
    assert "Vectors unavailable - using the tabular model." in row["warnings"]
    assert all(len(r["top_features"]) == 5 for r in ranked.collect())
