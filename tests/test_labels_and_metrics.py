from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.operators import labels, predicates, process, splits
from riskloom.operators.history import store_history
from riskloom.operators.labels import date_span

LOG = (
    "repo_name string, file_path string, commit_hash string, commit_date timestamp_ntz, "
    "author_email string, is_bug_fix boolean, lines_changed long"
)
REF = datetime(2024, 6, 1)


def log_of(spark, rows):
    return spark.createDataFrame(rows, LOG)


def change(day, n, author="a", fix=False, lines=10, file="f", repo="r"):
    at = day if isinstance(day, datetime) else datetime(2024, 1, 1) + timedelta(days=day)
    return (repo, file, f"c{n}", at, author, fix, lines)


def test_closed_window_ends(spark):
    micro = timedelta(microseconds=1)
    rows = [
        change(REF, 1),
        change(REF - timedelta(days=30), 2),
        change(REF - timedelta(days=90), 3),
        change(REF - timedelta(days=90) - micro, 4),
    ]
    pairs = spark.createDataFrame([("r", "f", REF)], "repo_name string, file_path string, window_end timestamp_ntz")
    row = process.process_features_pairs(pairs, store_history(log_of(spark, rows))).first()
    assert row["commit_count_30d"] == 2
    assert row["commit_count_90d"] == 3
    assert row["days_since_last_change"] == 0
    assert row["code_churn_90d"] == 30


def test_whole_days_are_elapsed_24_hours(spark):
    rows = [change(datetime(2024, 1, 1, 23), 1)]
    pairs = spark.createDataFrame(
        [("r", "f", datetime(2024, 1, 3, 1))], "repo_name string, file_path string, window_end timestamp_ntz"
    )
    assert process.process_features_pairs(pairs, store_history(log_of(spark, rows))).first()["days_since_last_change"] == 1


def _random_log(spark, seed, n=600):
    import random

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # One file holds a third of all rows; dates repeat and hit the grid exactly.
        file = "hot" if rng.random() < 0.34 else f"f{rng.randrange(25)}"
        day = rng.choice([0, 90, 180, 270, 360]) if rng.random() < 0.1 else rng.randrange(0, 500)
        hours = 0 if day % 90 == 0 else rng.randrange(24)
        at = datetime(2023, 1, 1) + timedelta(days=day, hours=hours)
        author = rng.choice(["a", "b", "c", None])
        rows.append(("r", file, f"c{rng.randrange(n // 2)}", at, author, rng.random() < 0.3, rng.randrange(50)))
    return log_of(spark, rows)


def _sorted(df):
    columns = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


@pytest.mark.parametrize("window_days", [90, 60, 45])
def test_grid_equals_definition(spark, window_days):
    log = _random_log(spark, 1)
    span = date_span(log)
    marked = labels.windowed_labels(log, window_days, 90)
    on_grid = process.metrics_on_grid(marked, log, span, window_days).drop("window_no")
    plain = process.process_features_plain(marked, log)
    assert _sorted(on_grid) == _sorted(plain)


def test_arbitrary_refs_equal_definition(spark):
    log = _random_log(spark, 2)
    refs = log.select(
        "repo_name",
        "file_path",
        F.explode(
            F.array(
                F.col("commit_date"),
                (F.col("commit_date") + F.expr("interval 17 hours")),
                F.lit(datetime(2022, 1, 1)).cast("timestamp_ntz"),
            )
        ).alias("window_end"),
    ).distinct()
    assert _sorted(process.metrics_as_of(refs, log)) == _sorted(process.process_features_plain(refs, log))


def test_windows_end_before_the_last_change(spark):
    log = log_of(spark, [change(0, 1), change(180, 2)])
    assert [r["window_no"] for r in labels.label_windows(log).collect()] == [0]
    assert labels.label_windows(log_of(spark, [change(0, 1)])).count() == 0


def test_label_horizon_is_half_open(spark):
    rows = [change(0, 1), change(1, 2), change(90, 3, fix=True), change(200, 4)]
    first = labels.windowed_labels(log_of(spark, rows)).collect()
    assert [(r["window_no"], r["is_buggy"]) for r in first] == [(0, True)]
    rows[2] = change(180, 3, fix=True)
    assert [r["is_buggy"] for r in labels.windowed_labels(log_of(spark, rows)).collect()] == [False]


def test_labels_by_method(spark):
    log = log_of(spark, [change(0, 1), change(1, 2), change(200, 3, fix=True)])
    with pytest.raises(ValueError, match="fewer than 100"):
        labels.labels_by(log, "windowed", 100)
    assert "window_no" in labels.labels_by(log, "windowed", 1).columns
    assert "total_commits" in labels.labels_by(log, "simple").columns
    with pytest.raises(ValueError, match="unknown"):
        labels.labels_by(log, "best")


def test_cap_flips_the_least_suspicious(spark):
    rows = [("r", f"f{i}", int(i < 8), i / 10) for i in range(10)]
    df = spark.createDataFrame(rows, "repo_name string, file_path string, is_buggy int, fix_density double")
    capped = labels.cap_positive_rate(df, {}, 0.5)
    kept = {r["file_path"] for r in capped.filter("is_buggy = 1").collect()}
    assert kept == {f"f{i}" for i in range(3, 8)}
    assert capped.count() == 10


@pytest.mark.parametrize("seed", range(3))
def test_cap_never_exceeded(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [
        (rng.choice(["a", "b", None]), f"f{i}", int(rng.random() < 0.7), rng.choice([0.0, 0.5, None]))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "repo_name string, file_path string, is_buggy int, fix_density double")
    for row in labels.cap_positive_rate(df, {"a": 0.2}, 0.4).groupBy("repo_name").agg(
        F.count("*").alias("n"), F.sum("is_buggy").alias("p")
    ).collect():
        cap = 0.2 if row["repo_name"] == "a" else 0.4
        assert row["p"] <= int(row["n"] * cap)


def test_cap_ranks_in_few_buckets(spark):
    """Distinct values and one very common value, against a plain sort; far fewer buckets than rows."""
    rows = [("r", f"f{i}", 1, 0.5 if i % 3 else i / 3000) for i in range(3000)] + [("r", "g", 0, None), ("r", "h", 1, None)]
    df = spark.createDataFrame(rows, "repo_name string, file_path string, is_buggy int, fix_density double")
    digest = F.md5("file_path")
    buckets = labels.rank_buckets(df, "fix_density", digest, 31)
    assert df.select(*buckets).distinct().count() < 32 + 2 * 256 + 64
    capped = labels.cap_positive_rate(df, default=0.4)
    flipped = {r["file_path"] for r in capped.filter("is_buggy = 0").collect()} - {"g"}
    order = df.filter("is_buggy = 1").orderBy(F.asc_nulls_last("fix_density"), digest)
    want = [r["file_path"] for r in order.limit(len(flipped)).collect()]
    assert len(flipped) == 3001 - int(3002 * 0.4) and flipped == set(want)
    assert labels.cap_positive_rate(df).filter("is_buggy = 0").count() == 1


def test_large_change_gate_keeps_rows_without_keys(spark):
    rows = [("r", "c", True), (None, "c", True), ("r", None, True), (None, None, False)]
    df = spark.createDataFrame(rows, "repo_name string, commit_hash string, is_bug_fix boolean")
    assert predicates.large_change_gate(df).count() == 4


def test_holdout_keeps_rows_without_a_label(spark):
    df = spark.range(20).selectExpr("id", "if(id % 5 = 0, null, id % 2) as y")
    split = splits.stratified_holdout(df, ["id"], splits.id_hash(F.col("id")), "y")
    counts = {r["y"]: r["n"] for r in split.filter("split = 'test'").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert split.count() == 20 and counts == {None: 1, 0: 2, 1: 2}


def test_large_change_gate(spark):
    log = log_of(spark, [change(0, 1, fix=True, file=f"f{i}") for i in range(16)] + [change(0, 2, fix=True)])
    gated = predicates.large_change_gate(log)
    assert gated.filter("is_bug_fix").count() == 1


@pytest.mark.parametrize(
    ("message", "loose", "strict", "report"),
    [
        ("Fixes #12", True, True, True),
        ("prefix cleanup", True, False, False),
        ("debug tooling", True, False, False),
        ("memory-leak in cache", False, True, False),
        ("Crashed on start", False, True, False),
        ("crash on start", False, True, True),
        ("Resolves nothing", True, False, False),
        (None, False, False, False),
    ],
)
def test_fix_flags(spark, message, loose, strict, report):
    df = spark.createDataFrame([(message,)], "m string")
    row = df.select(
        text.fix_flag_loose(F.col("m")), text.fix_flag_strict(F.col("m")), text.fix_flag_report(F.col("m"))
    ).first()
    assert tuple(row) == (loose, strict, report)


@pytest.mark.parametrize(
    "body", ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "\n\n", "a\x0bb\x0cc", "a\u2028b\x85c", "a\rb\n\rc", "x\r"]
)
def test_line_count_is_splitlines(spark, body):
    df = spark.createDataFrame([(body,)], "t string")
    assert df.select(text.line_count(F.col("t"))).first()[0] == len(body.splitlines())


def test_month_clamp_and_null_dates(spark):
    rows = [("a", datetime(2024, 3, 31)), ("b", datetime(2024, 2, 29)), ("c", datetime(2024, 3, 1)), ("d", None)]
    df = spark.createDataFrame(rows, "id string, commit_date timestamp_ntz")
    got = {r["id"]: r["split"] for r in splits.temporal_split(df, 1).collect()}
    assert got == {"a": "test", "b": "train", "c": "test", "d": "train"}


def test_split_falls_back_without_dates(spark):
    rows = [(i, i % 4 == 0) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, is_buggy boolean").withColumn(
        "commit_date", F.lit(None).cast("timestamp_ntz")
    )
    with pytest.raises(ValueError, match="test side is empty"):
        splits.split_by_time(df, ["id"])
    split = splits.split_by_time(df, ["id"], otherwise="stratified")
    assert {r[0] for r in split.select("split_method").distinct().collect()} == {"stratified"}
    counts = {r["is_buggy"]: r["n"] for r in split.filter("split = 'test'").groupBy("is_buggy").agg(F.count("*").alias("n")).collect()}
    assert counts == {True: 5, False: 15}


def test_folds_are_disjoint_and_balanced(spark):
    df = spark.range(1000).withColumn("is_buggy", F.col("id") % 3 == 0)
    folded = splits.stratified_kfold(df, ["id"], splits.id_hash(F.col("id")))
    assert folded.count() == 1000
    sizes = folded.groupBy("is_buggy", "fold").count().collect()
    assert len(sizes) == 10
    for flag in (True, False):
        counts = [r["count"] for r in sizes if r["is_buggy"] == flag]
        assert max(counts) - min(counts) <= 1
