"""The stored change log: same results with and without buckets, and no shuffle by file with them."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.operators import joins, labels, process
from riskloom.operators.history import KEYS, store_history

SCHEMA = (
    "repo_name string, file_path string, commit_hash string, author_email string, commit_date timestamp_ntz, "
    "lines_changed int, is_bug_fix boolean, source_code string"
)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(9)
    rows = [
        (
            rng.choice(["r", "s", None]), rng.choice(["a.py", "b.py", "d/a.py", None]), f"c{rng.randrange(200)}", rng.choice(["x", "y", None]),
            None if rng.random() < 0.05 else datetime(2023, 1, 1) + timedelta(hours=rng.randrange(24 * 500)),
            rng.choice([None, 3, 9]), rng.choice([None, True, False]), rng.choice([None, "  ", "x = 1", "y = 2", "z = 3"]),
        )
        for _ in range(600)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def everything(past):
    marked = labels.windowed_labels(past.changes, span=past.span)
    marked = marked.withColumn("is_buggy", F.col("is_buggy").cast("int"))
    activity = process.process_features(marked, past.changes, past.span)
    pairs = marked.select(*KEYS, (F.col("window_end") + F.expr("interval -7 days")).alias("window_end"))
    texts = joins.source_as_of(pairs, past, match_names=False)
    return {"activity": activity, "pairs": process.process_features_pairs(pairs, past), "texts": texts}


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


def test_same_results_with_and_without_buckets(spark, log):
    by_file, plain = store_history(log, "source_code"), store_history(log, "source_code", file_rows=10)
    assert by_file.buckets and plain.buckets is None and by_file.span == plain.span
    assert rows_of(by_file.changes) == rows_of(plain.changes)
    one, other = everything(by_file), everything(plain)
    for name in one:
        assert rows_of(one[name]) == rows_of(other[name]), name


def test_steps_by_file_do_not_shuffle(spark, log):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _check_plans(spark, log)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _check_plans(spark, log):
    past = store_history(log, "source_code", buckets=4)
    found = everything(past)
    plan = found["activity"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    # Two results of the same history meet without a shuffle too.
    other = labels.windowed_labels(past.changes, span=past.span).drop("is_buggy", "window_end")
    both = found["activity"].join(other.hint("merge"), [*KEYS, "window_no"])
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    # The as-of step only deals out the refs.
    refs = found["activity"].select(*KEYS, "window_end")
    digests = joins.source_digest_as_of(refs, past)._jdf.queryExecution().executedPlan().toString()
    assert digests.count("Exchange") <= 2 and "source_code" not in digests


def test_empty_log(spark, log):
    past = store_history(log.limit(0), "source_code")
    assert past.changes.count() == 0 and all(df.count() == 0 for df in everything(past).values())


def test_only_files_that_share_a_name_are_looked_up_by_name(spark):
    day = [datetime(2024, 1, d) for d in range(1, 9)]
    rows = [("r", "a/x.py", day[0], "x = 1"), ("r", "b/x.py", day[2], "x = 2"), ("r", "c/y.py", day[1], "y = 1"), ("s", "c/z.py", day[1], "z = 1"), ("r", "e/w.py", day[1], "  ")]
    log = spark.createDataFrame(rows, "repo_name string, file_path string, commit_date timestamp_ntz, source_code string")
    asked = [("r", "a/x.py", day[4]), ("r", "a/x.py", day[1]), ("r", "c/y.py", day[4]), ("r", "d/y.py", day[4]), ("s", "c/z.py", day[4]), ("r", "z.py", day[4]), ("r", "e/w.py", day[4])]
    refs = spark.createDataFrame(asked, "repo_name string, file_path string, window_end timestamp_ntz")
    want = dict(zip(asked, ["x = 2", "x = 1", "y = 1", "y = 1", "z = 1", None, None]))
    for past in (store_history(log, "source_code"), store_history(log, "source_code", file_rows=0)):
        shared = joins._files_sharing_a_name(past.changes, refs)
        assert {tuple(r) for r in shared.collect()} == {("r", "a/x.py"), ("r", "b/x.py"), ("r", "c/y.py"), ("r", "d/y.py")}
        got = {(r["repo_name"], r["file_path"], r["window_end"]): r["source_code"] for r in joins.source_as_of(refs, past, match_names=True).collect()}
        assert got == want


def test_digests_are_stored_as_bytes_and_texts_without_them(spark):
    log = spark.createDataFrame([("r", "a.py", datetime(2024, 1, 1), "x = 1"), ("r", "b.py", datetime(2024, 1, 1), " "), ("r", "c.py", datetime(2024, 1, 1), None)],
                                "repo_name string, file_path string, commit_date timestamp_ntz, source_code string")
    past = store_history(log, "source_code")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {r["file_path"]: r["digest"] for r in past.changes.collect()} == {"a.py": sha("x = 1"), "b.py": sha(" ") + "-", "c.py": None}
    assert "digest" not in past.whole.columns
