"""Queries that read the log several times store it once; texts that are not asked for stay where they are."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.functions import membership
from riskloom.operators import cleaning, history
from riskloom.operators.structure import shape_text
from riskloom.plans import bindings, catalog, flows
from riskloom.sources import snapshots, tables

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["risk_report", "hybrid_report"])
def test_reports_join_the_tables_once(spark, monkeypatch, name):
    built, make = [], bindings.change_log
    monkeypatch.setattr(bindings, "change_log", lambda *a, **k: built.append(1) or make(*a, **k))
    found = catalog.queries()[name](spark, FOLDER)
    assert len(built) == 1
    assert found.count() == 1


def test_matrix_reads_the_stored_log(spark):
    assert "lineitem" not in plan(catalog.queries()["assemble_matrix"](spark, FOLDER))


def test_stored_log_without_texts_is_not_written_again(spark, monkeypatch):
    log = bindings.stored_log(spark, FOLDER)
    assert log.columns == [*history.NARROW, "source_code"]
    written, write = [], history.write_table
    monkeypatch.setattr(history, "write_table", lambda *a, **k: written.append(1) or write(*a, **k))
    past = history.store_history(log, stored=True)
    assert not written and past.changes.count() == log.count()
    assert history.store_history(log).span == past.span and written


def test_rows_without_a_partner_are_left_out(spark, tmp_path):
    key = F.when(F.col("id") != 50, F.col("id"))
    rows = spark.range(20_000).select(key.alias("a"), F.struct(F.col("id").cast("string").alias("s"), key.alias("n")).alias("b"))
    wanted = tables.write_table(rows.where("a % 10 = 0 or a is null"), str(tmp_path / "wanted"))
    some = membership.may_be_among(rows, wanted, ["a", "b"])
    assert some.columns == rows.columns
    assert some.join(wanted, some["a"].eqNullSafe(wanted["a"]), "left_semi").count() == wanted.count() == 2000
    assert 2000 <= some.count() < 4000
    assert membership.may_be_among(rows, wanted.limit(0), ["a"]).count() == 0


def test_full_bitmap_loses_no_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(membership, "MOST_ROWS", 2)
    rows = spark.range(100_000).select(F.col("id").alias("a"))
    wanted = tables.write_table(rows.where("a % 2 = 0"), str(tmp_path / "wanted"))
    assert membership.may_be_among(rows, wanted, ["a"]).join(wanted, "a", "left_semi").count() == 50_000


def test_older_texts_are_not_shuffled(spark):
    start = datetime(2024, 1, 1)
    rows = [("r", f"f{n % 20}.py", start + timedelta(days=n), n, f"x = {n}\n") for n in range(2000)]
    log = spark.createDataFrame(rows, "repo_name string, file_path string, commit_date timestamp_ntz, commit_hash bigint, source_code string")
    newest = snapshots.latest_source_snapshot(log)
    assert {(r["file_path"], r["source_code"]) for r in newest.collect()} == {(f"f{n % 20}.py", f"x = {n}\n") for n in range(1980, 2000)}
    before_shuffle = plan(newest).partition("Exchange hashpartitioning(coalesce")[2]
    assert "LeftSemi" in before_shuffle


def test_history_buckets_are_no_larger_than_a_task(spark):
    assert history.BUCKET_ROWS <= tables.TASK_ROWS


def test_one_text_of_each_tree_is_chosen_before_numbers_are_replaced(spark, monkeypatch):
    start = datetime(2024, 1, 1)
    texts = ["x = {}\n", "y = [{}]\n", "  "]
    rows = [("r", "a.py", start + timedelta(days=n), texts[n % 3].format(n + 1)) for n in range(300)]
    log = spark.createDataFrame(rows, "repo_name string, file_path string, commit_date timestamp_ntz, source_code string")
    past = history.store_history(log, "source_code", shapes=True)
    stored, write = [], history.write_table
    monkeypatch.setattr(history, "write_table", lambda df, *a, **k: stored.append(df.columns) or write(df, *a, **k))
    asked = past.changes.where("commit_date = timestamp_ntz'2024-01-01'").select("shape")
    found = past.shapes(asked).collect()
    assert [r["source_code"] for r in found] == ["x = 1\n"]
    assert stored == [["shape", "__text"]]
    every = past.shapes(past.changes.select("shape"))
    assert {r["source_code"] for r in every.collect()} == {r[0] for r in log.where("trim(source_code) <> ''").select(shape_text(F.col("source_code"))).distinct().collect()}


def test_capped_matrix_is_stored_for_the_medians(spark):
    rows = [("r", f"f{n}.py", n % 4, datetime(2024, 1, 1), int(n % 3 != 0), n / 7, None if n % 5 else 1.0) for n in range(200)]
    matrix = spark.createDataFrame(rows, "repo_name string, file_path string, window_no bigint, window_end timestamp_ntz, is_buggy int, fix_density double, gappy double")
    ready, names = flows.training_matrix(matrix, {}, 0.3, ["repo_name", "file_path", "window_no"])
    assert ready.agg(F.sum("is_buggy")).first()[0] == 60 and set(names) == {"fix_density", "gappy"}
    assert ready.where("gappy is null").count() == 0
    assert "Union" not in plan(ready)


def test_medians_are_taken_of_columns_with_gaps_only(spark, monkeypatch):
    melted, melt = [], cleaning.melt
    monkeypatch.setattr(cleaning, "melt", lambda df, keep, columns: melted.append(list(columns)) or melt(df, keep, columns))
    rows = [("r", 1, None, 1.0), ("r", 2, 3.0, float("nan")), ("s", 3, 5.0, 4.0), (None, 4, None, 2.0)]
    df = spark.createDataFrame(rows, "repo_name string, whole int, one double, other double")
    filled = cleaning.impute_group_median(df, ["whole", "one", "other"])
    got = {(r["whole"], r["one"], r["other"]) for r in filled.collect()}
    assert got == {(1.0, 3.0, 1.0), (2.0, 3.0, 1.0), (3.0, 5.0, 4.0), (4.0, 3.0, 2.0)}
    assert melted == [["one", "other"], ["one"]] and filled.schema["whole"].dataType.simpleString() == "double"
    assert rows_of(cleaning.impute_group_median(df, ["whole"])) == rows_of(df.withColumn("whole", F.col("whole").cast("double")))


def rows_of(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())
