"""Committed tables: old or new, never a mixture."""

from __future__ import annotations

import pytest

from riskloom.operators import runs
from riskloom.sources import committed
from riskloom.sources.change_log import merge_keep_latest

SCHEMA = "repo_name string, file_path string, window_end int, note string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def table(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_run_lost_before_its_commit_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert committed.read_committed(spark, path) is None
    first = table(spark, ("a", "f", 1, "x"), ("b", "g", 1, "x"), (None, "h", 1, "x"), ("c/d=e", "i", 1, None))
    committed.write_committed(first, path, "repo_name")
    second = table(spark, ("a", "f", 2, "y"), ("a", "k", 2, "y"))

    def lost():
        raise RuntimeError("driver lost")

    with pytest.raises(RuntimeError):
        committed.write_committed(second, path, "repo_name", before_commit=lost)
    assert rows_of(committed.read_committed(spark, path)) == rows_of(first)
    # The rerun replaces partition a and keeps the others.
    got = committed.write_committed(second, path, "repo_name")
    assert rows_of(got) == rows_of(second.unionAll(first.where("repo_name is null or repo_name <> 'a'")))
    assert rows_of(committed.write_committed(second, path, "repo_name")) == rows_of(got)


def test_a_broken_commit_file_is_passed_over(spark, tmp_path):
    path = str(tmp_path / "t")
    committed.write_committed(table(spark, ("a", "f", 1, "x")), path, "repo_name")
    (tmp_path / "t" / "commits" / f"{2:012d}.json").write_text('{"schema": "..')
    assert rows_of(committed.read_committed(spark, path)) == [("a", "f", 1, "x")]
    got = committed.write_committed(table(spark, ("b", "f", 1, "x")), path, "repo_name")
    assert rows_of(got) == [("a", "f", 1, "x"), ("b", "f", 1, "x")]


def test_two_writers_do_not_lose_each_other(spark, tmp_path):
    path = str(tmp_path / "t")
    committed.write_committed(table(spark, ("a", "f", 1, "x")), path, "repo_name")

    def other():
        committed.write_committed(table(spark, ("b", "g", 1, "other")), path, "repo_name")

    with pytest.raises(Exception, match="(?i)exist"):
        committed.write_committed(table(spark, ("b", "g", 1, "late")), path, "repo_name", before_commit=other)
    assert rows_of(committed.read_committed(spark, path)) == [("a", "f", 1, "x"), ("b", "g", 1, "other")]


def test_merge_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    committed.merge_committed(table(spark, ("a", "f", 1, "x"), ("b", "g", 5, "x"), (None, "h", 1, "x")), path, merge_keep_latest, "repo_name")
    before = {p.name: p for p in (tmp_path / "t" / "data").iterdir()}
    got = committed.merge_committed(table(spark, ("a", "f", 2, "y"), (None, "h", 0, "y")), path, merge_keep_latest, "repo_name")
    assert rows_of(got) == [("a", "f", 2, "y"), ("b", "g", 5, "x"), (None, "h", 1, "x")]
    fresh = [p for p in (tmp_path / "t" / "data").iterdir() if p.name not in before]
    assert {d.name for d in fresh[0].iterdir() if d.is_dir()} == {"__partition=va", "__partition=null"}
    assert rows_of(committed.write_committed(got.limit(0), path, "repo_name")) == rows_of(got)


def test_a_run_logged_twice_counts_once(spark, tmp_path):
    path = str(tmp_path / "log")
    for _ in range(2):
        log = runs.log_run(runs.run_rows(spark, "r1", "e", "n", {"p": 1}, {"AUC": 0.5}), path)
    log = runs.log_run(runs.run_rows(spark, "r2", "e", "n", {}, {"AUC": 0.7}), path)
    assert sorted((r.run_id, r.kind) for r in log.collect()) == [("r1", "metric"), ("r1", "param"), ("r2", "metric")]
