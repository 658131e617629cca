from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riskloom.operators import cleaning, joins, topk
from riskloom.operators.history import store_history
from riskloom.schema import require_columns
from riskloom.sources import benchmark, change_log, dumps

DUMP = """aaa|x@e.org|2024-01-02 03:04:05 +0200|msg with | bar

src/a.py
src/b.py
README.md
bbb|y@e.org|2024-01-03 00:30:00 -0100|second

src/a.py
src/c.py
notes.md
"""


def test_change_dump_from_a_file(spark, tmp_path):
    (tmp_path / "repo.txt").write_text(DUMP)
    rows = dumps.parse_change_dump(dumps.read_dump_lines(spark, str(tmp_path))).collect()
    got = {(r["commit_hash"], r["file_path"]): r for r in rows}
    assert set(got) == {("aaa", "src/a.py"), ("aaa", "src/b.py"), ("bbb", "src/a.py"), ("bbb", "src/c.py")}
    assert got[("aaa", "src/a.py")]["commit_date"] == datetime(2024, 1, 2, 1, 4, 5)
    assert got[("bbb", "src/c.py")]["commit_date"] == datetime(2024, 1, 3, 1, 30)
    assert got[("aaa", "src/b.py")]["commit_message"] == "msg with | bar"


def test_headers_carry_over_file_splits(spark, tmp_path):
    lines = []
    for i in range(3000):
        lines.append(f"c{i}|a@e.org|2024-01-01 00:00:00 +0000|m")
        lines += [f"src/f{i}_{j}.py" for j in range(i % 4)]
    (tmp_path / "big.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = dumps.read_dump_lines(spark, str(tmp_path))
        assert read.select("chunk").distinct().count() > 10
        parsed = dumps.parse_change_dump(read)
        assert parsed.count() == sum(i % 4 for i in range(3000))
        wrong = parsed.filter(
            F.concat(F.lit("src/f"), F.substring("commit_hash", 2, 9))
            != F.substring_index("file_path", "_", 1)
        )
        assert wrong.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_date_dump_keeps_the_first_date(spark, tmp_path):
    (tmp_path / "d.txt").write_text(
        "2024-05-02 10:00:00 +0000\nsrc/a.py\n\n2024-04-01 10:00:00 +0000\nsrc/a.py\nsrc/b.py\n"
    )
    rows = dumps.parse_date_dump(dumps.read_dump_lines(spark, str(tmp_path))).collect()
    assert {r["file_path"]: r["last_seen"] for r in rows} == {
        "src/a.py": datetime(2024, 5, 2),
        "src/b.py": datetime(2024, 4, 1),
    }


def test_change_log_csv(spark, tmp_path):
    header = "commit_hash,commit_date,commit_message,author_email,author_name,is_bug_fix,file_path,filename,lines_added,lines_deleted,lines_changed,complexity,nloc,source_code,repo_name"
    (tmp_path / "log.csv").write_text(
        header
        + '\nh1,2024-01-01 10:00:00+02:00,"two\nlines",a,a,true,src\\a.py,a.py,1,1,2,0,0,"x = ""1""",r\n'
        + "h2,never,m,a,a,,b.py,b.py,1,1,,0,0,,r\nh3,2024-01-02,m,a,a,,,b.py,1,1,,0,0,,r\n"
    )
    rows = {r["commit_hash"]: r for r in change_log.read_change_log_csv(spark, str(tmp_path)).collect()}
    assert set(rows) == {"h1", "h3"}
    assert rows["h1"]["commit_date"] == datetime(2024, 1, 1, 8)
    assert rows["h1"]["file_path"] == "src/a.py"
    assert (rows["h3"]["file_path"], rows["h3"]["is_bug_fix"], rows["h3"]["lines_changed"]) == ("unknown", False, 0)


def test_benchmark_csv(spark, tmp_path):
    (tmp_path / "kc1.csv").write_text("loc,v(g),lOCode,Odd Name,defects\n10,1,5,z,yes\n20,,6,y,FALSE\n30,3,7,x,what\n")
    raw = benchmark.read_benchmark_csv(spark, str(tmp_path / "kc1.csv"))
    rows = {r["file_path"]: r for r in benchmark.load_benchmark_modules(raw, "KC1", "__at").collect()}
    assert set(rows) == {f"KC1_module_{i}" for i in range(3)}
    assert rows["KC1_module_0"]["lines_of_code"] == 10.0
    assert [rows[f"KC1_module_{i}"]["is_buggy"] for i in range(3)] == [True, False, None]


def test_union_of_nothing_fails(spark):
    def broken():
        raise OSError("gone")

    with pytest.raises(ValueError, match="could not be loaded.*gone"):
        change_log.union_sources({"a": broken}, allow_failed=True)


def test_failed_source_is_reported(spark):
    def broken():
        raise OSError("gone")

    sources = {"a": broken, "b": spark.range(3)}
    with pytest.raises(ValueError, match="gone"):
        change_log.union_sources(sources)
    union, failed = change_log.union_sources(sources, allow_failed=True)
    assert union.count() == 3 and failed == {"a": "gone"}


def test_vectors_do_not_mix_between_repositories(spark):
    rows = spark.createDataFrame([("r", "p", 1.0), ("s", "p", None)], "repo_name string, file_path string, x double")
    vectors = spark.createDataFrame([("r", "p", [1.0]), ("s", "p", [2.0])], "repo_name string, file_path string, embedding array<float>")
    got = joins.lookup_vector_or_zero(rows, vectors, dim=1, features=["x"]).select("repo_name", "hybrid").collect()
    assert {r[0]: list(r[1]) for r in got} == {"r": [1.0, 1.0], "s": [-1.0, 2.0]}


def test_median_of_a_column_with_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("a", None)], "repo_name string, x double")
    assert sorted(r["x"] for r in cleaning.impute_global_median(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 3.0]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="x"):
        require_columns(spark.range(1), ["x"])


def test_validate_no_nulls_raises(spark):
    df = spark.createDataFrame([("f", 1, None)], "file_path string, is_buggy int, x double")
    with pytest.raises(ValueError, match="nulls remain"):
        cleaning.validate_no_nulls(df, ["x"])


def test_source_as_of_against_a_plain_join(spark):
    import random

    rng = random.Random(5)
    log_rows = [
        ("r", f"d{i % 2}/f{rng.randrange(4)}.py", datetime(2024, 1, 1 + rng.randrange(20), rng.randrange(24)), rng.choice(["x=1", "y=2", "  ", None]))
        for i in range(120)
    ]
    log = spark.createDataFrame(log_rows, "repo_name string, file_path string, commit_date timestamp_ntz, source_code string")
    refs = spark.createDataFrame(
        [("r", f"d{d}/f{f}.py", datetime(2024, 1, day, 12)) for d in (0, 1) for f in range(4) for day in (1, 5, 5, 19, 28)],
        "repo_name string, file_path string, window_end timestamp_ntz",
    ).distinct()
    # Stored by file, and as a log with a file that is too large for that.
    for by_name, file_rows in ((False, 1000), (True, 1000), (False, 3), (True, 3)):
        past = store_history(log, "source_code", file_rows=file_rows)
        assert (past.buckets is None) == (file_rows == 3) and "source_code" not in past.changes.columns
        got = joins.source_as_of(refs, past, match_names=by_name).collect()
        assert len(got) == refs.count()
        for row in got:
            name = row["file_path"].split("/")[-1]
            past = [
                r for r in log_rows
                if r[3] is not None and r[2] <= row["window_end"]
                and (r[1] == row["file_path"] or (by_name and r[1].split("/")[-1] == name))
            ]
            newest = max((r[2] for r in past), default=None)
            texts = {r[3] for r in past if r[2] == newest}
            want = {t if t.strip() else None for t in texts} or {None}
            assert row["source_code"] in want


def test_blank_text_takes_part_in_ties(spark):
    import hashlib

    day, blank = datetime(2024, 1, 1), "   "
    below = next(t for t in (f"x={i}" for i in range(99)) if hashlib.sha256(t.encode()).digest() < hashlib.sha256(blank.encode()).digest())
    above = next(t for t in (f"x={i}" for i in range(99)) if hashlib.sha256(t.encode()).digest() > hashlib.sha256(blank.encode()).digest())
    rows = [("r", name, day, text) for name, own in (("low", below), ("high", above)) for text in (own, blank)]
    log = spark.createDataFrame(rows, "repo_name string, file_path string, commit_date timestamp_ntz, source_code string")
    refs = log.select("repo_name", "file_path", F.col("commit_date").alias("window_end")).distinct()
    got = {r["file_path"]: (r["source_code"], r["digest"]) for r in joins.source_as_of(refs, store_history(log, "source_code")).collect()}
    assert got == {"low": (None, None), "high": (above, hashlib.sha256(above.encode()).hexdigest())}


def test_unmatched_modules_skip_the_lookup(spark):
    log = spark.createDataFrame([("r", "a.py", datetime(2024, 1, 1), "x=1")], "repo_name string, file_path string, commit_date timestamp_ntz, source_code string")
    refs = spark.createDataFrame([("r", "a.py", datetime(2024, 2, 1), False)], "repo_name string, file_path string, window_end timestamp_ntz, has_git_match boolean")
    row = joins.source_as_of(refs, store_history(log, "source_code")).first()
    assert row["source_code"] is None and row["digest"] is None


def test_repair_dates(spark):
    limit, ref = datetime(2026, 1, 1), datetime(2026, 5, 28)
    rows = [
        ("r", "kept", datetime(2020, 1, 1), 5),
        ("r", "history", datetime(2026, 3, 1), 5),
        ("r", "estimate", None, 200),
        ("r", "again", None, 300),
        ("r", "default", None, None),
    ]
    df = spark.createDataFrame(rows, "repo_name string, file_path string, last_seen timestamp_ntz, days_since_last_change int")
    history = spark.createDataFrame(
        [("r", "history", datetime(2021, 6, 1, 15)), ("r", "again", datetime(2026, 2, 2))],
        "repo_name string, file_path string, commit_date timestamp_ntz",
    )
    fixed = {r["file_path"]: r["last_seen"] for r in joins.repair_dates(df, history, ref, limit, 365).collect()}
    assert fixed["kept"] == datetime(2020, 1, 1)
    assert fixed["history"] == datetime(2021, 6, 1)
    assert fixed["estimate"] == datetime(2025, 11, 9)
    assert fixed["again"] == datetime(2025, 8, 1)
    assert fixed["default"] == datetime(2025, 5, 28)


def test_similar_by_score_ties_follow_report_order(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.8), ("d", 0.7), ("e", 0.1)], "id string, score double")
    near = {r["id"]: r["similar"] for r in topk.similar_by_score(topk.rank_top_k_risk(df, 5)).collect()}
    assert near["b"][0] == "c"
    assert near["e"] == ["d", "b", "c"]


def test_cosine_neighbors_skip_zero_vectors(spark):
    ranked = topk.rank_top_k_risk(
        spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.7), ("z", 0.6)], "id string, score double"), 4
    )
    vectors = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.1]), ("z", [0.0, 0.0])], "id string, embedding array<float>"
    )
    near = {r["id"]: r["neighbors"] for r in topk.cosine_neighbors(ranked, vectors).collect()}
    assert near["a"] == ["c", "b"]
    assert near["z"] == []


def test_newest_texts_are_not_sorted(spark):
    from riskloom.sources.snapshots import latest_source_snapshot

    first, second = datetime(2024, 1, 1), datetime(2024, 1, 2)
    rows = [
        ("r", "a", first, 1, "old"), ("r", "a", second, 2, "tie one"), ("r", "a", second, 2, "tie two"), ("r", "a", second, 3, "  "),
        ("r", "b", None, 1, "undated"), ("r", "c", None, 9, "undated"), ("r", "c", first, None, "dated"),
        (None, "a", first, 1, "no repository"), (None, "a", None, 2, "older"), ("r", "d", first, 1, None),
    ]
    log = spark.createDataFrame(
        rows, "repo_name string, file_path string, commit_date timestamp_ntz, commit_hash bigint, source_code string"
    )
    newest = latest_source_snapshot(log)
    found = {(r["repo_name"], r["file_path"]): r["source_code"] for r in newest.collect()}
    assert found == {("r", "a"): "tie two", ("r", "b"): "undated", ("r", "c"): "dated", (None, "a"): "no repository"}
    plan = newest._jdf.queryExecution().sparkPlan().toString()
    # Texts are aggregated after revisions that are not the newest have dropped out.
    assert "ShuffledHashJoin" in plan and plan.index("max(source_code") < plan.index("ShuffledHashJoin")
    assert "max_by" not in plan and "struct(commit_date" in plan
