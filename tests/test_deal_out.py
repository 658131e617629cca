"""Large inputs go to more tasks, small ones stay as they are; results are the same."""

from __future__ import annotations

import re

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from riskloom.operators import graph, structure
from riskloom.plans import bindings, catalog
from riskloom.sources import dumps, tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    monkeypatch.setattr(bindings, "FEW_PARTS", 10)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def dealt(df, *columns: str) -> set[int]:
    """Partition counts of the exchanges by ``columns``."""
    keys = ", ".join(rf"{c}#\d+L?" for c in columns)
    return {int(n) for n in re.findall(rf"hashpartitioning\({keys}, (\d+)\)", plan(df))}


def test_changes_are_dealt_out_by_count(spark, small_tasks):
    log = bindings.change_log(spark, FOLDER)
    tasks = -(-tables.table(spark, FOLDER, "lineitem").count() // 500)
    assert tasks > 4 and tasks in dealt(log, "l_orderkey") and tasks in dealt(log, "l_partkey")


def test_few_changes_stay_as_they_are(spark):
    assert "REPARTITION" not in plan(bindings.change_log(spark, FOLDER))


@pytest.mark.parametrize("name", ["top_churned_files", "load_change_log"])
def test_dealt_out_changes_give_the_same(spark, small_tasks, name):
    assert difference(catalog.queries()[name](spark, FOLDER), connect(FOLDER), catalog.checks()[name]) is None


@pytest.mark.parametrize("name", ["parse_change_dump", "parse_date_dump"])
def test_dumps_are_dealt_out_by_count(spark, small_tasks, name):
    parsed = catalog.queries()[name](spark, FOLDER)
    tasks = -(-2 * tables.table(spark, FOLDER, "lineitem").count() // 500)
    assert tasks in dealt(parsed, "dump_id", "chunk")
    assert difference(parsed, connect(FOLDER), catalog.checks()[name]) is None


def test_dump_lines_are_counted_if_nobody_says_how_many(spark, small_tasks, tmp_path):
    lines = [line for i in range(700) for line in (f"c{i}|a@e.org|2024-01-01 00:00:00 +0000|m", f"src/f{i}.py", f"src/g{i}.py")]
    (tmp_path / "dump.txt").write_text("\n".join(lines))
    parsed = dumps.parse_change_dump(dumps.read_dump_lines(spark, str(tmp_path)))
    assert 5 in dealt(parsed, "dump_id", "chunk")
    assert parsed.count() == 1400
    assert parsed.filter(F.substring("commit_hash", 2, 9) != F.regexp_extract("file_path", r"(\d+)", 1)).count() == 0


def test_graph_nodes_are_dealt_out_by_count(spark, small_tasks, tmp_path):
    texts = spark.range(160).select(F.concat(F.lit("x = 1\n" * 5), F.lit("y = "), F.col("id").cast("string")).alias("source_code"))
    nodes = tables.write_table(structure.ast_nodes(structure.distinct_sources(texts)), str(tmp_path / "nodes"))
    found = graph.graph_nodes(nodes)
    tasks = -(-nodes.count() // 500)
    assert tasks > 4 and tasks in dealt(found, "digest")
    assert found.count() == nodes.count()


def test_dealt_out_graphs_give_the_same_checks(spark, small_tasks):
    for name in ("graph_edge_checks", "graph_feature_checks"):
        assert difference(catalog.queries()[name](spark, FOLDER), connect(FOLDER), catalog.checks()[name]) is None
