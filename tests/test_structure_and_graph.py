from __future__ import annotations

import ast

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import graph, structure

OK = "import os\ndef f(a):\n  return a\n"
NESTED = (
    "class A:\n    async def m(self, x, *, k=1, **kw):\n        if x:\n            pass\n        elif k:\n            pass\n"
    "        else:\n            for i in x:\n                try:\n                    pass\n                except E:\n                    pass\n"
)


def metrics_of(spark, source, variant="nesting", missing="null"):
    df = spark.createDataFrame([(source,)], "source_code string")
    return structure.structure_for(df, "source_code", variant, missing).first()


def test_simple_source(spark):
    row = metrics_of(spark, OK)
    assert row["num_functions"] == 1 and row["num_imports"] == 1 and row["num_classes"] == 0
    assert row["max_args_per_function"] == 1 and row["avg_function_length"] == 2
    assert row["has_try_except"] == 0 and row["cyclomatic_complexity"] == 1
    assert row["ast_node_count"] == sum(1 for _ in ast.walk(ast.parse(OK)))


def test_nested_source(spark):
    row = metrics_of(spark, NESTED)
    # class, method, if, elif, for, try
    assert row["max_nesting_depth"] == 6
    assert row["has_try_except"] == 1
    assert row["max_args_per_function"] == 4
    # if, elif, for, try, except
    assert row["cyclomatic_complexity"] == 6 and row["cognitive_complexity"] == 4
    tree = metrics_of(spark, NESTED, "tree")
    assert tree["max_args_per_function"] == 2

    def depth(node, d=0):
        return max((depth(k, d + 1) for k in ast.iter_child_nodes(node)), default=d)

    assert tree["max_nesting_depth"] == depth(ast.parse(NESTED))


@pytest.mark.parametrize("source", [None, "   ", "def ("])
def test_missing_and_bad_sources(spark, source):
    zeros = metrics_of(spark, source, missing="zero")
    assert zeros["num_functions"] == 0 and zeros["avg_function_length"] == 0.0
    row = metrics_of(spark, source)
    assert row["num_functions"] == (0 if source == "def (" else None)


def dense_pool(source, hops):
    """The definition: smooth all features over the whole graph, then average."""
    nodes = structure._node_rows("d", source)
    n = len(nodes)
    adjacency = np.eye(n)
    for row in nodes:
        if row[2] is not None:
            adjacency[row[1], row[2]] = adjacency[row[2], row[1]] = 1
    scale = 1 / np.sqrt(adjacency.sum(axis=1))
    smooth = scale[:, None] * adjacency * scale[None, :]
    deepest = max(r[4] for r in nodes) or 1
    widest = max(r[6] for r in nodes) or 1
    x = np.array(
        [[float(r[3] == t) for t in graph.NODE_TYPES] + [r[4] / deepest, r[6] / widest] for r in nodes]
    )
    for _ in range(hops):
        x = smooth @ x
    return x.mean(axis=0)


@pytest.mark.parametrize("hops", [1, 3])
def test_pooled_features_equal_dense_smoothing(spark, hops):
    df = spark.createDataFrame([(OK,), (NESTED,)], "source_code string")
    nodes = structure.ast_nodes(structure.distinct_sources(df))
    rows = graph.pooled_features(graph.graph_nodes(nodes), hops).collect()
    assert len(rows) == 2
    digests = {r["digest"]: r for r in rows}
    for source in (OK, NESTED):
        key = spark.range(1).select(F.sha2(F.lit(source), 256)).first()[0]
        row = digests[key]
        got = [row[c] for c in row.asDict() if c != "digest"]
        assert np.allclose(got, dense_pool(source, hops))


def test_edges_go_both_ways_and_tiny_graphs_drop(spark):
    df = spark.createDataFrame([(OK,), ("x\n",)], "source_code string")
    nodes = structure.ast_nodes(structure.distinct_sources(df))
    usable = graph.graph_nodes(nodes)
    assert usable.select("digest").distinct().count() == 1
    n = usable.count()
    edges = graph.graph_edges(usable)
    assert edges.count() == 2 * (n - 1)
    assert graph.graph_sizes(nodes).first()["n_edges"] == 2 * (n - 1)
    width = graph.node_features(usable).select(F.size("features")).distinct().collect()
    assert [r[0] for r in width] == [len(graph.NODE_TYPES) + 2]


def test_graph_dataset_counts_what_it_leaves_out(spark):
    texts = {"a": "x = 1\nif x:\n    y = 2\n", "b": "x", "c": "def broken(:", "d": "import os\n", "e": None, "f": "x = 1\nif x:\n    y = 2\n", "g": "z = 3\n"}
    sources = spark.createDataFrame([("r", f, t) for f, t in texts.items()], "repo_name string, file_path string, source_code string")
    marks = spark.createDataFrame([("r", f, int(f in "ab")) for f in "abcef"] + [("other", "d", 1)], "repo_name string, file_path string, is_buggy int")
    found = graph.build_graph_dataset(sources, marks)
    assert found.counts.first().asDict() == {"files": 7, "unlabeled": 2, "unparsed": 2, "out_of_bounds": 1, "kept": 2}
    rows = {r.file_path: (r.n_nodes, r.n_edges, r.is_buggy) for r in found.rows.collect()}
    size = sum(1 for _ in ast.walk(ast.parse(texts["a"])))
    assert rows == {"a": (size, 2 * size - 2, 1), "f": (size, 2 * size - 2, 0)}
    nothing = graph.build_graph_dataset(sources.limit(0), marks)
    assert nothing.rows.count() == 0 and set(nothing.counts.first()) == {0}


def test_graph_dataset_parses_once(spark):
    sources = spark.createDataFrame([("r", "a", "x = 1\ny = 2\n")], "repo_name string, file_path string, source_code string")
    nodes = structure.ast_nodes(structure.distinct_sources(sources))
    plan = graph.graph_sizes(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_texts_that_differ_in_whole_numbers_are_parsed_once(spark):
    texts = [f"x = {n}\n" for n in range(1, 40)] + ["x = 0\n", "x = 1_0\n", "x = 9\ny = 8\n", None, "  ", "def ("]
    df = spark.createDataFrame([(t,) for t in texts], "source_code string")
    assert structure.distinct_shapes(df).count() == 5
    got = {r["source_code"]: r["ast_node_count"] for r in structure.structure_for(df).collect()}
    want = {t: sum(1 for _ in ast.walk(ast.parse(t))) for t in texts if t and t.strip() and t != "def ("}
    assert got == {**want, None: None, "  ": None, "def (": 0}


def test_shape_texts_have_the_same_tree(spark):
    texts = [
        "a = 12\nb2 = 0x12 + 1e12 + 1.25 + 12j + 1_2\n", "s = '\\101 \\x41 \\N{VARIATION SELECTOR-12} 77'\nf = f'{a:12.3f}{12}'\n",
        "x = " + "9" * 5000 + "\n", "x = 007\n", "def é12(é3, é4): return 5 if é3 else -6\n", "print(5if x else 6)\n", "x = 12.real\n", "x = 12 .real\n",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", structure.shape_text(F.col("t")).alias("shape")).collect():
        assert [r[2:] for r in structure._node_rows("d", row["t"])] == [r[2:] for r in structure._node_rows("d", row["shape"])]


def test_embedding_by_tree_equals_embedding_by_text(spark):
    texts = [f"{t}x = {n}\n" for t in (OK, NESTED, "if a:\n    b = 1\n") for n in (1, 2, 3)] + ["def ("]
    df = spark.createDataFrame([(t,) for t in texts], "source_code string")
    df = df.withColumns({"digest": F.sha2("source_code", 256), "shape": structure.shape_digest(F.col("source_code"))})
    shapes = structure.ast_nodes(structure.distinct_shapes(df))
    assert shapes.select("digest").distinct().count() == 3
    one = graph.graph_embedding(structure.ast_nodes(structure.distinct_sources(df)), dim=2)
    two = graph.graph_embedding(shapes, dim=2, named=df.select("digest", "shape").distinct())
    want, got = ({r["digest"]: r["embedding"] for r in e.collect()} for e in (one, two))
    assert want.keys() == got.keys() and len(got) == 9
    assert all(np.allclose(got[d], want[d], atol=1e-6) for d in want)
