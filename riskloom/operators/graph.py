"""Code graphs and their embeddings as DataFrame joins and aggregations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from riskloom.operators.structure import ast_nodes, distinct_sources
from riskloom.session import fresh_path
from riskloom.sources.tables import deal_out, write_table

# Node types that get their own feature column.
NODE_TYPES = (
    "Module", "FunctionDef", "AsyncFunctionDef", "ClassDef",
    "Return", "Delete", "Assign", "AugAssign", "AnnAssign",
    "For", "AsyncFor", "While", "If", "With", "AsyncWith",
    "Raise", "Try", "Import", "ImportFrom", "Call", "Compare",
    "BoolOp", "BinOp", "UnaryOp", "Lambda", "IfExp",
    "Attribute", "Subscript", "Name", "Constant", "List",
    "Tuple", "Dict", "Set", "comprehension",
)
MIN_NODES = 5
EMBEDDING_DIM = 32
HOPS = 3


def _graph_totals(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.max("depth").alias("deepest"), F.max("n_children").alias("widest")
    )


def _usable(min_nodes: int, max_nodes: int | None) -> Column:
    size = F.col("n_nodes")
    return (size >= min_nodes) if max_nodes is None else size.between(min_nodes, max_nodes)


def _all_sizes(nodes: DataFrame) -> DataFrame:
    linked = F.col("n_children") + F.col("parent_idx").isNotNull().cast("int")
    return nodes.groupBy("digest").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(linked).alias("n_edges"))


def graph_sizes(nodes: DataFrame, min_nodes: int = MIN_NODES, max_nodes: int | None = None) -> DataFrame:
    """Nodes and directed edges per usable graph, in one aggregation."""
    return _all_sizes(nodes).filter(_usable(min_nodes, max_nodes))


@dataclass(frozen=True)
class GraphDataset:
    """Rows of the files that can be trained on, and one row that says what became of all files."""

    rows: DataFrame
    counts: DataFrame


#: What can become of a file, in the order it is decided.
OUTCOMES = ("unlabeled", "unparsed", "out_of_bounds", "kept")


def build_graph_dataset(
    sources: DataFrame,
    labels: DataFrame,
    keys: Sequence[str] = ("repo_name", "file_path"),
    min_nodes: int = MIN_NODES,
    max_nodes: int | None = None,
) -> GraphDataset:
    """``digest, n_nodes, n_edges, is_buggy`` of every labeled file whose text gives a usable graph.

    ``sources`` holds one ``source_code`` per file, ``labels`` one ``is_buggy``. The
    pass that writes the rows also counts the files without a label, with a text that
    does not parse (or none) and with a graph outside the bounds. Texts of unlabeled
    files are not parsed, equal texts are parsed once, and nothing is parsed again.
    """
    spark = sources.sparkSession
    marked = sources.select(*keys, "source_code").join(labels.select(*keys, "is_buggy"), list(keys), "left")
    text = F.when(F.col("is_buggy").isNotNull(), F.col("source_code"))
    marked = write_table(
        marked.select(*keys, "is_buggy", F.sha2(text, 256).alias("digest"), text.alias("source_code")), fresh_path(spark, "labeled-sources")
    )
    sizes = _all_sizes(ast_nodes(distinct_sources(marked)))
    outcome = (
        F.when(F.col("is_buggy").isNull(), "unlabeled").when(F.col("n_nodes").isNull(), "unparsed")
        .when(~_usable(min_nodes, max_nodes), "out_of_bounds").otherwise("kept")
    )
    decided = marked.drop("source_code").join(sizes, "digest", "left").withColumn("outcome", outcome)
    seen = Observation("graph dataset")
    observed = decided.observe(seen, F.count(F.lit(1)).alias("files"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    kept = observed.filter("outcome = 'kept'").select(*keys, "digest", "n_nodes", "n_edges", "is_buggy")
    rows = write_table(kept, fresh_path(spark, "graph-dataset"))
    # A table without rows is planned away together with its metrics.
    found = dict.fromkeys(("files", *OUTCOMES), 0) if marked.isEmpty() else seen.get
    counts = spark.createDataFrame(
        [tuple(found[c] for c in ("files", *OUTCOMES))], ", ".join(f"{c} bigint" for c in ("files", *OUTCOMES))
    )
    return GraphDataset(rows, counts)


def graph_nodes(nodes: DataFrame, min_nodes: int = MIN_NODES, max_nodes: int | None = None) -> DataFrame:
    """Nodes of usable graphs with depth and child count scaled to their graph.

    Graphs below ``min_nodes`` have no shape worth embedding; an upper bound is the
    caller's choice. ``nodes`` is read three times, so it should be a stored table. The
    totals are combined before their shuffle and joined back. Many nodes are dealt out
    by graph, so that a task's share does not grow with them.
    """
    nodes = deal_out(nodes, nodes.count(), "digest")
    sized = nodes.select("digest", "idx", "parent_idx", "type", "depth", "n_children").join(
        _graph_totals(nodes), "digest"
    )
    return sized.filter(_usable(min_nodes, max_nodes)).select(
        "digest",
        "idx",
        "parent_idx",
        "type",
        "n_nodes",
        (F.col("n_children") + F.col("parent_idx").isNotNull().cast("int")).alias("degree"),
        (F.col("depth") / F.greatest("deepest", F.lit(1))).alias("depth_share"),
        (F.col("n_children") / F.greatest("widest", F.lit(1))).alias("child_share"),
    )


def node_features(graph: DataFrame) -> DataFrame:
    """One-hot type plus the two scaled numbers, as one array per node."""
    one_hot = [(F.col("type") == t).cast("double") for t in NODE_TYPES]
    return graph.select(
        "digest",
        "idx",
        F.array(*[F.coalesce(c, F.lit(0.0)) for c in one_hot], "depth_share", "child_share").alias(
            "features"
        ),
    )


def graph_edges(graph: DataFrame) -> DataFrame:
    """Parent-child edges in both directions."""
    tree = graph.filter(F.col("parent_idx").isNotNull())
    down = tree.select("digest", F.col("parent_idx").alias("src"), F.col("idx").alias("dst"))
    return down.unionAll(down.select("digest", F.col("dst").alias("src"), F.col("src").alias("dst")))


def hop_weights(graph: DataFrame, hops: int = HOPS) -> DataFrame:
    """Add ``weight``: each node's share in its graph's pooled, smoothed features.

    Smoothing multiplies ``hops`` times by the symmetric normalized adjacency with
    self-loops and pooling is a mean, both linear. So one number per node is
    propagated instead of its whole feature vector.

    A node is the centre of its own family and a member of its parent's. Within a
    family the centre receives from all members and each member from the centre:
    one window per hop, then the two roles of a node are added up. Families lie
    inside a graph, so no hop shuffles again.
    """
    nodes = [c for c in graph.columns if c != "weight"]
    family = Window.partitionBy("digest", "family")
    root = F.sqrt(F.col("degree") + 1)
    state = graph.withColumn("weight", F.lit(1.0))
    for _ in range(hops):
        sent = F.col("weight") / root
        roles = F.array(
            F.struct(F.lit(True).alias("centre"), F.col("idx").alias("family")),
            F.struct(F.lit(False).alias("centre"), F.col("parent_idx").alias("family")),
        )
        placed = state.select(*nodes, sent.alias("sent"), F.inline(roles)).filter(
            F.col("family").isNotNull()
        )
        from_members = F.sum(F.when(F.col("centre"), 0.0).otherwise(F.col("sent"))).over(family)
        from_centre = F.max(F.when(F.col("centre"), F.col("sent"))).over(family)
        got = F.when(F.col("centre"), F.col("sent") + from_members).otherwise(from_centre)
        state = (
            placed.withColumn("got", got)
            .groupBy(*nodes)
            .agg(F.sum("got").alias("received"))
            .select(*nodes, (F.col("received") / root).alias("weight"))
        )
    return state


def pooled_features(graph: DataFrame, hops: int = HOPS) -> DataFrame:
    """Mean over nodes of the smoothed features, one column per feature."""
    w = F.col("weight")
    columns = [F.sum(F.when(F.col("type") == t, w).otherwise(0.0)).alias(f"t_{t}") for t in NODE_TYPES]
    columns += [
        F.sum(w * F.col("depth_share")).alias("t_depth_share"),
        F.sum(w * F.col("child_share")).alias("t_child_share"),
    ]
    sums = hop_weights(graph, hops).groupBy("digest", "n_nodes").agg(*columns)
    names = [c for c in sums.columns if c.startswith("t_")]
    return sums.select("digest", *[(F.col(c) / F.col("n_nodes")).alias(c) for c in names])


def graph_embedding(
    nodes: DataFrame, hops: int = HOPS, dim: int = EMBEDDING_DIM, named: DataFrame | None = None
) -> DataFrame:
    """``digest, embedding``: pooled graph features projected to ``dim`` numbers.

    The pooled table is stored once, because fitting and projecting both read it. With
    ``named(digest, shape)``, ``nodes`` holds the trees that the shapes name: each is pooled
    once, and every digest counts in the fit.
    """
    spark = nodes.sparkSession
    pooled = write_table(pooled_features(graph_nodes(nodes), hops), fresh_path(spark, "pooled"))
    if named is not None:
        pooled = named.select("digest", "shape").join(pooled.withColumnRenamed("digest", "shape"), "shape").drop("shape")
    names = [c for c in pooled.columns if c != "digest"]
    vectors = VectorAssembler(inputCols=names, outputCol="pooled").transform(pooled)
    model = PCA(k=min(dim, len(names)), inputCol="pooled", outputCol="projected").fit(vectors)
    return model.transform(vectors).select(
        "digest", vector_to_array("projected", "float32").alias("embedding")
    )
