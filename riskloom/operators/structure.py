"""Structure metrics of source text.

Parsing is the only Python step: one Arrow stage turns each distinct text into
node rows. Every metric is a DataFrame aggregation over those rows. Texts that
differ in whole numbers only have the same tree: metrics and embeddings parse one
of them.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import not_blank
from riskloom.session import fresh_path
from riskloom.sources.tables import write_table

# Node types that open a nesting level.
NESTING_TYPES = (
    "If", "For", "While", "With", "Try", "AsyncFor", "AsyncWith",
    "FunctionDef", "AsyncFunctionDef", "ClassDef",
)
# Node types of functions, imports, branches and of cognitive load.
FUNCTION_TYPES = ("FunctionDef", "AsyncFunctionDef")
IMPORT_TYPES = ("Import", "ImportFrom")
BRANCH_TYPES = ("If", "For", "While", "Try", "ExceptHandler", "With", "Assert")
COGNITIVE_TYPES = ("If", "For", "While", "ExceptHandler")

NODE_SCHEMA = (
    "digest string, idx int, parent_idx int, type string, depth int, nesting int, "
    "n_children int, lineno int, end_lineno int, n_args int, n_plain_args int"
)
ARROW_SCHEMA = pa.schema(
    [
        (part.split()[0], pa.string() if part.endswith("string") else pa.int32())
        for part in NODE_SCHEMA.split(", ")
    ]
)
ROWS_PER_BATCH = 50_000


def _arguments(node: ast.AST) -> tuple[int | None, int | None]:
    if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        return None, None
    a = node.args
    extra = (a.vararg is not None) + (a.kwarg is not None)
    return len(a.args) + len(a.posonlyargs) + len(a.kwonlyargs) + extra, len(a.args)


def _node_rows(digest: str, text: str) -> list[tuple]:
    """Nodes of one text in depth-first order; nothing if it does not parse."""
    try:
        root = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    rows: list[tuple] = []
    pending = [(root, None, 0, 0)]
    while pending:
        node, parent, depth, above = pending.pop()
        children = list(ast.iter_child_nodes(node))
        kind = type(node).__name__
        nesting = above + (kind in NESTING_TYPES)
        idx = len(rows)
        rows.append(
            (
                digest,
                idx,
                parent,
                kind,
                depth,
                nesting,
                len(children),
                getattr(node, "lineno", None),
                getattr(node, "end_lineno", None),
                *_arguments(node),
            )
        )
        pending.extend((child, idx, depth + 1, nesting) for child in reversed(children))
    return rows


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), ARROW_SCHEMA.types)]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW_SCHEMA)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node rows, handed back in batches of bounded size."""
    rows: list[tuple] = []
    for batch in batches:
        for digest, text in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
            rows += _node_rows(digest, text)
            if len(rows) >= ROWS_PER_BATCH:
                yield _as_batch(rows)
                rows = []
    if rows:
        yield _as_batch(rows)


def spread(texts: DataFrame) -> DataFrame:
    """Texts dealt out by count: parsing is far slower than reading, so partitions merged by bytes would idle cores."""
    spark = texts.sparkSession
    wide = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
    return texts.repartition(wide)


def distinct_sources(sources: DataFrame, text: str = "source_code") -> DataFrame:
    """Each distinct non-blank text once: ``digest, source_code``; copies collapse before the first shuffle.

    Both columns are grouped by, so that copies collapse in a hash table: kept as a value, a text would have all
    rows sorted first.
    """
    texts = sources.filter(not_blank(F.col(text))).select(F.sha2(text, 256).alias("digest"), F.col(text).alias("source_code"))
    return spread(texts.distinct())


#: A whole number of at most 18 digits that stands alone. Not after "-": the names of ``\\N{...}`` may hold such numbers.
WHOLE_NUMBER = r"[1-9](?<![-\w\P{ASCII}].)[0-9]{0,17}(?![\w\P{ASCII}])"


def shape_text(text: Column) -> Column:
    """``text`` with 1 for its whole numbers: another text of the same tree, on the same lines."""
    return F.regexp_replace(text, WHOLE_NUMBER, "1")


def shape_digest(text: Column) -> Column:
    """Names the tree of a non-blank text; null for others."""
    return F.when(not_blank(text), F.sha2(shape_text(text), 256))


def distinct_shapes(sources: DataFrame, text: str = "source_code") -> DataFrame:
    """One text for all texts that differ in whole numbers only: ``digest`` (the shape's), ``source_code``."""
    shapes = sources.filter(not_blank(F.col(text))).select(shape_text(F.col(text)).alias("source_code"))
    return distinct_sources(shapes)


def ast_nodes(distinct: DataFrame) -> DataFrame:
    """Node rows of every text that parses."""
    return distinct.select("digest", "source_code").mapInArrow(_parse_batches, NODE_SCHEMA)


def structure_metrics(nodes: DataFrame, variant: str = "nesting") -> DataFrame:
    """One row of metrics per parsed text.

    ``nesting``: control-flow nesting, all argument kinds, 4-place mean length.
    ``tree``: raw tree depth, plain arguments only, 2-place mean length.
    """
    kind = F.col("type")
    is_function = kind.isin(*FUNCTION_TYPES)
    length = F.greatest(F.col("end_lineno") - F.col("lineno") + 1, F.lit(1))
    depth, arguments, places = (
        ("nesting", "n_args", 4) if variant == "nesting" else ("depth", "n_plain_args", 2)
    )
    return nodes.groupBy("digest").agg(
        (F.count_if(kind.isin(*BRANCH_TYPES)) + 1).alias("cyclomatic_complexity"),
        F.count_if(kind.isin(*COGNITIVE_TYPES)).alias("cognitive_complexity"),
        F.max(depth).cast("bigint").alias("max_nesting_depth"),
        F.count_if(is_function).alias("num_functions"),
        F.count_if(kind == "ClassDef").alias("num_classes"),
        F.round(F.coalesce(F.avg(F.when(is_function, length)), F.lit(0.0)), places).alias(
            "avg_function_length"
        ),
        F.count_if(kind.isin(*IMPORT_TYPES)).alias("num_imports"),
        F.count(F.lit(1)).alias("ast_node_count"),
        F.max((kind == "Try").cast("int")).alias("has_try_except"),
        F.coalesce(F.max(arguments), F.lit(0)).cast("bigint").alias("max_args_per_function"),
    )


METRIC_NAMES = (
    "cyclomatic_complexity", "cognitive_complexity", "max_nesting_depth", "num_functions",
    "num_classes", "avg_function_length", "num_imports", "ast_node_count", "has_try_except",
    "max_args_per_function",
)


def _filled(rows: DataFrame, shapes: DataFrame, usable: Column, variant: str, missing: str) -> DataFrame:
    """``rows`` with the metrics of the texts that their column ``__shape`` names.

    The metrics are stored, so that few of them are broadcast and the rows stay where they are.
    """
    metrics = structure_metrics(ast_nodes(shapes), variant)
    metrics = write_table(metrics, fresh_path(rows.sparkSession, "structure-metrics")).withColumnRenamed("digest", "__shape")
    # Rows without a text keep apart: null keys would meet in one task.
    alone = F.concat(F.lit("-"), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("string"))
    keyed = rows.withColumns({"__usable": usable, "__shape": F.coalesce("__shape", alone)})
    filled = {}
    for name in METRIC_NAMES:
        zero = F.lit(0).cast(metrics.schema[name].dataType)
        value = F.coalesce(F.col(name), zero)
        filled[name] = value if missing == "zero" else F.when(F.col("__usable"), value)
    return keyed.join(metrics, "__shape", "left").withColumns(filled).drop("__shape", "__usable")


def structure_by_digest(rows: DataFrame, shapes: DataFrame, variant: str = "nesting", missing: str = "null") -> DataFrame:
    """Metrics for rows that name their text by ``digest`` and its tree by ``shape``; ``shapes`` holds a text per tree.

    ``missing``: ``null`` keeps rows without a text empty and gives zeros to texts
    that do not parse; ``zero`` gives zeros to both. The rows never carry a text.
    """
    return _filled(rows.withColumnRenamed("shape", "__shape"), spread(shapes), F.col("digest").isNotNull(), variant, missing)


def structure_for(
    rows: DataFrame, text: str = "source_code", variant: str = "nesting", missing: str = "null"
) -> DataFrame:
    """Metrics for every row of ``rows``, parsing each distinct tree once."""
    keyed = rows.withColumn("__shape", shape_digest(F.col(text)))
    usable = F.coalesce(not_blank(F.col(text)), F.lit(False))
    return _filled(keyed, distinct_shapes(rows, text), usable, variant, missing)


def nodes_summary(nodes: DataFrame) -> DataFrame:
    """Node rows per type, to compare two parses."""
    return nodes.groupBy("type").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.max("depth").alias("max_depth"),
        F.max("nesting").alias("max_nesting"),
    )


