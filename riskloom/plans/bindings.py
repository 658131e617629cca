"""Binding of the driver's tables to the library's inputs.

The driver's data is an order schema: a part is a file, its brand the repository,
an order a change, the ship date its date and the customer (mod 7) its author.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.history import NARROW, History, store_history
from riskloom.operators.labels import windowed_labels
from riskloom.operators.process import process_features
from riskloom.session import fresh_path
from riskloom.sources.tables import deal_out, table, write_table

#: Parts that are broadcast at most; more of them meet the lines by a shuffle.
FEW_PARTS = 2_000_000

# Messages by order number mod 8; the odd ones separate substring from word matches.
MESSAGES = (
    "Fix crash in parser",
    "Add docs",
    "prefix cleanup",
    "debug tooling",
    "Closes #12",
    "memory-leak in cache",
    None,
    "Refactor module",
)

FEATURES = [
    "code_churn_30d",
    "code_churn_90d",
    "commit_count_30d",
    "commit_count_90d",
    "author_count_90d",
    "fix_density",
    "days_since_last_change",
    "commit_burst_30d",
    "ownership_score",
]


def by_number(number: Column, values) -> Column:
    column = F.lit(None).cast("string")
    for i, value in reversed(list(enumerate(values))):
        column = F.when(number == i, F.lit(value)).otherwise(column)
    return column


def source_text() -> Column:
    """Program text of a change, made from the row's own numbers.

    Some rows have no text, blank text or text that does not parse.
    """
    order = F.col("l_orderkey")
    quantity = F.col("l_quantity").cast("int")
    discount = F.round(F.col("l_discount") * 100).cast("int")
    tax = F.round(F.col("l_tax") * 100).cast("int")
    function = "def f(a, b=1, *args):\n    if a:\n        return b\n    return a\n"
    klass = (
        "class C:\n    def m(self, x):\n        for i in x:\n            if i:\n"
        "                continue\n            elif x:\n                pass\n        return x\n"
    )
    guarded = "try:\n    v = 1\nexcept ValueError:\n    v = 2\n"
    text = F.concat(
        F.lit("import os\n"),
        F.repeat(F.lit("import mod_a\n"), discount % 3),
        F.repeat(F.lit(function), quantity % 4),
        F.repeat(F.lit(klass), tax % 3),
        F.when(F.col("l_suppkey") % 2 == 0, F.lit(guarded)).otherwise(F.lit("")),
        F.lit("x = "),
        F.col("l_partkey").cast("string"),
        F.lit("\n"),
    )
    return (
        F.when(order % 11 == 0, F.lit(None).cast("string"))
        .when(order % 13 == 0, F.lit("   "))
        .when(order % 17 == 0, F.lit("def broken(:"))
        .otherwise(text)
    )


def change_log(spark: SparkSession, folder: str, extra: list[Column] | None = None) -> DataFrame:
    """One row per file per change, dealt out by change if there are many."""
    lines = table(spark, folder, "lineitem")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    n_lines = lines.count()
    by_part = deal_out(lines, n_lines, "l_partkey") if parts.count() > FEW_PARTS else lines
    named = deal_out(by_part.join(parts, F.col("p_partkey") == F.col("l_partkey")), n_lines, "l_orderkey")
    brand = F.replace("p_brand", F.lit("Brand#"), F.lit(""))
    number = F.col("l_partkey").cast("string")
    added = F.col("l_quantity").cast("bigint")
    deleted = F.round(F.col("l_discount") * 100).cast("bigint")
    return (
        named.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            F.concat(F.lit("repo_"), brand).alias("repo_name"),
            F.concat(F.lit("src/b"), brand, F.lit("/p"), number, F.lit(".py")).alias("file_path"),
            F.concat(F.lit("p"), number, F.lit(".py")).alias("filename"),
            F.col("l_orderkey").alias("commit_hash"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_shipdate").alias("commit_date"),
            F.concat(
                F.lit("dev"), (F.col("o_custkey") % 7).cast("string"), F.lit("@example.org")
            ).alias("author_email"),
            by_number(F.col("l_orderkey") % 8, MESSAGES).alias("commit_message"),
            (F.col("l_returnflag") == "R").alias("is_bug_fix"),
            added.alias("lines_added"),
            deleted.alias("lines_deleted"),
            (added + deleted).alias("lines_changed"),
            *(extra or []),
        )
    )


def log_with_source(spark: SparkSession, folder: str) -> DataFrame:
    return change_log(spark, folder, [source_text().alias("source_code")])


def stored_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log with texts, its tables joined once: for queries that read it several times."""
    log = log_with_source(spark, folder).select(*NARROW, "source_code")
    return write_table(log, fresh_path(spark, "log"), compression="zstd")


def history(spark: SparkSession, folder: str) -> History:
    """The change log without texts, its three tables joined once."""
    return store_history(change_log(spark, folder))


def history_with_source(spark: SparkSession, folder: str) -> History:
    return store_history(log_with_source(spark, folder), "source_code")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return windowed_labels(change_log(spark, folder))


def feature_matrix(spark: SparkSession, folder: str, log: DataFrame | None = None) -> DataFrame:
    """Windowed labels with all activity metrics as of the window end, of the stored ``log`` if there is one.

    Every labeled file has two changes in its window, so no label row is lost.
    """
    past = history(spark, folder) if log is None else store_history(log, stored=True)
    marked = windowed_labels(past.changes, span=past.span).withColumn(
        "is_buggy", F.col("is_buggy").cast("int")
    )
    carried = ["is_buggy", "commits_in_window", "bug_fix_commits_in_window"]
    metrics = process_features(marked, past.changes, past.span, carry=carried)
    return metrics.withColumn("window_start", past.span.at(F.col("window_no") * 90))


def stored_matrix(spark: SparkSession, folder: str, log: DataFrame | None = None) -> DataFrame:
    """The matrix written once, for steps that read it several times."""
    matrix = feature_matrix(spark, folder, log).withColumnRenamed("window_end", "commit_date")
    kept = matrix.select(
        "repo_name", "file_path", "window_no", "is_buggy", "commit_date", *FEATURES
    )
    return write_table(kept, fresh_path(spark, "matrix"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Scored rows ``id, y, score`` with many tied scores."""
    customer, order = F.col("o_custkey"), F.col("o_orderkey")
    base = ((customer * 7919 + order * 104729) % 1009) / F.lit(1009.0)
    other = ((customer * 31 + order * 7907) % 1013) / F.lit(1013.0)
    positive = F.col("o_orderstatus") == "F"
    return table(spark, folder, "orders").select(
        order.alias("id"),
        positive.cast("int").alias("y"),
        F.round(F.when(positive, F.greatest(base, other)).otherwise(base), 4).alias("score"),
    )


def gappy_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """A matrix with gaps: one repository without any quantity, one sparse column."""
    lines = table(spark, folder, "lineitem")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand")
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    gap = (part % 10 == 0) | (F.col("p_brand") == "Brand#11")
    return lines.join(parts, F.col("p_partkey") == part).select(
        F.concat(F.lit("repo_"), F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("repo_name"),
        F.concat(F.lit("p"), part.cast("string")).alias("file_path"),
        order.alias("change"),
        F.col("l_linenumber").alias("line_no"),
        F.when(~gap, F.col("l_quantity")).alias("quantity"),
        F.when(order % 3 != 0, F.col("l_tax")).alias("tax"),
        F.when(order % 10 >= 6, F.col("l_extendedprice")).alias("price"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_buggy"),
    )


def modules(spark: SparkSession, folder: str) -> DataFrame:
    """Modules that match a file exactly, by bare name, or not at all."""
    key = F.col("p_partkey")
    brand = F.replace("p_brand", F.lit("Brand#"), F.lit(""))
    text = key.cast("string")
    return table(spark, folder, "part").select(
        F.when(key % 3 == 0, F.concat(F.lit("src/b"), brand, F.lit("/p"), text, F.lit(".py")))
        .when(key % 3 == 1, F.concat(F.lit("other/p"), text, F.lit(".py")))
        .otherwise(F.concat(F.lit("none_"), text))
        .alias("file_path"),
        (key % 4 == 0).cast("int").alias("is_buggy"),
    )


def benchmark_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark-style rows with the original metric names."""
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.alias("row_key"),
        F.col("p_size").cast("double").alias("loc"),
        (key % 17 + 1).cast("double").alias("v(g)"),
        F.when(key % 5 != 0, F.col("p_retailprice")).alias("v"),
        F.when(key % 7 != 0, (key % 23).cast("double")).alias("lOComment"),
        (key % 9).cast("double").alias("branchCount"),
        by_number(key % 5, ("TRUE", "no", "yes", "false", "maybe")).alias("defects"),
        F.when(key % 6 != 0, F.col("p_type")).alias("Module Kind"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", "label"
    )
