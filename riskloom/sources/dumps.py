"""Text dumps of a version history, read line by line.

A dump is a sequence of header lines, each followed by the paths it touched. The
reader keeps the dump splittable: every line carries its dump, the split it came
from and its place in it, and a header is carried into the next split through a
one-row-per-split summary instead of one ordered pass over the whole dump.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.timing import as_naive_utc
from riskloom.sources.tables import deal_out


def read_dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one or many dump files: ``dump_id, chunk, pos, line``."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("dump_id"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
    )


def carry_headers(lines: DataFrame, header: Column, n_lines: int | None = None) -> DataFrame:
    """Add ``header``: the latest header at or before each line of its dump.

    ``n_lines`` says about how many lines there are (default: they are counted); many are
    dealt out by split, so that a task's share does not grow with the dump.
    """
    if n_lines is None:
        n_lines = lines.count()
    tagged = deal_out(lines.withColumn("__own", header), n_lines, "dump_id", "chunk")
    inside = (
        Window.partitionBy("dump_id", "chunk")
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = tagged.withColumn("__local", F.last("__own", ignorenulls=True).over(inside))
    ends = tagged.groupBy("dump_id", "chunk").agg(
        F.max_by("__own", F.when(F.col("__own").isNotNull(), F.col("pos"))).alias("__end")
    )
    earlier = (
        Window.partitionBy("dump_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = ends.select(
        "dump_id", "chunk", F.last("__end", ignorenulls=True).over(earlier).alias("__carry")
    )
    return (
        local.join(carried, ["dump_id", "chunk"])
        .withColumn("header", F.coalesce("__local", "__carry"))
        .drop("__own", "__local", "__carry")
    )


def parse_change_dump(lines: DataFrame, n_lines: int | None = None) -> DataFrame:
    """``hash|author|date|subject`` headers and source paths to change rows.

    The subject may itself hold bars; paths before any header are dropped.
    """
    text = F.trim("line")
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    is_header = bars >= 2
    parts = F.split("header", r"\|", 4)
    carried = carry_headers(lines, F.when(is_header, text), n_lines)
    return carried.filter(
        F.col("header").isNotNull() & ~is_header & F.endswith(text, F.lit(".py"))
    ).select(
        "dump_id",
        F.get(parts, F.lit(0)).alias("commit_hash"),
        F.get(parts, F.lit(1)).alias("author_email"),
        as_naive_utc(F.get(parts, F.lit(2))).alias("commit_date"),
        F.coalesce(F.get(parts, F.lit(3)), F.lit("")).alias("commit_message"),
        text.alias("file_path"),
    )


def parse_date_dump(lines: DataFrame, n_lines: int | None = None) -> DataFrame:
    """Date lines followed by paths, newest first: first date seen per path.

    ``chunk`` and ``pos`` order the dump, so "first seen" is the smallest pair.
    """
    text = F.trim("line")
    is_date = text.rlike(r"^.{4}-.{2}-.{3,}") & F.substring(text, 1, 19).try_cast("timestamp").isNotNull()
    if n_lines is None:
        n_lines = lines.count()
    carried = carry_headers(lines, F.when(is_date, F.substring(text, 1, 10)), n_lines)
    paths = carried.filter(F.col("header").isNotNull() & ~is_date & F.endswith(text, F.lit(".py")))
    paths = paths.select("dump_id", text.alias("file_path"), "header", "chunk", "pos")
    return (
        deal_out(paths, n_lines, "dump_id", "file_path")
        .groupBy("dump_id", "file_path")
        .agg(F.min_by("header", F.struct("chunk", "pos")).alias("__d"))
        .select("dump_id", "file_path", F.col("__d").cast("date").cast("timestamp_ntz").alias("last_seen"))
    )
