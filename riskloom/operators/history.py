"""A change log stored once, in the form that all operators per file read."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import not_blank
from riskloom.operators.labels import Span
from riskloom.operators.structure import shape_digest, shape_text
from riskloom.session import fresh_path
from riskloom.sources.tables import write_table

KEYS = ("repo_name", "file_path")
NARROW = (*KEYS, "commit_hash", "author_email", "commit_date", "lines_changed", "is_bug_fix")
#: Changes of one file that a task may read alone; a log with a larger file is stored without buckets.
FILE_ROWS = 20_000_000
#: Changes of a bucket on average: what a task holds does not grow with the log.
BUCKET_ROWS = 200_000
MOST_BUCKETS = 50_000
#: Ends the digest of a blank text: the revision takes part as any other, but there is nothing to fetch.
BLANK = "-"


@dataclass(frozen=True)
class History:
    """``changes``: one narrow row per change, without texts; ``digest`` names its text, if texts were asked for.

    With ``buckets``, the table is dealt out and sorted by file: aggregations, windows
    and joins by file need no shuffle. Without (a file has too many changes), they
    combine before their shuffles as on any other table. Results are the same.
    """

    changes: DataFrame
    span: Span
    buckets: int | None = None
    whole: DataFrame | None = None

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` dealt out by file like the changes, so that both meet without another shuffle."""
        return rows if self.buckets is None else rows.repartition(self.buckets, *KEYS)

    def fetched(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the ``source_code`` of their ``digest``.

        Texts and rows meet by the bytes of the digest, which are half as long as its name.
        """
        keyed = rows.withColumn("__at", F.unhex("digest"))
        asked = keyed.select("__at").where(F.col("__at").isNotNull()).distinct()
        text = F.col("source_code")
        texts = self.whole.where(not_blank(text)).select(F.unhex(F.sha2(text, 256)).alias("__at"), text)
        wanted = texts.join(asked, "__at", "left_semi").dropDuplicates(["__at"])
        found = keyed.join(wanted, "__at", "left")
        return found.select("digest", *[c for c in rows.columns if c != "digest"], "source_code")


    def shapes(self, rows: DataFrame) -> DataFrame:
        """``digest, source_code``: one text for each tree that the ``shape`` of ``rows`` names."""
        asked = rows.select("shape").where(F.col("shape").isNotNull()).distinct()
        text = F.col("source_code")
        named = self.whole.where(F.col("shape").isNotNull()).select("shape", text, F.xxhash64(text).alias("__text"))
        # Any text of a tree will do. They are chosen by numbers and stored, so that the texts of few trees stay where they are.
        chosen = named.groupBy("shape").agg(F.min("__text").alias("__text")).join(asked, "shape", "left_semi")
        chosen = write_table(chosen, fresh_path(rows.sparkSession, "chosen-texts"))
        own = named.join(chosen, ["shape", "__text"], "left_semi")
        return own.select(F.col("shape").alias("digest"), shape_text(text).alias("source_code")).distinct()


def _text_digest(text: str) -> Column:
    digest = F.sha2(text, 256)
    return F.when(not_blank(F.col(text)), digest).otherwise(F.concat(digest, F.lit(BLANK)))


def _packed(digest: Column) -> Column:
    """A digest as bytes, half as long; the mark of a blank text stays behind them."""
    return F.concat(F.unhex(F.substring(digest, 1, 64)), F.substring(digest, 65, 1).cast("binary"))


def _unpacked(packed: Column) -> Column:
    return F.concat(F.lower(F.hex(F.substring(packed, 1, 32))), F.substring(packed, 33, 1).cast("string"))


def store_history(
    log: DataFrame,
    text: str | None = None,
    buckets: int | None = None,
    file_rows: int = FILE_ROWS,
    shapes: bool = False,
    stored: bool = False,
) -> History:
    """Run the plan of ``log`` once and keep its narrow columns, by file.

    ``text`` names the column of source texts. They are stored beside the changes in the
    same pass; only their digests are dealt out by file, as bytes. With ``shapes``
    there is a second digest, which names the tree of the text. A log without texts that
    is a ``stored`` table already is not written once more.
    """
    spark = log.sparkSession
    columns = [c for c in NARROW if c in log.columns]
    with_text = [F.col(text).alias("source_code")] if text else []
    if text and shapes:
        with_text.append(shape_digest(F.col(text)).alias("shape"))
    whole = log.select(*columns, *with_text)
    if text or not stored:
        whole = write_table(whole, fresh_path(spark, "history"))
    packed = {"digest": _packed(_text_digest("source_code"))} if text else {}
    narrow = whole.withColumns(packed).drop("source_code")
    names = {"digest": _unpacked(F.col("digest"))} if text else {}
    dates = F.min("commit_date").alias("lo"), F.max("commit_date").alias("hi")
    per_file = narrow.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), *dates)
    size = per_file.agg(F.max("n").alias("largest"), F.sum("n").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    span = Span.of(size["lo"], size["hi"])
    if (size["largest"] or 0) > file_rows:
        return History(narrow.withColumns(names), span, None, whole)
    if buckets is None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = min(max(least, (size["rows"] or 0) // BUCKET_ROWS), MOST_BUCKETS)
    name = f"history_{uuid.uuid4().hex}"
    dealt = narrow.repartition(buckets, *KEYS).sortWithinPartitions(*KEYS)
    writer = dealt.write.format("parquet").bucketBy(buckets, *KEYS).sortBy(*KEYS)
    writer.option("path", fresh_path(spark, "history-by-file")).saveAsTable(name)
    return History(spark.table(name).withColumns(names), span, buckets, whole)
