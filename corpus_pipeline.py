"""From raw documents to token files: each stage works on what the one before kept."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from riskloom.llm.decontamination import contaminated  # noqa: E402
from riskloom.llm.mixing import mixed_documents  # noqa: E402
from riskloom.llm.near_duplicates import without_near_duplicates  # noqa: E402
from riskloom.llm.queries import table, token_params, training_rows  # noqa: E402
from riskloom.llm.shared import sized_broadcast, stored  # noqa: E402
from riskloom.llm.token_files import token_files  # noqa: E402
from riskloom.llm.toxicity import fit_toxicity, without_toxic  # noqa: E402

#: Contaminated ids that are broadcast; more are joined by a shuffle.
IDS_SENT = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; all columns and rows else."""
    model = fit_toxicity(training_rows(docs, table(spark, sf_dir, "labels")))
    return without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    return without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, verbatim or with other parameters."""
    found = stored(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "contaminated")
    return docs.join(sized_broadcast(found, IDS_SENT), "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them."""
    return mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the written token files."""
    return token_files(docs, token_params())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_files", write_tokens),
]

#: Model scores, hashed bands and token ids have no SQL form; the tests hold run() against the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir).select(
        "doc_id", "start", "n_tokens", F.col("ids_crc32")
    )
