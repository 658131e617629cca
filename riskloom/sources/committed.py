"""Tables that change by whole partitions, in one step.

New partitions are staged in a folder of their own. One small commit file, created at
the end, then says which folder holds each partition; partitions it does not replace
keep theirs. A reader follows the newest complete commit, so a run that is lost before
its commit leaves the old table, and a rerun replaces the same partitions again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column that names a row's partition in the folders; the table's own columns stay in the files.
_FOLDER = "__partition"


def _file_system(spark: SparkSession, path: str):
    # Spark has no call of its own that creates a file only if it is new, on any file system.
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _listed(spark: SparkSession, path: str) -> list[str]:
    fs, as_path = _file_system(spark, path)
    folder = as_path(path)
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def _newest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest complete commit; number 0 if there is none."""
    numbers = [int(n.split(".")[0]) for n in _listed(spark, f"{path}/commits") if n.endswith(".json")]
    for number in sorted(numbers, reverse=True):
        lines = spark.read.text(f"{path}/commits/{number:012d}.json", wholetext=True).collect()
        try:
            return max(numbers), json.loads(lines[0][0])
        except (IndexError, ValueError):
            continue  # a writer was lost while it wrote this file
    return max(numbers, default=0), {"schema": None, "partitions": {}}


def read_committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as of its newest commit, or None if nothing was ever committed."""
    _, state = _newest(spark, path)
    if state["schema"] is None:
        return None
    schema = spark.createDataFrame([], "x int").schema.fromJson(json.loads(state["schema"]))
    folders = [f"{path}/data/{version}/{partition}" for partition, version in sorted(state["partitions"].items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def stage(rows: DataFrame, path: str, partition: str) -> str:
    """Write ``rows`` by partition into a new folder that no reader sees; returns its name."""
    version = uuid.uuid4().hex
    # Each partition is written by few tasks; a large one is split by size.
    folder = F.coalesce(F.concat(F.lit("v"), F.col(partition).cast("string")), F.lit("null"))
    dealt = rows.withColumn(_FOLDER, folder).hint("rebalance", _FOLDER)
    dealt.write.partitionBy(_FOLDER).parquet(f"{path}/data/{version}")
    return version


def commit(spark: SparkSession, path: str, version: str, schema, expected: int) -> None:
    """Make the staged partitions the current ones; fails if someone else committed since ``expected``."""
    _, state = _newest(spark, path)
    fresh = [n for n in _listed(spark, f"{path}/data/{version}") if n.startswith(f"{_FOLDER}=")]
    partitions = {**state["partitions"], **dict.fromkeys(fresh, version)}
    content = json.dumps({"schema": schema.json(), "partitions": partitions})
    fs, as_path = _file_system(spark, path)
    out = fs.create(as_path(f"{path}/commits/{expected + 1:012d}.json"), False)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def write_committed(rows: DataFrame, path: str, partition: str, before_commit: Callable[[], None] = lambda: None) -> DataFrame:
    """Replace the partitions that ``rows`` has (others stay), and return the whole table."""
    spark = rows.sparkSession
    number, _ = _newest(spark, path)
    version = stage(rows, path, partition)
    before_commit()
    commit(spark, path, version, rows.schema, number)
    return read_committed(spark, path)


def merge_committed(
    new: DataFrame, path: str, merge: Callable[[DataFrame, DataFrame], DataFrame], partition: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Upsert ``new`` into the table: ``merge(existing, new)`` on the partitions that ``new`` touches only."""
    spark = new.sparkSession
    existing = read_committed(spark, path)
    wanted = new if columns is None else new.select(*columns)
    if existing is None:
        existing = spark.createDataFrame([], wanted.schema)
    touched = wanted.select(F.col(partition).alias("__touched")).distinct()
    near = existing.join(touched, F.col(partition).eqNullSafe(F.col("__touched")), "left_semi")
    return write_committed(merge(near, wanted), path, partition)
