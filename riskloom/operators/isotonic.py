"""Isotonic calibration: the nearest non-decreasing map from scores to observed frequencies.

Pooling adjacent violators gives the same blocks in whatever order neighbours are
pooled. So ranges of scores are pooled by themselves, each with a stack, and what is
left are few blocks; ranges are then cut anew between the old cuts and pooled again,
until no two neighbours are in the wrong order. Sums of labels are integers, so every
comparison is exact and a recomputed task pools the same blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.ordering import value_cuts, with_cut_bucket
from riskloom.session import fresh_path
from riskloom.sources.tables import write_table

#: Blocks that one task pools at a time.
RANGE_ROWS = 200_000
#: Score ranges of the lookup; cut points alone reach the driver.
LOOKUP_RANGES = 256

BLOCK = "lo double, hi double, positives bigint, rows bigint"
_NAMES = ["lo", "hi", "positives", "rows"]


def _pool_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of their range; a block no higher than the one before is pooled with it."""
    current, stack = None, []

    def done() -> pa.RecordBatch:
        out = [*zip(*stack, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.float64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())],
            names=_NAMES,
        )

    for batch in batches:
        for part, lo, hi, positives, rows in zip(*(batch.column(c).to_pylist() for c in ("part", *_NAMES)), strict=True):
            if part != current:
                if stack:
                    yield done()
                current, stack = part, []
            while stack and stack[-1][2] * rows >= positives * stack[-1][3]:
                lo, _, p, r = stack.pop()
                positives, rows = positives + p, rows + r
            stack.append((lo, hi, positives, rows))
    if stack:
        yield done()


def _pooled(blocks: DataFrame, cuts: list[float], n_parts: int) -> DataFrame:
    parts = with_cut_bucket(blocks, "lo", "part", cuts).repartition(n_parts, "part")
    ordered = parts.sortWithinPartitions("part", "lo").select("part", *_NAMES)
    return write_table(ordered.mapInArrow(_pool_batches, BLOCK), fresh_path(blocks.sparkSession, "isotonic-blocks"))


def _in_order(blocks: DataFrame, cuts: list[float]) -> bool:
    """Whether the blocks at the cuts rise; those inside a range do already. One row per range is compared."""
    ranges = with_cut_bucket(blocks, "lo", "part", cuts)
    level = F.struct(F.col("positives").alias("p"), F.col("rows").alias("r"))
    edges = ranges.groupBy("part").agg(F.min_by(level, "lo").alias("first"), F.max_by(level, "lo").alias("last"))
    ahead = F.lag("last").over(Window.orderBy("part"))
    wrong = F.col("b.p").cast("decimal(38,0)") * F.col("first.r") >= F.col("first.p").cast("decimal(38,0)") * F.col("b.r")
    return edges.select("first", ahead.alias("b")).where("b is not null").where(wrong).isEmpty()


def isotonic_blocks(fit_on: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``lo, hi, positives, rows``: the pooled blocks of ``fit_on(score, y)``, rising strictly in positives / rows.

    Rows without a score or label take no part, nor does NaN. Rows of equal score are one
    block from the start. At most about ``range_rows`` blocks are pooled by a task.
    """
    known = fit_on.where(F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")) & F.col("y").isNotNull())
    score = F.col("score").cast("double")
    per_score = known.groupBy(score.alias("lo")).agg(F.sum(F.col("y").cast("bigint")).alias("positives"), F.count(F.lit(1)).alias("rows"))
    blocks = write_table(per_score.select("lo", F.col("lo").alias("hi"), "positives", "rows"), fresh_path(fit_on.sparkSession, "isotonic-scores"))
    shifted = False
    while True:
        n_parts = -(-blocks.count() // range_rows) or 1
        # Every other round cuts in the middle of the ranges of the round before.
        cuts = value_cuts(blocks, "lo", n_parts, 0.5 if shifted else 0.0)
        blocks = _pooled(blocks, cuts, n_parts)
        if not cuts or _in_order(blocks, cuts):
            return blocks
        shifted = not shifted


def apply_blocks(rows: DataFrame, blocks: DataFrame, out: str = "calibrated", n_ranges: int = LOOKUP_RANGES) -> DataFrame:
    """Add ``out``: the block's level inside a block, the straight line between two blocks, the outer level beyond them.

    Distinct scores and block ends are ordered together per range of scores; what a
    range needs of the blocks outside comes from one row per range. A null or NaN score,
    or an empty set of blocks, gives null.
    """
    score = F.col("score").cast("double")
    asked = rows.where(F.col("score").isNotNull() & ~F.isnan(score)).select(score.alias("at")).distinct()
    level = F.col("positives") / F.col("rows")
    ends = blocks.select(F.explode(F.array("lo", "hi")).alias("at"), level.alias("level")).distinct()
    cuts = value_cuts(ends, "at", n_ranges)
    knot = F.struct("at", "level")
    both = ends.select("at", "level", knot.alias("knot")).unionByName(
        asked.select("at", F.lit(None).cast("double").alias("level")), allowMissingColumns=True
    )
    placed = with_cut_bucket(both, "at", "part", cuts)
    edges = placed.groupBy("part").agg(F.min("knot").alias("first"), F.max("knot").alias("last"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    outside = edges.select("part", F.max("last").over(ahead).alias("before"), F.min("first").over(after).alias("beyond"))
    up = Window.partitionBy("part").orderBy("at")
    below = F.last("knot", ignorenulls=True).over(up.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.first("knot", ignorenulls=True).over(up.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    found = placed.select("part", "at", "knot", below.alias("below"), above.alias("above")).where("knot is null")
    found = found.join(F.broadcast(outside), "part").select(
        "at", F.coalesce("below", "before").alias("l"), F.coalesce("above", "beyond").alias("r")
    )
    width = F.col("r.at") - F.col("l.at")
    line = F.col("l.level") + (F.col("r.level") - F.col("l.level")) * (F.col("at") - F.col("l.at")) / width
    value = F.when(F.col("l").isNull(), F.col("r.level")).when(F.col("r").isNull() | (width == 0), F.col("l.level")).otherwise(line)
    mapped = found.select(F.col("at").alias("__at"), value.alias(out))
    return rows.join(mapped, score == F.col("__at"), "left").drop("__at")


def calibrate_isotonic(fit_on: DataFrame, apply_to: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``apply_to`` with ``calibrated``, fitted on ``fit_on(score, y)``."""
    return apply_blocks(apply_to, isotonic_blocks(fit_on, range_rows))
