"""Rows that cannot have a partner, left out before they are shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each wanted key; about one row in so many passes without a partner.
BITS_PER_KEY = 16
#: Bits of one row of the bitmap, a fixed value of ``bitmap_construct_agg``.
ROW_BITS = 32_768
#: Rows of the bitmap, 4 kB each: at most 32 MB are sent. With many more keys than bits, more rows pass.
MOST_ROWS = 8_192


def _bit(rows: DataFrame, keys: Sequence[str], n_bits: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in keys]), F.lit(n_bits))


def may_be_among(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` without those whose ``keys`` are certainly not in ``wanted``; nulls are equal.

    A bitmap of the keys' digests is sent to all tasks. No row with a partner is lost; a few
    without one stay, so an exact join has to follow. ``wanted`` is read twice and should be a
    stored table with keys of the same types.
    """
    asked, bitmap_rows = wanted.count() * BITS_PER_KEY, 1
    while bitmap_rows < MOST_ROWS and bitmap_rows * ROW_BITS < asked:
        bitmap_rows *= 2
    n_bits = bitmap_rows * ROW_BITS
    marks = wanted.select(_bit(wanted, keys, n_bits).alias("__bit")).distinct()
    # Dealt out first: partial bitmaps of every task would be far larger than the bits themselves.
    marks = marks.select(F.floor(F.col("__bit") / ROW_BITS).alias("__mark"), (F.col("__bit") % ROW_BITS).alias("__place"))
    bitmap = marks.repartition("__mark").groupBy("__mark").agg(F.bitmap_construct_agg("__place").alias("__bits"))
    bit = _bit(rows, keys, n_bits)
    tagged = rows.withColumns({"__bitmap_row": F.floor(bit / ROW_BITS), "__bitmap_place": (bit % ROW_BITS).cast("int")})
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(F.col("__bitmap_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.getbit(byte, F.col("__bitmap_place") % 8) == 1
    return tagged.join(F.broadcast(bitmap), (F.col("__bitmap_row") == F.col("__mark")) & marked, "left_semi").drop("__bitmap_row", "__bitmap_place")
