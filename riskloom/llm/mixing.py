"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is cut, in a shuffled order of its documents, into blocks of equal
word counts. Slot i of the schedule takes the i-th golden-ratio point and maps it
through the cumulative target weights to a source; the slot's rank within that
source says which block it draws. Any run of slots then holds the sources in
target proportion. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.shared import sized_broadcast, stored
from riskloom.llm.text import WORD

#: Slots use points (i * GOLDEN mod 2^31) / 2^31; GOLDEN is the odd integer nearest to 2^31 / golden ratio.
PERIOD = 2**31
GOLDEN = 1_327_217_885
GRID = 4096
#: Rows of a source table that is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Documents that are ordered together, about.
BUCKET_ROWS = 8192


@dataclass(frozen=True)
class MixParams:
    """``weights`` repeat over the sources in code point order, null last; together
    they share ``percent`` of all words; a source gives at most ``repeats`` times
    its words. ``block`` is the block length in words, ``chunk`` the slots ranked
    together in a task.
    """

    weights: tuple[int, ...] = (3, 1, 2)
    percent: int = 150
    repeats: int = 2
    block: int = 128
    chunk: int = 65_536


def source_targets(sized: DataFrame, params: MixParams) -> DataFrame:
    """(source, source_size, target, low, high) per source, from ``sized(source, size)``.

    Filling to a common level solves the resharing at once: in order of the limit
    per weight, the first k sources stop at their limit and the others share the
    rest by weight, for the smallest k at which nobody is above its limit. The
    windows run over one row per source, not over documents.
    """
    weight = F.element_at(F.array(*map(F.lit, params.weights)), (F.col("place") % len(params.weights) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").isNull(), "source")
    by_ratio = everything.orderBy("ratio", "place")
    table = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight.cast("bigint"))
        .withColumn("limit_", F.col("source_size") * params.repeats)
        .withColumn("ratio", F.col("limit_") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * params.percent / 100.0)
    )
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    table = table.withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("limit_").over(before), F.lit(0))) / F.sum("weight").over(onward)
    ).withColumn("open", F.col("level") < F.col("ratio"))
    # The first open source's level holds for all after it.
    level = F.min(F.when(F.col("open"), F.struct("ratio", "place", "level"))).over(everything)
    table = table.withColumn("first", level).withColumn(
        "target",
        F.when(
            F.col("first").isNotNull() & (F.struct("ratio", "place") >= F.struct(F.col("first.ratio"), F.col("first.place"))),
            F.col("first.level") * F.col("weight"),
        ).otherwise(F.col("limit_").cast("double")),
    )
    # A slot stands for a block; a source's blocks are as long on average as its words divided by their number.
    running = by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = F.ceil(F.col("source_size") / params.block)
    return (
        table.withColumn("n_blocks", blocks)
        .withColumn("slots", F.when(F.col("source_size") > 0, F.col("target") * blocks / F.col("source_size")).otherwise(0.0))
        .withColumn("sum_", F.sum("slots").over(running))
        .withColumn("all_", F.max("sum_").over(everything))
        .withColumn("high", F.when(F.col("all_") > 0, F.col("sum_") / F.col("all_")).otherwise(0.0))
        .withColumn("low", F.coalesce(F.lag("high").over(by_name), F.lit(0.0)))
        .select("source", "place", "source_size", "target", "n_blocks", "low", "high", "all_")
    )


def _offsets(sized: DataFrame, chunk_rows: int) -> DataFrame:
    """Adds ``start``: words of the source before the document in the shuffled order.

    Documents are ordered by a digest. Its leading bits cut a source into buckets of
    about ``chunk_rows`` rows; bucket sums give the offsets, so no task holds a source.
    """
    rows = sized.agg(F.count("*")).first()[0]
    buckets = max(64, 2 ** (max(1, rows // chunk_rows) - 1).bit_length())
    dealt = sized.withColumn("bucket", F.shiftrightunsigned("order_", 65 - buckets.bit_length()))
    sums = dealt.groupBy("place", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("place", "bucket", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("place", "bucket").orderBy("order_", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("inner_", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(sums, ["place", "bucket"])
        .withColumn("start", F.col("base") + F.col("inner_"))
        .drop("bucket", "base", "inner_")
    )


def schedule(sources: DataFrame, n_slots: int, params: MixParams) -> DataFrame:
    """(slot, place, rank): the source of every slot and the slot's rank within it.

    Ranks are counted per chunk of slots and shifted by the counts of the chunks
    before, so that a source with most slots is ranked in many tasks.
    """
    spark = sources.sparkSession
    slots = spark.range(n_slots).select(
        F.col("id").alias("slot"),
        F.expr(f"id div {params.chunk}").alias("chunk"),
        (F.pmod((F.col("id") % PERIOD) * GOLDEN, F.lit(PERIOD)) / float(PERIOD)).alias("point"),
    )
    # Points meet their source in a join on a grid cell; a source is in every cell that it reaches into.
    cell = lambda c: F.floor(c * GRID)
    reach = sources.where("high > low").select(
        "place", "low", "high", F.explode(F.sequence(cell(F.col("low")), F.least(cell(F.col("high")), F.lit(GRID - 1)))).alias("cell")
    )
    found = (
        slots.withColumn("cell", cell(F.col("point")))
        .join(sized_broadcast(reach, BROADCAST_ROWS), "cell")
        .where("low <= point and point < high")
        .select("slot", "chunk", "place")
    )
    counts = found.groupBy("place", "chunk").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("place", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1
    return (
        found.withColumn("inner_", inner)
        .join(counts, ["place", "chunk"])
        .select("slot", "place", (F.col("base") + F.col("inner_")).alias("rank"))
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mix_sources(
    docs: DataFrame,
    params: MixParams | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(documents, draws).

    ``documents``: row_id, id, print, size, source_size, target, taken, one row per row of ``docs``.
    ``draws``: slot, row_id, from_word, n_words, the pieces in schedule order.
    Null and blank texts have size 0 and are never drawn; a source without words has
    target 0. Repeated rows are separate documents. Without any word the schedule is
    empty. Columns other than the three named ones are not read.
    """
    params = params or MixParams()
    sized = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.md5(F.col(text_col)).alias("print"),
        ).withColumn("row_id", F.monotonically_increasing_id()),
        "sized",
    )
    sources = stored(source_targets(sized, params), "sources")
    total = sources.agg(F.max("all_")).first()[0] or 0.0
    names = sources.select(F.col("source").alias("s"), "place", "source_size", "target")
    named = stored(
        sized.join(sized_broadcast(names, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("order_", F.xxhash64(F.lit("mix"), "id", "print"))
        .drop("s"),
        "named",
    )
    placed = _offsets(named.where("size > 0").select("row_id", "place", "source_size", "size", "order_"), BUCKET_ROWS)
    first, last = F.expr(f"start div {params.block}"), F.expr(f"(start + size - 1) div {params.block}")
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last))).select(
        "row_id", "place", "block",
        (F.greatest(F.col("start"), F.col("block") * params.block) - F.col("start")).alias("from_word"),
        (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * params.block)
         - F.greatest(F.col("start"), F.col("block") * params.block)).alias("n_words"),
    )
    blocks = sized_broadcast(sources.select("place", "n_blocks"), BROADCAST_ROWS)
    slots = schedule(sources, round(total), params).join(blocks, "place")
    drawn = slots.where(F.col("rank") < F.col("n_blocks") * params.repeats).select(
        "slot", "place", F.expr("rank % n_blocks").alias("block")
    )
    draws = stored(drawn.join(pieces, ["place", "block"]).select("slot", "row_id", "from_word", "n_words"), "draws")
    taken = draws.groupBy("row_id").agg(F.sum("n_words").alias("taken"))
    documents = named.join(taken, "row_id", "left").select(
        "row_id", "id", "print", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )
    return documents, draws


def mixed_documents(
    docs: DataFrame, params: MixParams | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``docs`` as often as the mix draws them: rows with all their columns, whole texts.

    A document's drawn words are rounded to whole copies (only documents at the edge
    of a source's last block round at all), so it appears 0, 1 or 2 times.
    """
    documents, _ = mix_sources(docs, params, id_col, text_col, source_col)
    key = lambda i, p: F.md5(F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("-")), F.coalesce(p, F.lit("-"))))
    # Repeated rows share a key: their copies are counted in all and dealt out evenly.
    copies = documents.where("size > 0").groupBy(key(F.col("id"), F.col("print")).alias("__key")).agg(
        F.sum(F.round(F.col("taken") / F.col("size"))).cast("int").alias("__copies")
    )
    own = docs.columns
    marked = docs.withColumn("__key", key(F.col(id_col), F.md5(F.col(text_col))))
    by_key = Window.partitionBy("__key")
    marked = marked.join(copies.where("__copies > 0"), "__key").withColumns(
        {"__n": F.count("*").over(by_key), "__i": F.row_number().over(by_key.orderBy("__key")) - 1}
    )
    share = F.expr("cast((__copies * (__i + 1)) div __n - (__copies * __i) div __n as int)")
    return marked.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), share))).select(*[F.col(f"`{c}`") for c in own])
