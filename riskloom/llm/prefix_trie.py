"""The trie of conversation prefixes: which openings are shared, by whom, and what sharing saves.

The digest of a prefix is the exclusive or of one 128-bit value per (place, turn),
so prefixes of a conversation of any length come from running totals inside blocks
of turns plus one offset per block, and a parent's digest is its child's without
the child's own turn.

Most prefixes are held by one conversation. A count-min sketch of all prefix digests
never counts too little, so an estimate of one proves it: below such a node the rest
of the conversation is a chain, and its nodes are emitted where their rows are. Only
prefixes that may be shared are shuffled and grouped exactly. The sketch has a bounded
size; if it is too small for the data, more prefixes are grouped and the result is the same.

Sums over subtrees need no walk. A conversation owns the nodes of which it is the
smallest member, and these are the deepest of its path; so what it adds to the sums of
the nodes above follows from two numbers per conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.shared import sized_broadcast, stored
from riskloom.llm.text import WORD


@dataclass(frozen=True)
class TrieParams:
    """``group``: ids that share a base conversation, whose id is the multiple of ``group`` below theirs.

    ``heads``: a conversation takes crc32(id) modulo ``heads`` turns from its base.
    ``cells_per_prefix`` and ``most_cells`` size each of the two rows of the sketch
    (2 bits a cell in a task, 1 bit a cell when sent). ``block_bits``: turns whose
    numbers agree above these bits are put in order together. The sizes change no result.
    """

    group: int = 20
    heads: int = 4
    cells_per_prefix: int = 8
    most_cells: int = 2**26
    block_bits: int = 8


KEY = ["depth", "k1", "k2"]
#: Cells per row of the merged sketch; ids per string of ends.
SKETCH_BLOCK = 2**16
ENDS_BITS = 12
#: Block offsets of long conversations that are broadcast; more are joined by a shuffle.
OFFSETS_SENT = 1_000_000


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def _narrow_turns(conversations: DataFrame, params: TrieParams) -> DataFrame:
    """Turns without their texts: a digest of (role, text), the number of words, a block of places."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turn = F.col("turn").cast("long")
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), role.alias("role"),
        F.unhex(F.md5(content)).alias("print"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        # Turns without a number form the first block.
        F.coalesce(F.shiftright(turn, params.block_bits), F.lit(-(2**63))).alias("block"),
    )




def _in_order(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.asc_nulls_first("turn"), "role", "print")


def _own_value(depth: Column) -> list[Column]:
    """Two 64-bit values of a turn at its place."""
    return [F.xxhash64(depth, "print"), F.xxhash64("print", depth, F.lit(1))]


def _conversations(turns: DataFrame, blocks: DataFrame, params: TrieParams) -> tuple[DataFrame, DataFrame]:
    """Per conversation the turns taken from its base and its rebuilt length; and the prefixes of up to three base turns."""
    id_ = F.col("conv_id")
    first = turns.where(id_ % params.group == 0).withColumn("n", F.row_number().over(_in_order("conv_id")))
    first = first.where(F.col("n") < params.heads).withColumn("depth", F.col("n").cast("long"))
    for name, value in zip(("a", "b"), _own_value(F.col("depth")), strict=True):
        first = first.withColumn(name, value)
    sofar = Window.partitionBy("conv_id").orderBy("depth")
    base = first.select(
        F.col("conv_id").alias("base"), "depth", "words", F.bit_xor("a").over(sofar).alias("k1"), F.bit_xor("b").over(sofar).alias("k2"),
        "a", "b", F.sum("words").over(sofar).alias("sofar"),
    )
    base = stored(base.select("*", F.col("k1").bitwiseXOR(F.col("a")).alias("p1"), F.col("k2").bitwiseXOR(F.col("b")).alias("p2")), "base-turns")
    of_base = base.groupBy("base").agg(F.count("*").alias("there"))
    totals = blocks.groupBy("conv_id").agg(F.max("total").alias("total"))
    skip = F.when(id_ % params.group == 0, 0).otherwise(F.crc32(id_.cast("string")) % params.heads)
    each = totals.select("conv_id", "total", (id_ - id_ % params.group).alias("base"), skip.alias("skip")).join(of_base, "base", "left")
    each = each.withColumn("taken", F.least("skip", F.coalesce("there", F.lit(0))))
    head = base.select("base", F.col("depth").alias("taken"), F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.col("sofar").alias("head_words"))
    each = each.join(head, ["base", "taken"], "left").select(
        "conv_id", "base", "skip", "taken",
        (F.col("taken") + F.greatest(F.col("total") - F.col("skip"), F.lit(0))).alias("n_turns"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("h1", "h2", "head_words")],
    )
    return stored(each, "conversations"), base


def prefixes(conversations: DataFrame, params: TrieParams) -> tuple[DataFrame, DataFrame]:
    """Every (rebuilt conversation, depth >= 1) with the digests of its prefix and its parent; and the conversations."""
    turns = stored(_narrow_turns(conversations, params), "turns")
    whole = Window.partitionBy("conv_id")
    ahead = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    blocks = stored(
        counts.select(
            "conv_id", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"),
            (F.count("*").over(whole) > 1).alias("long"),
        ),
        "blocks",
    )
    each, base = _conversations(turns, blocks, params)
    plan = blocks.join(each, "conv_id").drop("total", "base")
    place = F.col("before") + F.row_number().over(_in_order("conv_id", "block")) - 1
    placed = turns.join(plan, ["conv_id", "block"]).withColumn("place", place).where("place >= skip")
    placed = placed.withColumn("depth", F.col("taken") + F.col("place") - F.col("skip") + 1)
    for name, value in zip(("a", "b"), _own_value(F.col("depth")), strict=True):
        placed = placed.withColumn(name, value)
    sofar = Window.partitionBy("conv_id", "block").orderBy("place")
    running = placed.select(
        "conv_id", "block", "long", "depth", "words", "a", "b", "n_turns", "h1", "h2", "head_words",
        F.bit_xor("a").over(sofar).alias("x1"), F.bit_xor("b").over(sofar).alias("x2"), F.sum("words").over(sofar).alias("xw"),
    )
    own = stored(
        running.select(
            "conv_id", "block", "long", "depth", "words", "a", "b", (F.col("depth") == F.col("n_turns")).alias("last"),
            F.col("x1").bitwiseXOR(F.col("h1")).alias("k1"), F.col("x2").bitwiseXOR(F.col("h2")).alias("k2"),
            (F.col("xw") + F.col("head_words")).alias("sofar"), "x1", "x2", "xw",
        ),
        "own-turns",
    )
    long = own.where("long")
    if not long.isEmpty():
        ends = long.groupBy("conv_id", "block").agg(F.max_by(F.struct("x1", "x2", "xw"), "depth").alias("e"))
        offsets = ends.select(
            "conv_id", "block", F.bit_xor("e.x1").over(ahead).alias("o1"), F.bit_xor("e.x2").over(ahead).alias("o2"),
            F.sum("e.xw").over(ahead).alias("ow"),
        ).where("ow is not null")
        offsets = sized_broadcast(stored(offsets, "offsets"), OFFSETS_SENT)
        zero = F.lit(0).cast("long")
        own = (
            own.join(offsets, ["conv_id", "block"], "left")
            .withColumn("k1", F.col("k1").bitwiseXOR(F.coalesce("o1", zero)))
            .withColumn("k2", F.col("k2").bitwiseXOR(F.coalesce("o2", zero)))
            .withColumn("sofar", F.col("sofar") + F.coalesce("ow", zero))
        )
    columns = ["conv_id", "depth", "k1", "k2", "p1", "p2", "words", "sofar", "last"]
    own = own.withColumn("p1", F.col("k1").bitwiseXOR(F.col("a"))).withColumn("p2", F.col("k2").bitwiseXOR(F.col("b")))
    heads = each.where("taken > 0").select("conv_id", "base", "taken", "n_turns").join(base, "base").where("depth <= taken")
    heads = heads.withColumn("last", F.col("depth") == F.col("n_turns"))
    return own.select(*columns).unionByName(heads.select(*columns)), each


def _count_batches(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, cells), np.uint8)
        for batch in batches:
            for row, name in enumerate(("k1", "k2")):
                at, n = np.unique(batch.column(name).to_numpy() & (cells - 1), return_counts=True)
                # One and more than one are all that matters.
                counts[row, at] = np.minimum(counts[row, at] + np.minimum(n, 2), 2)
        step = min(cells, SKETCH_BLOCK)
        for row in range(2):
            for block in range(cells // step):
                part = counts[row, block * step : (block + 1) * step]
                if part.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row]), pa.array([block]), pa.array([np.packbits(part >= 1).tobytes()], pa.binary()),
                         pa.array([np.packbits(part >= 2).tobytes()], pa.binary())],
                        names=["row", "block", "once", "twice"],
                    )

    return run


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    merged: dict[tuple, tuple] = {}
    for batch in batches:
        for row, block, *planes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            once, twice = (np.frombuffer(p, np.uint8) for p in planes)
            if (row, block) in merged:
                before, more = merged[row, block]
                once, twice = before | once, more | twice | (before & once)
            merged[row, block] = once, twice
    if merged:
        rows, blocks = zip(*merged, strict=True)
        bits = [twice.tobytes() for _, twice in merged.values()]
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(blocks), pa.array(bits, pa.binary())], names=["row", "block", "bits"])


def shared_sketch(keys: DataFrame, n_keys: int, params: TrieParams) -> tuple[np.ndarray, int]:
    """Count-min sketch of ``k1, k2`` with saturating counters: for both rows a bit per cell that was hit more than once.

    Returns the packed bits and the cells per row. Tasks send two bits a cell; at most
    ``2 * most_cells`` bits reach the driver.
    """
    cells = 2**12
    while cells < min(n_keys * params.cells_per_prefix, params.most_cells):
        cells *= 2
    counted = keys.select("k1", "k2").mapInArrow(_count_batches(cells), "row long, block long, once binary, twice binary")
    merged = counted.repartition("row", "block").mapInArrow(_merge_batches, "row long, block long, bits binary")
    step = min(cells, SKETCH_BLOCK)
    bits = np.zeros((2, cells // 8), np.uint8)
    for found in merged.toLocalIterator():
        start = found["block"] * step // 8
        bits[found["row"], start : start + step // 8] = np.frombuffer(found["bits"], np.uint8)
    return bits, cells


def _may_be_shared(spark, bits: np.ndarray, cells: int):
    sent = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def more_than_one(k1: pd.Series, k2: pd.Series) -> pd.Series:
        table, hits = sent.value, True
        for row, keys in enumerate((k1, k2)):
            at = keys.to_numpy() & (cells - 1)
            hits = hits & ((table[row, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)
        return pd.Series(hits)

    return more_than_one


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(KEY, current, strict=True), ends=digest.hexdigest())])

    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in [*KEY, "ids"]), strict=True):
            if key != current:
                if current is not None:
                    yield done()
                current, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if current is not None:
        yield done()


def hashed_ends(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends): SHA-256 of each node's ``conv_id`` in ascending order, joined by commas.

    Ids become strings per range of ids first; a node's strings are then hashed as a
    stream, so a node of any size takes no memory (SHA-256 itself has only one order).
    """
    near = ends.groupBy(*KEY, F.shiftright("conv_id", ENDS_BITS).alias("range")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )
    dealt = near.repartition(*KEY).sortWithinPartitions(*KEY, "range")
    return dealt.select(*KEY, "ids").mapInArrow(_hash_batches, "depth long, k1 long, k2 long, ends string")


def prefix_trie(conversations: DataFrame, params: TrieParams = TrieParams()) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Conversation c takes the first ``crc32(c) % heads`` turns of its base (all if fewer,
    none if there is no base) and then its own turns after as many. Turns are ordered by
    ``turn`` (null first), those of equal number by role and a digest of role and text;
    a null role or text is empty. Repeated rows are turns of their own. Rows without
    ``conv_id`` belong to no conversation and are left out. Columns: ``conv_id`` (smallest
    member), ``depth``, ``parent_conv_id`` (root: null), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``. An empty table has no nodes. Texts
    of any length are read once and not shuffled. Other columns are not read.

    Turns of one conversation whose numbers agree above ``block_bits`` are ordered in one task.
    """
    spark = conversations.sparkSession
    rows, each = prefixes(conversations, params)
    size = each.agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.coalesce(F.sum("n_turns"), F.lit(0)).alias("turns")).first()
    bits, cells = shared_sketch(rows, size["turns"], params)
    shared = _may_be_shared(spark, bits, cells)
    flagged = stored(rows.select("*", shared("k1", "k2").alias("own"), ((F.col("depth") == 1) | shared("p1", "p2")).alias("above")), "prefixes")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    ended = F.col("last").cast("long")
    empty = F.lit(hashlib.sha256().hexdigest())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]

    # Below a proven singleton: a chain of one conversation.
    tails = flagged.where("not above").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (one - ended).alias("n_children"),
        one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(F.col("last"), _sha(F.col("conv_id").cast("string"))).otherwise(empty).alias("ends_sha256"),
    )

    possible = flagged.where("above and own")
    grouped = possible.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(ended).alias("n_ends"),
        F.min(F.when(F.col("last"), F.col("conv_id"))).alias("end"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    tops = flagged.where("above and not own").select(
        *KEY, "conv_id", one.alias("n_convs"), ended.alias("n_ends"), F.when(F.col("last"), F.col("conv_id")).alias("end"), "p1", "p2"
    )
    nodes = stored(grouped.unionByName(tops), "nodes")
    many = nodes.where("n_convs > 1")
    members = stored(
        possible.select("conv_id", *KEY, "words", "sofar", "last").join(
            many.select(*KEY, F.col("conv_id").alias("owner"), "n_convs", "n_ends"), KEY
        ),
        "members",
    )
    # What each conversation leaves to others: the words of nodes it does not own, and its leaf.
    leaf = (F.col("conv_id") == F.col("owner")) & (F.col("n_ends") == F.col("n_convs"))
    left = members.groupBy("conv_id").agg(
        F.max(F.when(F.col("conv_id") != F.col("owner"), F.col("sofar")).otherwise(zero)).alias("others"),
        F.max((F.col("last") & ~leaf).cast("long")).alias("no_leaf"),
    )
    left = stored(left.where("others > 0 or no_leaf > 0"), "left-to-others")
    # ``sofar - words`` are the words above a node; what others own below that was saved.
    above = F.col("sofar") - F.col("words")
    sums = members.join(left, "conv_id").groupBy(*KEY).agg(
        F.sum(F.greatest(F.col("others") - above, zero)).alias("saved_tokens"), F.sum("no_leaf").alias("no_leaf")
    )
    children = nodes.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children")
    )
    inner = many.join(sums, KEY, "left").join(children, KEY, "left").select(
        *KEY, "conv_id", "n_convs", "n_ends", "end", "p1", "p2", F.coalesce("n_children", zero).alias("n_children"),
        (F.col("n_convs") - F.coalesce("no_leaf", zero)).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"),
    )
    root_children = nodes.where("depth = 1").count()
    given = left.agg(F.coalesce(F.sum("others"), zero).alias("saved"), F.coalesce(F.sum("no_leaf"), zero).alias("no_leaf")).first()
    root = each.where("n_turns = 0").agg(F.count("*").alias("n_ends"), F.min("conv_id").alias("end")).select(
        *[zero.alias(c) for c in KEY], F.lit(size["low"]).cast("long").alias("conv_id"), F.lit(size["n"]).cast("long").alias("n_convs"),
        "n_ends", "end", zero.alias("p1"), zero.alias("p2"), F.lit(root_children).cast("long").alias("n_children"),
        (F.lit(size["n"] - given["no_leaf"]) - F.col("n_ends") if root_children else one).cast("long").alias("n_leaves"),
        F.lit(given["saved"]).cast("long").alias("saved_tokens"),
    ).where(F.lit(size["n"] > 0))
    turnless = each.where("n_turns = 0").select(*[zero.alias(c) for c in KEY], "conv_id")
    ends = hashed_ends(members.where("last and n_ends > 1").select(*KEY, "conv_id").unionByName(turnless))
    inner = inner.unionByName(root).join(ends, KEY, "left")
    alone = nodes.where("n_convs = 1").select(
        *KEY, "conv_id", "n_convs", "n_ends", "end", "p1", "p2", (one - F.col("n_ends")).alias("n_children"), one.alias("n_leaves"),
        zero.alias("saved_tokens"), F.lit(None).cast("string").alias("ends"),
    )
    # A parent of several conversations is met by its digest; any other parent is the child's own chain.
    parents = many.select(F.col("depth").alias("__d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    found = inner.unionByName(alone).withColumn("__d", F.col("depth") - 1).join(parents, ["__d", "p1", "p2"], "left")
    low = F.lit(size["low"]).cast("long")
    found = found.withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, low).when(F.col("depth") > 1, F.coalesce("parent", "conv_id"))
    ).withColumn(
        "ends_sha256", F.when(F.col("n_ends") == 0, empty).when(F.col("n_ends") == 1, _sha(F.col("end").cast("string"))).otherwise(F.col("ends"))
    )
    return found.select(*columns).unionByName(tails.select(*columns))
