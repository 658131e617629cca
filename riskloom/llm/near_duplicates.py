"""Near-duplicate documents by min-max hashing.

Every permutation of the 64-bit shingle digests gives two signature values, the
smallest and the largest one, so 64 permutations make a 128-value signature. It
is cut into 32 bands of four values of four different permutations. Two sets of
similarity 0.75 miss each other in all bands with probability 5e-6; each band
pair is then confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.components import components
from riskloom.llm.shared import sized_broadcast, stored
from riskloom.llm.text import combined, lower_words, shingle_set, text_digest

PERMUTATIONS = 64
BANDS = 32
PERCENT = 75
#: Rows of an id list that is broadcast (16 MB); longer ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_DRAW = np.random.default_rng(20_000_003)
_FACTOR = _DRAW.integers(0, 2**64, PERMUTATIONS, np.uint64) | np.uint64(1)
_SHIFT = _DRAW.integers(0, 2**64, PERMUTATIONS, np.uint64)


def min_max_signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest, then largest image of a non-empty set under each permutation."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for start in range(0, len(shingles), 1024):
        images = shingles[None, start : start + 1024] * _FACTOR[:, None] + _SHIFT[:, None]
        np.minimum(low, images.min(axis=1), out=low)
        np.maximum(high, images.max(axis=1), out=high)
    return np.concatenate([low, high])


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest, size, bands = [], [], []
        for text in batch.column("text"):
            words = lower_words(text.as_py())
            shingles = shingle_set(words)
            digest.append(text_digest(words))
            size.append(len(shingles))
            bands.append(combined(min_max_signature(shingles), BANDS).view(np.int64) if words else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("fingerprint"), pa.array(digest, pa.binary()),
             pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            names=["id", "fingerprint", "digest", "n_shingles", "bands"],
        )


#: Of columns both, na, nb (sizes of the intersection and the sets): 100 * intersection >= PERCENT * union.
LINKED = f"both > 0 and {100 + PERCENT} * both >= {PERCENT} * (na + nb)"


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
    for batch in batches:
        counts = []
        for one, other in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
            text = one.as_py()
            if text != seen[0]:
                seen = (text, shingle_set(lower_words(text)))
            second = shingle_set(lower_words(other.as_py()))
            counts.append((len(np.intersect1d(seen[1], second, assume_unique=True)), len(seen[1]), len(second)))
        columns = list(zip(*counts, strict=True)) if counts else [()] * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), *(pa.array(c, pa.int64()) for c in columns)], names=["a", "b", "both", "na", "nb"]
        )


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(other, "b").join(one, "a")


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, both, na, nb): exact sizes of the full shingle sets of each pair and of their intersection."""
    kind = texts.schema["id"].dataType.simpleString()
    both = _with_texts(pairs, texts).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_compare_batches, f"a {kind}, b {kind}, both bigint, na bigint, nb bigint")


def linked_components(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) of everything that confirmed links join.

    ``hits(key, id, center)``: members of each bucket and its smallest member;
    ``texts(id, text)``: their texts. First everything is compared with the center
    that it shares most buckets with. Buckets that still hold several components
    stay open, but only members that can have a link to another component at all
    stay in them (:func:`_hopeful`). A member that is not similar to its center is
    compared with those that share enough shingles *outside* the center
    (:func:`_beyond_center`); of the other members, the pairs between components
    are compared. So no link of a bucket is lost.
    """
    met = hits.where("center < id").groupBy("id", "center").agg(F.count("*").alias("n"))
    first = met.groupBy("id").agg(F.min(F.struct(-F.col("n"), F.col("center").alias("a"))).alias("m"))
    first = first.select("m.a", F.col("id").alias("b"))
    tested = stored(_compared(first, texts), "tested")
    links = tested.where(LINKED).select("a", "b")
    found = components(links)
    placed = hits.join(found, hits["id"] == found["node"], "left").select(
        "key", "id", F.coalesce("component", "id").alias("component")
    )
    open_ = stored(_of_several(placed), "open")
    rows = stored(_shingle_rows(open_, texts), "shingles")
    open_ = stored(_of_several(_hopeful(open_, stored(_foreign_shingles(rows), "shared"))), "open")
    drawn = stored(_compared(_drawn_pairs(open_), texts), "drawn").where(LINKED).select("a", "b")
    links = links.unionByName(drawn)
    open_ = stored(_of_several(_merged(open_.select("key", "id", "component"), drawn)), "open")
    # Again, because small members without hope keep up the hopes of larger ones, and components have grown.
    rows = stored(_renamed(rows, open_), "shingles")
    open_ = stored(_of_several(_hopeful(open_, stored(_foreign_shingles(rows), "shared"))), "open")

    members = open_.select("id", "component", "n", "least").distinct()
    apart = tested.where(f"not ({LINKED})").select("a", F.col("b").alias("id"), "both").join(members, "id")
    apart = stored(apart.where(f"{100 + PERCENT} * both < {PERCENT} * (n + least)"), "apart")
    beyond = _beyond_center(apart, rows, texts)
    others = stored(_of_several(open_.join(apart.select("id"), "id", "left_anti")), "others")
    rest = stored(_between_components(others, rows).unionByName(beyond).distinct(), "rest")
    more = stored(_compared(rest.join(first, ["a", "b"], "left_anti"), texts), "tested")
    return components(links.unionByName(more.where(LINKED).select("a", "b")))


def _drawn_pairs(open_: DataFrame) -> DataFrame:
    """(a, b): one drawn member of each component of a bucket with one drawn member of the bucket.

    Linear in the rows of ``open_``; most components that have a link meet here.
    """
    draw = F.struct(F.xxhash64("key", "id").alias("draw"), "id", "n", "component")
    heads = open_.groupBy("key", "component").agg(F.min(draw).alias("x"))
    pivots = heads.groupBy("key").agg(F.min("x").alias("y"))
    near = f"x.component <> y.component and 100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n)"
    return heads.join(pivots, "key").where(near).select(
        F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")
    ).distinct()


def _merged(placed: DataFrame, links: DataFrame) -> DataFrame:
    """``placed(key, id, component)`` with the components that ``links(a, b)`` join under one name."""
    names = placed.select("id", "component").distinct()
    one, other = names.toDF("a", "ca"), names.toDF("b", "cb")
    joined = links.join(one, "a").join(other, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    return placed.join(components(joined).toDF("component", "root"), "component", "left").select(
        "key", "id", F.coalesce("root", "component").alias("component")
    )


def _renamed(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """The shingle rows of the members of ``open_``, under its components."""
    names = open_.select("id", "component").distinct()
    return rows.drop("component").join(names, "id").select("id", "component", "shingle", "n")


def _rarest(rows: DataFrame, need: Column) -> DataFrame:
    """The rows that whatever shares ``need`` of an id's shingles cannot miss: all but the ``need - 1`` most frequent ones.

    ``rows`` has ``id``, ``shingle`` and the shingle's ``frequency``; ties go by the shingle, the same way for all ids.
    ``room`` counts the id's shingles from this one on: two sets share no more if this is the first one they share.
    """
    own = Window.partitionBy("id")
    ranked = rows.withColumn("__place", F.row_number().over(own.orderBy("frequency", "shingle"))).withColumn(
        "__there", F.count("*").over(own)
    )
    ranked = ranked.withColumn("room", F.col("__there") - F.col("__place") + 1)
    return ranked.where(F.col("room") >= need).drop("__place", "__there", "frequency")


def _frequencies(rows: DataFrame) -> DataFrame:
    """(shingle, frequency) of those that occur in several components."""
    seen = rows.groupBy("shingle").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("frequency")
    )
    return seen.where("low < high").select("shingle", "frequency")


def _need(sizes: str) -> Column:
    """The fewest shingles that linked sets share, if ``sizes`` is the sum of their sizes."""
    return F.expr(f"({PERCENT} * ({sizes}) + {100 + PERCENT - 1}) div {100 + PERCENT}")


def _between_components(others: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b) that may be linked, of ``others(key, id, component, n, least)`` of buckets with several components.

    Components that share a bucket are paired, not their members. A member of the
    smaller one stays if one of its rarest shingles occurs in the larger one at all.
    Only then it meets members of the larger one: those that have one of the rarest
    shingles of both, early enough in both to share as many as a link needs.
    """
    counts = others.select("id", "component").distinct().groupBy("component").agg(F.count("*").alias("members"))
    here = others.groupBy("key", "component").agg(F.min("n").alias("low"), F.max("n").alias("high")).join(counts, "component")
    small = here.select("key", F.col("component").alias("small"), F.struct("members", "component").alias("x"), F.col("low").alias("l1"), F.col("high").alias("h1"))
    large = here.select("key", F.col("component").alias("large"), F.struct("members", "component").alias("y"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    near = f"x < y and 100 * h1 >= {PERCENT} * l2 and 100 * h2 >= {PERCENT} * l1"
    meet = small.join(large, "key").where(near).select("small", "large").distinct()

    members = others.select("id", "n", "least").distinct()
    own = rows.join(members.select("id", "least"), "id")
    rare = stored(_rarest(own.join(_frequencies(own), "shingle"), _need("n + least")), "rare")
    held = stored(own.select(F.col("component").alias("large"), "shingle").distinct(), "held")
    tried = rare.withColumnRenamed("component", "small").join(meet, "small")
    hopes = tried.join(held, ["large", "shingle"]).select("id", "large").distinct()
    ours = rare.join(hopes, "id").select("shingle", "large", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("room").alias("rx"))
    theirs = rare.select("shingle", F.col("component").alias("large"), F.col("id").alias("y"), F.col("n").alias("ny"), F.col("room").alias("ry"))
    near = F.expr(f"100 * least(nx, ny) >= {PERCENT} * greatest(nx, ny)") & (F.least("rx", "ry") >= _need("nx + ny"))
    met = ours.join(theirs, ["shingle", "large"]).where(near)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _outside_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each text_b that its text_a does not have."""
    carried = ["id", "component", "n", "least", "both"]
    for batch in batches:
        sets = [
            np.setdiff1d(shingle_set(lower_words(b.as_py())), shingle_set(lower_words(a.as_py())), assume_unique=True)
            for a, b in zip(batch.column("text_a"), batch.column("text_b"), strict=True)
        ]
        at = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
        flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in carried), pa.array(flat)], names=[*carried, "shingle"])


def _beyond_center(apart: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) that may be linked although a or b is not similar to its center.

    ``apart(a, id, component, n, least, both)``: texts that share ``both`` shingles with
    their center a, too few for a link to any member of their buckets. Whatever
    they are linked to shares the missing ones outside the center, so it has one
    of the rarest of those that other components have at all.
    """
    kind = texts.schema["id"].dataType.simpleString()
    outside = _with_texts(apart.withColumn("b", F.col("id")), texts).select("id", "component", "n", "least", "both", "text_a", "text_b")
    outside = outside.mapInArrow(
        _outside_batches, f"id {kind}, component {kind}, n bigint, least bigint, both bigint, shingle bigint"
    )
    rare = _rarest(outside.join(_frequencies(rows), "shingle"), _need("n + least") - F.col("both"))
    there = rows.select("shingle", F.col("id").alias("other"), F.col("component").alias("theirs"), F.col("n").alias("m"))
    near = F.expr(f"component <> theirs and 100 * least(n, m) >= {PERCENT} * greatest(n, m)")
    near &= F.col("both") + F.col("room") >= _need("n + m")
    return rare.join(there, "shingle").where(near).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))


def _of_several(placed: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components."""
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return placed.join(mixed.where("low < high").select("key"), "key")


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(lower_words(t.as_py())) for t in batch.column("text")]
        sizes = np.array([len(x) for x in sets], np.int64)
        at = pa.array(np.repeat(np.arange(len(sets)), sizes))
        flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(at), batch.column("component").take(at), pa.array(flat), pa.array(np.repeat(sizes, sizes))],
            names=["id", "component", "shingle", "n"],
        )


def _shingle_rows(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, component, shingle, n) of the members of open buckets; n is the size of the set."""
    kind = texts.schema["id"].dataType.simpleString()
    owned = texts.join(open_.select("id", "component").distinct(), "id").select("id", "component", "text")
    return owned.mapInArrow(_shingle_batches, f"id {kind}, component {kind}, shingle bigint, n bigint")


def _foreign_shingles(rows: DataFrame) -> DataFrame:
    """(id, shared, n): how many shingles of a member also occur in another component, of how many."""
    foreign = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return rows.join(foreign.where("low < high").select("shingle"), "shingle").groupBy("id").agg(
        F.count("*").alias("shared"), F.max("n").alias("n")
    )


def _hopeful(open_: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows of ``open_(key, id, component)`` whose member can have a link to another component.

    A link shares at most the shingles that also occur in another component. If
    even all of them, held against the smallest member of the member's buckets
    that its own size allows (``least``), stay below the threshold, there is none.
    """
    sized = open_.join(shared, "id")
    sizes = sized.groupBy("key").agg(F.collect_set("n").alias("sizes"))
    near = F.array_min(F.filter("sizes", lambda m: 100 * m >= PERCENT * F.col("n")))
    least = sized.join(sizes, "key").select("id", near.alias("near")).groupBy("id").agg(F.min("near").alias("least"))
    good = shared.join(least, "id").where(f"{100 + PERCENT} * shared >= {PERCENT} * (n + least)")
    return open_.join(good.select("id", "n", "least"), "id")


def bucket_hits(members: DataFrame) -> DataFrame:
    """(key, id, center) of the buckets of ``members(key, id)`` that hold at least two ids.

    Nearly all buckets hold one id; they go by a digest of it (two ids of one
    bucket have the same one in 1 of 4 billion cases), before ids of any kind
    are compared.
    """
    place = F.hash("id")
    several = members.groupBy("key").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high")
    found = stored(members.join(several.select("key"), "key"), "members")
    centers = found.groupBy("key").agg(F.min("id").alias("center"))
    return stored(found.join(centers, "key").select("key", "id", "center"), "buckets")


def document_sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, digest, n_shingles, bands), one row per row of ``docs``, written to the shared folder."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(
        F.col(id_col).alias("id"), F.md5(F.col(text_col)).alias("fingerprint"), F.col(text_col).alias("text")
    )
    return stored(
        source.mapInArrow(
            _sketch_batches,
            f"id {kind}, fingerprint string, digest binary, n_shingles bigint, bands array<bigint>",
        ),
        "sketches",
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint, n_shingles, component_id, kept.

    1. Rows with the same word sequence collapse to the smallest id (a combined
       minimum, so a group of any size costs one row per task).
    2. In each band bucket every member meets the bucket's smallest id only. Each
       document is confirmed against the smallest such partner.
    3. In buckets that still hold several components, the pairs *between*
       components are confirmed, so no link of a bucket is lost and members of one
       component are never paired.

    Rows that share an id are one document. Null or blank texts have no shingles
    and no links. A null id never becomes a component id: such a row takes its
    text's component, and is kept only if there is none. Only ``id_col`` and
    ``text_col`` are read; other columns of any name do no harm.
    """
    sketches = document_sketches(docs, id_col, text_col)
    classes = sketches.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    heads = sketches.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    members = heads.select("id", F.explode("bands").alias("key"))
    hits = bucket_hits(members)

    ids = hits.select("id").distinct()
    texts = stored(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .where("text is not null")
        .join(sized_broadcast(ids, BROADCAST_IDS), "id", "left_semi")
        .dropDuplicates(["id", "text"]),
        "candidates",
    )
    groups = linked_components(hits, texts)

    labelled = classes.join(groups, classes["rep"] == groups["node"], "left").select(
        "digest", F.coalesce("component", "rep").alias("found")
    )
    # Texts without words stay out of the join: their null digests would meet in one task.
    found = sketches.where("digest is not null").join(labelled, "digest").withColumn("found", F.coalesce("found", "id"))
    alone = sketches.where("digest is null").withColumn("found", F.col("id"))
    return found.select("id", "fingerprint", "n_shingles", "found").unionByName(
        alone.select("id", "fingerprint", "n_shingles", "found")
    ).select(
        "id", "fingerprint", "n_shingles", F.col("found").alias("component_id"), F.col("id").eqNullSafe(F.col("found")).alias("kept")
    )


def _row_key(id_: Column, fingerprint: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(id_.cast("string"), F.lit("-")), F.coalesce(fingerprint, F.lit("-"))))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs``, all their columns; rows repeated with id and text stay once."""
    own = docs.columns
    kept = near_duplicates(docs, id_col, text_col).where("kept")
    kept = kept.select(_row_key(F.col("id"), F.col("fingerprint")).alias("__key")).distinct()
    marked = docs.withColumn("__key", _row_key(F.col(id_col), F.md5(F.col(text_col))))
    # The window reuses the partitioning and order of the join.
    place = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    once = marked.join(kept, "__key", "left_semi").withColumn("__place", place).where("__place = 1")
    return once.select(*[F.col(f"`{c}`") for c in own])
