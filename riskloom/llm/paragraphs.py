"""Repeated paragraphs by MinHash banding.

Paragraphs are lines. Equal ones collapse first; the signatures of the others are
cut into 12 bands of three values (two paragraphs of similarity 0.75 miss each
other with probability 0.15 %, of 0.8 with 0.02 %), colliding paragraphs are
confirmed by the exact Jaccard similarity of their shingles, and confirmed links
are clustered by components. A passage that was put into the middle of a line
keeps whole sentences; runs of sentences that occur elsewhere are found as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.near_duplicates import bucket_hits, linked_components
from riskloom.llm.shared import sized_broadcast, stored
from riskloom.llm.text import SHINGLE, combined, digests, text_digest, windows

HASHES, BANDS = 36, 12
#: Rows of an id list that is broadcast; longer ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_DRAW = np.random.default_rng(77_003)
_FACTOR = _DRAW.integers(0, 2**64, HASHES, np.uint64) | np.uint64(1)
_SHIFT = _DRAW.integers(0, 2**64, HASHES, np.uint64)
_ENDS = (b".", b"!", b"?")


@dataclass(frozen=True)
class ParagraphParams:
    """Paragraphs and passages below ``least_words`` words, and sentences below ``least_sentence``, are too general
    to count; ``gap`` words of such sentences may lie inside a passage.
    """

    least_words: int = 20
    least_sentence: int = 6
    gap: int = 8


def line_spans(text: str | None) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Lower-case words of a text, and (first, past last) words of each line with a word."""
    words: list[bytes] = []
    spans = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        own = line.split()
        if own:
            spans.append((len(words), len(words) + len(own)))
            words += own
    return words, spans


def sentence_spans(words: list[bytes], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sentences inside lines that hold more than one."""
    out = []
    for first, last in spans:
        cuts = [i + 1 for i in range(first, last - 1) if words[i].endswith(_ENDS)]
        if cuts:
            out += zip([first, *cuts], [*cuts, last], strict=True)
    return out


def line_signatures(words: list[bytes], spans: list[tuple[int, int]]) -> list[np.ndarray]:
    """Band keys of each span of at least SHINGLE words, all spans of a text at once."""
    if not spans:
        return []
    all_ = windows(digests(words), SHINGLE)
    place = np.concatenate([np.arange(a, b - SHINGLE + 1) for a, b in spans])
    starts = np.cumsum([0, *(b - a - SHINGLE + 1 for a, b in spans[:-1])])
    shingles = all_[place]
    low = np.empty((HASHES, len(spans)), np.uint64)
    for h in range(HASHES):
        low[h] = np.minimum.reduceat(shingles * _FACTOR[h] + _SHIFT[h], starts)
    return [combined(np.ascontiguousarray(low[:, i]), BANDS) for i in range(len(spans))]


def _unit_batches(params: ParagraphParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, size, digest, bands = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                words, spans = line_spans(text.as_py())
                lines = [s for s in spans if s[1] - s[0] >= max(params.least_words, SHINGLE)]
                sentences = [s for s in sentence_spans(words, spans) if s[1] - s[0] >= params.least_sentence]
                for own, keys in ((lines, line_signatures(words, lines)), (sentences, [None] * len(sentences))):
                    for (a, b), key in zip(own, keys, strict=True):
                        row.append(i)
                        start.append(a)
                        size.append(b - a)
                        digest.append(text_digest(words[a:b]))
                        bands.append(None if key is None else key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "start", "n_words", "digest", "bands"],
            )

    return run


def _wanted_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the wanted lines of each document."""
    for batch in batches:
        row, start, out = [], [], []
        for i, (text, wanted) in enumerate(zip(batch.column("text"), batch.column("starts"), strict=True)):
            words, spans = line_spans(text.as_py())
            ends = dict(spans)
            for a in wanted.as_py():
                if a in ends:
                    row.append(i)
                    start.append(a)
                    out.append(b" ".join(words[a : ends[a]]).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(out, pa.string())],
            names=["id", "start", "text"],
        )


def repeated_paragraphs(
    docs: DataFrame, params: ParagraphParams | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per repeated paragraph or passage: doc_id, kind, start_word, n_words, component_id, component_word, removed.

    The component is named by its first paragraph in order of document and place;
    that one stays, the others are ``removed``. ``kind`` is "paragraph" for a line
    and "passage" for a run of sentences inside longer lines. Null, empty and blank
    texts have no paragraphs. Rows with a null id are not read, as nothing could
    name their paragraphs; rows that share an id are one document. Paragraphs that
    repeat within one document count. Other columns are not read.
    """
    params = params or ParagraphParams()
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    units = stored(
        source.mapInArrow(_unit_batches(params), f"id {kind}, start bigint, n_words bigint, digest binary, bands array<bigint>"), "units"
    ).withColumn("place", F.struct("id", "start"))
    lines, sentences = units.where("bands is not null"), units.where("bands is null")

    # Lines: equal ones collapse to the first; the others meet in band buckets.
    classes = lines.groupBy("digest").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    heads = lines.join(classes.select("digest", "first"), "digest").where("place = first")
    hits = bucket_hits(heads.select(F.col("place").alias("id"), F.explode("bands").alias("key")))
    wanted = hits.select("id.id", "id.start").distinct().groupBy("id").agg(F.collect_set("start").alias("starts"))
    wanted = stored(wanted, "wanted")
    texts = (
        source.join(sized_broadcast(wanted, BROADCAST_IDS), "id")
        .select("id", "text", "starts")
        .mapInArrow(_wanted_batches, f"id {kind}, start bigint, text string")
        .select(F.struct("id", "start").alias("id"), "text")
    )
    groups = linked_components(hits, stored(texts.distinct(), "lines"))
    named = classes.join(groups, classes["first"] == groups["node"], "left").where("first <> last or component is not null")
    paragraphs = lines.join(named.select("digest", F.coalesce("component", "first").alias("component")), "digest").select(
        "id", F.lit("paragraph").alias("kind"), "start", "n_words", "component", (F.col("place") != F.col("component")).alias("removed")
    )

    # Sentences: runs of those that occur at two places at least.
    seen = sentences.groupBy("digest").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last")
    again = sentences.join(seen.select("digest", "first"), "digest").select("id", "start", "n_words", "first").distinct()
    by_doc = Window.partitionBy("id").orderBy("start")
    new = F.col("start") > F.coalesce(F.lag(F.col("start") + F.col("n_words")).over(by_doc), F.lit(-params.gap - 1)) + params.gap
    runs = again.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(by_doc))
    passages = (
        runs.groupBy("id", "run")
        .agg(
            F.min("start").alias("start"),
            (F.max(F.col("start") + F.col("n_words")) - F.min("start")).alias("n_words"),
            F.sum("n_words").alias("known"),
            F.min("first").alias("component"),
            F.max(F.col("first") != F.struct("id", "start")).alias("removed"),
        )
        .where(F.col("known") >= params.least_words)
        .select("id", F.lit("passage").alias("kind"), "start", "n_words", "component", "removed")
    )
    return paragraphs.unionByName(passages).distinct().select(
        F.col("id").alias(id_col), "kind", F.col("start").alias("start_word"), "n_words",
        F.col("component.id").alias("component_id"), F.col("component.start").alias("component_word"), "removed",
    )
