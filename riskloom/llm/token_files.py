"""Token ids in Parquet files that allow selective reads.

Documents are dealt out by ranges of their id, encoded in order, and written as
one row per document with a list column of ids. Lists are dictionary or delta
encoded, row groups are small enough to be skipped, and the page index of each
file lets a reader take the token lists of a few documents, or the lengths alone.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.shared import sized_broadcast
from riskloom.session import fresh_path


@dataclass(frozen=True)
class TokenFileParams:
    """``vocabulary``: path of a tokenizer file on every executor. ``encoding`` is "dictionary" or "delta".

    ``row_group_bytes`` and ``page_rows`` control how finely a file can be read.
    ``cached_words`` bounds the words a Python worker remembers; it changes only speed.
    """

    vocabulary: str
    end_id: int = 2
    encoding: str = "dictionary"
    row_group_bytes: int = 16 * 2**20
    page_rows: int = 1_000
    cached_words: int = 600_000


#: A run of letters that are composed in every normal form and whose lower case is one letter each, then ASCII marks
#: that cannot open a contraction. Such a word has two pieces and needs neither normalizer nor pre-tokenizer.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


#: Rows of the file offset table that is broadcast; a longer one is joined by a shuffle.
FILES_SENT = 500_000


class WordEncoder:
    """Ids of a text from the ids of its words, which are encoded once each and remembered.

    Words end at white space for this kind of tokenizer, so the ids of a text are
    those of its words in a row; :func:`tests` hold that against whole texts.
    """

    def __init__(self, path: str, cached_words: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = "".join(map(chr, [*range(33, 127), *range(0xDF, 0x100)]))
        self.to_bytes = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in letters})
        self.limit, self.known, self.recent = cached_words // 2, {}, {}
        self.marks: dict[str, bytes] = {"": b""}

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.translate(self.to_bytes)
        return _packed([t.id for t in self.tokenizer.model.tokenize(piece)])

    def _fresh(self, word: str) -> bytes:
        simple = _SIMPLE.fullmatch(word)
        if not simple:
            return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        letters, marks = simple.groups()
        if marks not in self.marks:
            self.marks[marks] = self._piece(marks)
        return self._piece(letters.lower()) + self.marks[marks]

    def word(self, word: str) -> bytes:
        found = self.recent.get(word)
        if found is None:
            found = self.known.get(word)
            if found is None:
                found = self._fresh(word)
            self.recent[word] = found
            if len(self.recent) >= self.limit:
                # Words not seen for a whole generation are forgotten.
                self.known, self.recent = self.recent, {}
        return found

    def text(self, text: str | None) -> bytes:
        return b"".join(map(self.word, _SPACE.findall(text or "")))


def _encoder(path: str, cached_words: int) -> WordEncoder:
    """The worker's encoder for ``path``; it lives as long as the Python worker, over all its tasks."""
    import tokenizers

    # This module travels with each task, so only an installed one outlives them.
    shelf = vars(tokenizers).setdefault("_kept_encoders", {})
    if (path, cached_words) not in shelf:
        shelf[path, cached_words] = WordEncoder(path, cached_words)
    return shelf[path, cached_words]


def _encode_batches(params: TokenFileParams):
    end = np.array([params.end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(params.vocabulary, params.cached_words)
        written = 0
        for batch in batches:
            start, size = 0, 0
            rows: list[np.ndarray] = []
            for i, text in enumerate(batch.column("text")):
                rows.append(np.frombuffer(encoder.text(text.as_py()) + end, "<u4").astype(np.int32))
                size += len(rows[-1])
                # Long texts make short batches.
                if size >= 2_000_000 or i + 1 == batch.num_rows:
                    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").slice(start, len(rows)), pa.array(written + ends[:-1].astype(np.int64)),
                         pa.array(np.diff(ends).astype(np.int64)), lists],
                        names=["id", "start_in_file", "n_tokens", "ids"],
                    )
                    written += size
                    start, size, rows = i + 1, 0, []

    return run


def write_token_files(docs: DataFrame, params: TokenFileParams, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``doc_id, start_in_file, n_tokens, ids`` in ascending doc_id order (nulls first) below ``path``.

    File order is id order: ranges of ids go to successive files. A null or empty
    text is the end id alone. Rows with equal ids stay neighbours. Other columns
    are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    dealt = source.repartitionByRange("id").sortWithinPartitions("id")
    tokens = dealt.mapInArrow(_encode_batches(params), f"id {kind}, start_in_file bigint, n_tokens bigint, ids array<int>")
    delta = params.encoding == "delta"
    options = {
        "parquet.writer.version": "PARQUET_2_0" if delta else "PARQUET_1_0",
        "parquet.enable.dictionary": str(not delta).lower(),
        "parquet.block.size": str(params.row_group_bytes),
        "parquet.page.row.count.limit": str(params.page_rows),
        "compression": "zstd",
    }
    tokens.withColumnRenamed("id", id_col).write.options(**options).parquet(path)


def with_starts(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``files`` with ``start``, the number of ids of all documents before each one.

    The file offsets come from the lengths alone (one row per file); the lists are
    never shuffled.
    """
    rows = files.withColumn("__file", F.col("_metadata.file_path"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("first", "__file").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("__file").agg(F.min(F.struct(id_col)).alias("first"), F.sum("n_tokens").alias("n"))
    sums = sums.select("__file", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__base"))
    based = rows.join(sized_broadcast(sums, FILES_SENT), "__file")
    return based.withColumn("start", F.col("__base") + F.col("start_in_file")).drop("__file", "__base")


def _checksum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
            names=["id", "start", "n_tokens", "ids_crc32"],
        )


def token_files(docs: DataFrame, params: TokenFileParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write, and read back: doc_id, start, n_tokens, ids_crc32 from the files, one row per document."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_token_files(docs, params, path, id_col, text_col)
    return read_checksums(spark.read.parquet(path), id_col)


def read_checksums(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each stored document."""
    kind = files.schema[id_col].dataType.simpleString()
    return with_starts(files, id_col).select(F.col(id_col).alias("id"), "start", "ids").mapInArrow(
        _checksum_batches, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"
    ).withColumnRenamed("id", id_col)
