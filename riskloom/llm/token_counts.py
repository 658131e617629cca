"""Token counts of whole texts from the counts of their pre-tokens; no ids are made.

A tokenizer cuts a text into pre-tokens and splits each by itself, so a text has
as many tokens as its pre-tokens have together. Each distinct pre-token of the
corpus is split once. Per-document pre-token frequencies are joined to these
counts and summed.

Frequent pre-tokens, few and bounded in number and length, are met by a broadcast
join; their sums collapse to one row per document before anything is shuffled.
Only what is rare is joined by a shuffle, so no join key is hot.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import stored


@dataclass(frozen=True)
class TokenCountParams:
    """``vocabulary``: path of a tokenizers file on every executor. ``limit``: tokens a document may have.

    ``frequent`` and ``frequent_bytes`` bound the pre-tokens that are broadcast, in
    number and in bytes each. Neither changes a result.
    """

    vocabulary: str
    limit: int = 2048
    frequent: int = 500_000
    frequent_bytes: int = 128


#: Bytes of text that are split at a time; a longer text is split by itself.
SLICE = 6 * 2**20
ROWS_SENT = 50_000
#: Composed letters and marks that a lower-casing normaliser maps one by one.
_LATIN = "^[!-~¡-ÿ]+$"
#: Fixed value: the splitting pattern of tokenizers with word ends.
_USUAL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
_PLAIN = re.compile("[!-~]+")


def text_slices(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(first row, texts, their bytes) of slices of bounded size; null texts are empty."""
    texts = pc.fill_null(batch.column("text"), "")
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    first = 0
    while first < len(sizes):
        fit = int(np.searchsorted(np.cumsum(sizes[first:]), SLICE, side="right")) or 1
        yield first, texts.slice(first, fit), sizes[first : first + fit]
        first += fit


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, and for every word of every text its place among them and its text's place.

    Words are runs of characters other than ASCII white space; a text's ends may add empty ones.
    """
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    of_text = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    return words.dictionary, words.indices.to_numpy(), of_text


class WordCutter:
    """Pre-tokens of words, as the tokenizer at ``path`` cuts them out of a text.

    Special strings are pre-tokens of their own, written with a space in front, which
    no other pre-token can hold. A tokenizer for which white space does not separate
    pre-tokens is refused.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        spec = json.loads(tokenizer.to_str())
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: special strings that depend on their surroundings")
        if tokenizer.pre_tokenizer is None:
            raise ValueError(f"{path}: no pre-tokenizer")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.names = set(names)
        self.normalizer, self.pre, self.model = tokenizer.normalizer, tokenizer.pre_tokenizer, tokenizer.model
        self.pattern = self._plain_pattern(spec)
        for gap in " \t\n\v\f\r":
            if self._by_library(f"ab{gap}1.{gap * 2}c") != [*self._by_library("ab"), *self._by_library("1."), *self._by_library("c")]:
                raise ValueError(f"{path}: white space does not separate its pre-tokens")

    @staticmethod
    def _plain_pattern(spec: dict):
        """The splitting pattern as a group, if Latin words need no more than lower-casing and this pattern."""
        steps = spec["normalizer"] or {}
        steps = steps.get("normalizers", [steps])
        cuts = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        kinds = [s.get("type") for s in steps]
        plain = (
            sorted(kinds) == ["Lowercase", "NFC", "Replace"]
            and [s["pattern"] for s in steps if s["type"] == "Replace"] == [{"Regex": r"\s+"}]
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and "Regex" in cuts[0]["pattern"] and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
            and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
        )
        return f"({cuts[0]['pattern']['Regex']})" if plain else None

    def _by_library(self, text: str) -> list[str]:
        normal = self.normalizer.normalize_str(text) if self.normalizer else text
        return [normal[a:b] for _, (a, b) in self.pre.pre_tokenize_str(normal)]

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of one word, in order."""
        if self.special is not None:
            parts = self.special.split(text)
            if len(parts) > 1:
                cuts = [[" " + p] if p in self.names else self.cut(p) for p in parts if p]
                return [c for cut in cuts for c in cut]
        return self._by_library(text)

    def cut_all(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens of many words: the distinct ones, all as places among these, and each word's first and number.

        Latin words without a special string are cut by one pattern at once, others by the library.
        """
        kind = np.zeros(len(words), np.int8)
        parts, counts = [], []
        if self.pattern is not None:
            latin = pc.match_substring_regex(words, _LATIN)
            for name in self.names:
                latin = pc.and_(latin, pc.invert(pc.match_substring(words, name)))
            lower = pc.utf8_lower(words.filter(latin))
            head = pc.utf8_rtrim(lower, characters=_MARKS)
            # Letters and then marks are two pre-tokens of the usual pattern; only the rest has to be matched.
            simple = pc.and_(pc.utf8_is_alpha(head), pa.scalar(self.pattern == f"({_USUAL})"))
            kind[latin.to_numpy(zero_copy_only=False)] = np.where(simple.to_numpy(zero_copy_only=False), 2, 1)
            marks = pc.utf8_ltrim(lower.filter(simple), characters=_LETTERS)
            spaced = pc.binary_join_element_wise(head.filter(simple), marks, " ")
            matched = pc.replace_substring_regex(lower.filter(pc.invert(simple)), self.pattern, r"\1 ")
            for marked in (spaced, matched):
                lists = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(marked))
                parts.append(lists.flatten())
                counts.append(pc.list_value_length(lists).to_numpy())
        hard = [self.cut(word) for word in words.filter(pa.array(kind == 0)).to_pylist()]
        parts.append(pa.array([t for cut in hard for t in cut], pa.string()))
        counts.append(np.fromiter(map(len, hard), np.int64, len(hard)))
        order = np.concatenate([np.flatnonzero(kind == k) for k in ((2, 1, 0) if self.pattern is not None else (0,))])
        together = np.concatenate(counts)
        n, first = np.empty((2, len(words)), np.int64)
        n[order], first[order] = together, np.cumsum(together) - together
        tokens = pa.chunked_array(parts, pa.string()).combine_chunks().dictionary_encode()
        return tokens.dictionary, tokens.indices.to_numpy(), first, n

    def frequencies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Text, pre-token and number of times it occurs there; pre-tokens by their place in the last array."""
        words, at, of_text = split_words(texts)
        tokens, flat, first, n = self.cut_all(words)
        # Every word becomes its pre-tokens.
        n, first = n[at], first[at]
        places = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        width = max(len(tokens), 1)
        pairs, counts = np.unique(np.repeat(of_text, n) * width + flat[places], return_counts=True)
        return (*np.divmod(pairs, width), counts, tokens)

    def pieces(self, token: str) -> int:
        """Tokens that one pre-token is split into."""
        if token.startswith(" "):
            return 1
        if self.pattern is not None and _PLAIN.fullmatch(token):
            return len(self.model.tokenize(token))
        return sum(len(self.model.tokenize(piece)) for piece, _ in self.pre.pre_tokenize_str(token))


def _vocabulary_batches(params: TokenCountParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = WordCutter(params.vocabulary)
        for batch in batches:
            for _, texts, _ in text_slices(batch):
                words, at, _ = split_words(texts)
                tokens, flat, first, n = cutter.cut_all(words)
                times = np.bincount(at, minlength=len(words))
                places = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                totals = np.zeros(len(tokens), np.int64)
                np.add.at(totals, flat[places], np.repeat(times, n))
                yield pa.RecordBatch.from_arrays([tokens, pa.array(totals)], names=["token", "n"])

    return run


def _piece_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = WordCutter(path)
        for batch in batches:
            pieces = [cutter.pieces(token) for token in batch.column("token").to_pylist()]
            yield batch.append_column("pieces", pa.array(pieces, pa.int64()))

    return run


def vocabulary_pieces(docs: DataFrame, params: TokenCountParams, text_col: str = "text") -> DataFrame:
    """(token, n, pieces) for every distinct pre-token of the texts; stored.

    ``n``: times it occurs. A task combines a slice of texts before the
    shuffle; each distinct pre-token reaches the tokenizer once.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    seen = texts.mapInArrow(_vocabulary_batches(params), "token string, n bigint")
    distinct = seen.groupBy("token").agg(F.sum("n").alias("n"))
    counted = distinct.mapInArrow(_piece_batches(params.vocabulary), "token string, n bigint, pieces bigint")
    return stored(counted, "pre-tokens")


def _least_occurrences(vocabulary: DataFrame, params: TokenCountParams) -> int:
    """The smallest number of occurrences that at most ``frequent`` short pre-tokens reach.

    A histogram of a few hundred rows decides: exact up to 64 occurrences, eight steps per doubling above.
    """
    level = F.when(F.col("n") <= 64, F.col("n")).otherwise(F.floor(F.log2("n") * 8) + 64)
    short = vocabulary.where(F.octet_length("token") <= params.frequent_bytes)
    levels = short.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("n").alias("least")).collect()
    least, total = 1 << 62, 0
    for row in sorted(levels, key=lambda r: -r["level"]):
        total += row["n"]
        if total > params.frequent:
            break
        least = row["least"]
    return least


def _frequency_batches(params: TokenCountParams):
    names = ["row", "id", "n_bytes", "token", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = WordCutter(params.vocabulary)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("id")
            for first, texts, sizes in text_slices(batch):
                # One row per document carries its id and size, the others a pre-token each.
                heads = pa.array(row + np.arange(len(texts)))
                yield pa.RecordBatch.from_arrays(
                    [heads, ids.slice(first, len(texts)), pa.array(sizes), pa.nulls(len(texts), pa.string()), pa.nulls(len(texts), pa.int64())],
                    names=names,
                )
                of_text, at, counts, tokens = cutter.frequencies(texts)
                for i in range(0, len(at), ROWS_SENT):
                    part = slice(i, i + ROWS_SENT)
                    n = len(at[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row + of_text[part]), pa.nulls(n, ids.type), pa.nulls(n, pa.int64()), tokens.take(pa.array(at[part])), pa.array(counts[part])],
                        names=names,
                    )
                row += len(texts)

    return run


def pretoken_frequencies(docs: DataFrame, params: TokenCountParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_bytes, token, n): how often each document holds each pre-token.

    ``row`` numbers documents by task, so equal ids stay apart; each document has one
    more row with its id and size in bytes and no pre-token.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_frequency_batches(params), f"row bigint, id {kind}, n_bytes bigint, token string, n bigint")


def token_counts(docs: DataFrame, params: TokenCountParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    The count is that of the library for the whole text: no begin, end or padding,
    special strings inside texts one token each. A null text is empty (0 bytes, 0
    tokens). Repeated rows and equal or null ids give a row each. Texts
    are split in slices of bounded size, a longer one by itself. An empty table
    gives no rows. Other columns are not read, whatever their names.
    """
    vocabulary = vocabulary_pieces(docs, params, text_col)
    least = _least_occurrences(vocabulary, params)
    often = (F.col("n") >= least) & (F.octet_length("token") <= params.frequent_bytes)
    frequent, rare = vocabulary.where(often).select("token", "pieces"), vocabulary.where(~often).select("token", "pieces")
    met = pretoken_frequencies(docs, params, id_col, text_col).join(F.broadcast(frequent), "token", "left")
    # What is known collapses to one row per document; a rare pre-token keeps its own.
    left = F.when(F.col("pieces").isNull(), F.col("token"))
    sums = met.groupBy("row", left.alias("token")).agg(
        F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n"),
        F.coalesce(F.sum(F.col("n") * F.col("pieces")), F.lit(0)).alias("n_tokens"),
    )
    if rare.isEmpty():
        totals = sums
    else:
        sums = stored(sums, "token-sums")
        open_ = sums.where("token is not null").select("row", "token", "n").join(rare, "token")
        found = open_.select("row", F.lit(None).cast(docs.schema[id_col].dataType).alias("id"), F.lit(None).cast("long").alias("n_bytes"), (F.col("n") * F.col("pieces")).alias("n_tokens"))
        known = sums.where("token is null").select("row", "id", "n_bytes", "n_tokens")
        totals = known.unionByName(found).groupBy("row").agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return totals.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > params.limit).alias("over_limit"))
