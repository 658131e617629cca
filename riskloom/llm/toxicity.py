"""Toxicity by two class-conditional Kneser-Ney models with shared backoff.

Every word of a text has a likelihood after the word before it (or the start of the
text) under the toxic and under the ordinary model; the verdict compares the two,
normalised by length. Class counts exist for expressions (words and word pairs)
whose classes differ beyond chance, each decided by its own counts: a pair may
differ though its words do not, and a word though it follows one word only. Every
other expression is rare or neutral: both models take it from the same backoff
distribution, so it cancels and is never stored or shipped. All counts cover all
training rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import stored
from riskloom.llm.text import digests, lower_words, scrambled

_EDGES = b".,;:!?\"'()[]{}|<>*#$%&"
_PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Stands before the first word of a text; no word is empty.
_START = digests([b""])


@dataclass(frozen=True)
class ToxicityParams:
    """``min_count`` and ``min_g`` say when a class difference is beyond chance (G statistic, one degree of freedom),
    ``min_gain`` when the log-likelihoods differ enough to matter.

    ``broadcast_rows`` bounds the expressions sent to every task (16 bytes each);
    a larger model is joined instead. ``calibration_rows`` bounds the labelled
    rows whose two features fit the final logistic curve.
    """

    min_count: int = 5
    min_g: float = 20.0
    min_gain: float = 0.7
    broadcast_rows: int = 2_000_000
    calibration_rows: int = 20_000


@dataclass(frozen=True)
class ToxicityModel:
    """``grams``: (gram, gain), the log-likelihood difference of each stored expression."""

    grams: DataFrame
    rows: int
    offset: float
    weights: tuple[float, float, float]
    params: ToxicityParams


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words without the punctuation around them."""
    return [w for w in (x.strip(_EDGES) for x in lower_words(text)) if w]


def _before(words: np.ndarray) -> np.ndarray:
    """What stands before each word."""
    return np.concatenate([_START, words])[: len(words)]


def pair_digests(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Digest of each word with what stands before it."""
    return scrambled(before * _PAIR + words)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words, and of the starts before them."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        own = [digests(plain_words(t.as_py())) for t in batch.column("text")]
        own = [np.concatenate([_START, x]) if len(x) else x for x in own]
        if not own:
            continue
        words = np.concatenate(own)
        sides = np.repeat(toxic, [len(x) for x in own])
        gram, place = np.unique(words, return_inverse=True)
        n = len(gram)
        yield pa.RecordBatch.from_arrays(
            [_signed(gram), pa.array(np.bincount(place[sides], minlength=n)),
             pa.array(np.bincount(place[~sides], minlength=n))],
            names=["gram", "toxic", "ordinary"],
        )


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        own = [digests(plain_words(t.as_py())) for t in batch.column("text")]
        if not own:
            continue
        before, after = np.concatenate([_before(x) for x in own]), np.concatenate(own)
        sides = np.repeat(toxic, [len(x) for x in own])
        gram, first, place = np.unique(pair_digests(before, after), return_index=True, return_inverse=True)
        n = len(gram)
        yield pa.RecordBatch.from_arrays(
            [_signed(before[first]), _signed(after[first]), pa.array(np.bincount(place[sides], minlength=n)),
             pa.array(np.bincount(place[~sides], minlength=n))],
            names=["before", "after", "toxic", "ordinary"],
        )


def _with_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        before, after = (batch.column(c).to_numpy().view(np.uint64) for c in ("before", "after"))
        yield pa.RecordBatch.from_arrays([_signed(pair_digests(before, after)), batch.column("gain")], names=["gram", "gain"])


def _g_statistic(toxic: str, ordinary: str, n_toxic: float, n_ordinary: float):
    """How unlikely the split of an expression over the classes is (log-likelihood ratio)."""
    a, b = F.col(toxic).cast("double"), F.col(ordinary).cast("double")
    whole = n_toxic + n_ordinary
    part = lambda x, share: F.when(x > 0, x * F.log(x / ((a + b) * share))).otherwise(0.0)
    return 2 * (part(a, n_toxic / whole) + part(b, n_ordinary / whole))


def fit_toxicity(train: DataFrame, params: ToxicityParams | None = None) -> ToxicityModel:
    """Fit on every row of ``train(text, toxic)``; ``toxic`` is true or false, never null.

    Without a row of each class nothing differs: the score is the share of toxic rows.
    """
    params = params or ToxicityParams()
    train = train.select("text", F.col("toxic").cast("boolean").alias("toxic")).where("toxic is not null")
    history = stored(
        train.mapInArrow(_word_counts, "gram bigint, toxic bigint, ordinary bigint")
        .groupBy("gram")
        .agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")),
        "words",
    )
    words = history.where(F.col("gram") != int(_START.view(np.int64)[0]))
    total = words.agg(
        F.sum("toxic"), F.sum("ordinary"), F.count("*"),
        F.count_if(F.expr("toxic + ordinary = 1")), F.count_if(F.expr("toxic + ordinary = 2")),
    ).first()
    n_toxic, n_ordinary, types, ones, twos = (float(x or 0) for x in total)
    spark = train.sparkSession
    nothing = spark.createDataFrame([], "gram bigint, gain double")
    if not n_toxic or not n_ordinary:
        share = train.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
        share = min(max(0.5 if share is None else share, 1e-6), 1 - 1e-6)
        return ToxicityModel(nothing, 0, 0.0, (math.log(share / (1 - share)), 0.0, 0.0), params)
    discount = ones / (ones + 2 * twos) if ones + twos else 0.5

    beyond_chance = F.expr(f"toxic + ordinary >= {params.min_count}") & (
        _g_statistic("toxic", "ordinary", n_toxic, n_ordinary) >= params.min_g
    )
    counted = (
        train.mapInArrow(_pair_counts, "before bigint, after bigint, toxic bigint, ordinary bigint")
        .groupBy("before", "after")
        .agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    )
    # Continuation counts: in how many different pairs a word comes second, by class and in both.
    follows = counted.groupBy("after").agg(
        F.count_if(F.col("toxic") > 0).alias("toxic"),
        F.count_if(F.col("ordinary") > 0).alias("ordinary"),
        F.count("*").alias("k_both"),
    )
    # One query for both, so that all pairs are counted and shuffled once and never stored.
    pairs = stored(
        follows.withColumn("before", F.lit(None).cast("bigint")).unionByName(
            counted.where(beyond_chance).withColumn("k_both", F.lit(None).cast("bigint"))
        ),
        "pairs",
    )
    follows = pairs.where("k_both is not null").select(
        "after", F.col("toxic").alias("k_toxic"), F.col("ordinary").alias("k_ordinary"), "k_both"
    )
    k_toxic, k_ordinary = (max(float(x or 0), 1.0) for x in follows.agg(F.sum("k_toxic"), F.sum("k_ordinary")).first())
    shared = (F.col("k_both") + 1.0) / (k_toxic + k_ordinary + types)

    def continued(k: str, whole: float):
        seen = F.col(k).cast("double")
        return (F.greatest(seen - discount, F.lit(0.0)) + discount * types / 2 * shared) / whole

    unigrams = words.where(beyond_chance).join(follows.withColumnRenamed("after", "gram"), "gram").select(
        "gram", continued("k_toxic", k_toxic).alias("p_toxic"), continued("k_ordinary", k_ordinary).alias("p_ordinary")
    )
    # Common words differ beyond chance in any large corpus; what counts is that they differ much.
    unigrams = unigrams.withColumn("gain", F.log(F.col("p_toxic") / F.col("p_ordinary")))
    unigrams = stored(unigrams.where(F.abs("gain") >= params.min_gain), "unigrams")
    before = history.select(F.col("gram").alias("before"), F.col("toxic").alias("h_toxic"), F.col("ordinary").alias("h_ordinary"))
    backoff = follows.join(unigrams.withColumnRenamed("gram", "after"), "after", "left").select(
        "after",
        F.coalesce("p_toxic", shared).alias("p_toxic"),
        F.coalesce("p_ordinary", shared).alias("p_ordinary"),
        F.col("gain").isNotNull().alias("known"),
    )

    def conditional(side: str):
        seen, whole = F.col(side).cast("double"), F.col(f"h_{side}").cast("double")
        return (F.greatest(seen - discount, F.lit(0.0)) + discount * F.col(f"p_{side}")) / (whole + discount)

    # A pair replaces its second word, so after a stored word it counts even if the classes are close.
    bigrams = (
        pairs.where("k_both is null").select("before", "after", "toxic", "ordinary")
        .join(before, "before")
        .join(backoff, "after")
        .withColumn("gain", F.log(conditional("toxic") / conditional("ordinary")))
        .where(F.col("known") | (F.abs("gain") >= params.min_gain))
        .select("before", "after", "gain")
        .mapInArrow(_with_digests, "gram bigint, gain double")
    )
    grams = stored(unigrams.select("gram", "gain").unionByName(bigrams), "grams")
    # The share of a class's pairs that is left to the shared backoff, the same for all words it holds.
    taken = unigrams.agg(F.sum("p_toxic"), F.sum("p_ordinary")).first()
    offset = math.log(max(1 - (taken[0] or 0.0), 1e-9) / max(1 - (taken[1] or 0.0), 1e-9))

    model = ToxicityModel(grams, grams.count(), offset, (0.0, 0.0, 0.0), params)
    # About calibration_rows training rows, picked by a digest of their text.
    kept = min(1.0, params.calibration_rows / max(train.count(), 1))
    sample = train.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < int(kept * 1_000_003) + 1)
    seen = likelihood_features(sample, model, ["toxic"]).toPandas()
    return ToxicityModel(grams, model.rows, offset, _logistic(seen), params)


def _logistic(seen: pd.DataFrame) -> tuple[float, float, float]:
    """Two-feature logistic regression by damped Newton steps."""
    x = np.column_stack([np.ones(len(seen)), seen["__mean_gain"], seen["__hit_gain"]])
    y = seen["toxic"].to_numpy(float)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - 1e-2 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        step = np.linalg.solve(curve, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def _squashed(total: np.ndarray, n: np.ndarray, hits: np.ndarray, offset: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean gain of a word, and mean gain of the words with a stored expression alone."""
    mean = np.divide(total + offset * (n - hits), n, out=np.zeros(len(n)), where=n > 0)
    own = np.divide(total, hits, out=np.zeros(len(n)), where=hits > 0)
    return np.clip(mean, -1.0, 1.0), np.clip(own, -5.0, 5.0)


def _local_scorer(gram: np.ndarray, gain: np.ndarray, offset: float, carried: list[str]):
    def gains(wanted: np.ndarray) -> np.ndarray:
        """NaN for what is not stored."""
        if not len(gram):
            return np.full(len(wanted), np.nan)
        found = np.minimum(np.searchsorted(gram, wanted), len(gram) - 1)
        return np.where(gram[found] == wanted, gain[found], np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, n, hits = [], [], []
            for text in batch.column("__text"):
                words = digests(plain_words(text.as_py()))
                n.append(len(words))
                pair = gains(pair_digests(_before(words), words))
                own = np.where(np.isnan(pair), gains(words), pair)
                total.append(float(np.nansum(own)))
                hits.append(int((~np.isnan(own)).sum()))
            mean, alone = _squashed(np.array(total), np.array(n, float), np.array(hits, float), offset)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carried], pa.array(mean), pa.array(alone)],
                names=[*carried, "__mean_gain", "__hit_gain"],
            )

    return run


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in zip(batch.column("__row"), batch.column("__text"), strict=True):
            words = digests(plain_words(text.as_py()))
            pairs, first, times = np.unique(pair_digests(_before(words), words), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row.as_py()] * len(pairs), pa.int64()), _signed(pairs), _signed(words[first]), pa.array(times),
                 pa.array(np.full(len(pairs), len(words)))],
                names=["__row", "pair", "word", "times", "n"],
            )


def likelihood_features(docs: DataFrame, model: ToxicityModel, carried: list[str], text_col: str = "text") -> DataFrame:
    """``carried`` columns of ``docs`` with __mean_gain and __hit_gain of each ``text_col``.

    A model of up to ``broadcast_rows`` expressions travels to the tasks; a larger
    one meets the texts' expressions in a shuffled join. Both ways give the same.
    """
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    out = f"{kinds}, __mean_gain double, __hit_gain double"
    docs = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(text_col).alias("__text"))
    if model.rows <= model.params.broadcast_rows:
        table = model.grams.groupBy("gram").agg(F.max("gain").alias("gain")).toPandas()
        order = np.argsort(table["gram"].to_numpy(np.int64).view(np.uint64))
        gram = table["gram"].to_numpy(np.int64).view(np.uint64)[order]
        gain = table["gain"].to_numpy(float)[order]
        return docs.mapInArrow(_local_scorer(gram, gain, model.offset, carried), out)
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    known = model.grams.groupBy("gram").agg(F.max("gain").alias("gain"))
    found = (
        rows.select("__row", "__text")
        .mapInArrow(_gram_rows, "__row bigint, pair bigint, word bigint, times bigint, n bigint")
        .join(known.toDF("pair", "pair_gain"), "pair", "left")
        .join(known.toDF("word", "word_gain"), "word", "left")
        .withColumn("gain", F.coalesce("pair_gain", "word_gain"))
        .groupBy("__row")
        .agg(
            F.sum(F.col("gain") * F.col("times")).alias("total"),
            F.sum(F.when(F.col("gain").isNotNull(), F.col("times"))).alias("hits"),
            F.max("n").alias("n"),
        )
    )
    total, hits, n = (F.coalesce(c, F.lit(0)).cast("double") for c in ("total", "hits", "n"))
    mean = F.when(n > 0, F.greatest(F.least((total + (n - hits) * model.offset) / n, F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)
    alone = F.when(hits > 0, F.greatest(F.least(total / hits, F.lit(5.0)), F.lit(-5.0))).otherwise(0.0)
    return rows.join(found, "__row", "left").select(*carried, mean.alias("__mean_gain"), alone.alias("__hit_gain"))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, carried: list[str], text_col: str = "text") -> DataFrame:
    """``carried`` columns with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), one row per row of ``docs``.

    Only the text decides. A null or blank text has no expressions: its score is the curve's value at zero.
    """
    scored = likelihood_features(docs, model, carried, text_col)
    return scored.select(*carried, _curve(model).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, all their columns."""
    scored = likelihood_features(docs, model, docs.columns, text_col)
    return scored.where(_curve(model) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def _curve(model: ToxicityModel) -> Column:
    w = model.weights
    return 1 / (1 + F.exp(-(w[0] + w[1] * F.col("__mean_gain") + w[2] * F.col("__hit_gain"))))
