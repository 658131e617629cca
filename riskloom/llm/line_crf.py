"""Line quality by a linear-chain conditional random field.

Every line of a text is content or boilerplate. A line's features give its two
emission scores, the chain adds transition scores, and Viterbi decoding takes the
best labelling of the whole text. The share of words in content lines decides
whether the text stays.

The field is trained here: lines of texts labelled good or bad start with their
text's label, and a few rounds of relabelling by the field itself, kept to lines
that look alike, turn text labels into line labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.text import digests, windows

SYMBOLS = "#*$%&|<>"
_SYMBOL_BYTES = np.zeros(256, bool)
_SYMBOL_BYTES[list(SYMBOLS.encode())] = True
N_FEATURES = 12
CONTENT, BOILERPLATE = 0, 1


@dataclass(frozen=True)
class LineParams:
    """``sample_rows`` bounds the labelled texts that train the field; ``content_share`` is the least share of
    words in content lines of a kept text; ``rounds`` of training passes.
    """

    sample_rows: int = 2_000
    content_share: float = 0.5
    rounds: int = 30
    step: float = 0.5


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    space = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = int(_SYMBOL_BYTES[np.frombuffer(raw, np.uint8)].sum())
    lines = Counter(x for x in raw.split(b"\n") if x.split())
    return len(words), len(text) - space, symbols, sum(lines.values()) - len(lines), repeated_words(digests(words))


def repeated_words(words: np.ndarray) -> int:
    """Words covered by a 3-word window that occurs at least twice."""
    own = windows(words, 3)
    if not len(own):
        return 0
    _, place, times = np.unique(own, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(times[place] > 1)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + 3, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x N_FEATURES) and word counts of the lines that hold a word."""
    rows, sizes = [], []
    seen: set[bytes] = set()
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        n_bytes = len(line)
        codes = np.frombuffer(line, np.uint8)
        letters = ((codes | 32) >= 97) & ((codes | 32) <= 122) & (codes < 128)
        upper = int(((codes >= 65) & (codes <= 90)).sum())
        n_letters = int(letters.sum()) + int((codes >= 128).sum())
        marks = n_bytes - n_letters - (n - 1)
        symbols = int(_SYMBOL_BYTES[codes].sum())
        distinct = len(set(words))
        rows.append(
            (
                1.0,
                min(n, 50) / 50.0,
                float(n < 4),
                min(symbols / n, 3.0),
                min(marks / n, 3.0),
                upper / max(n_letters, 1),
                distinct / n,
                float(words[-1][-1:] in (b".", b"!", b"?")),
                float(line in seen),
                min(line.count(b"|") / n, 1.0),
                min((n_bytes - n + 1) / n, 20.0) / 20.0,
                float(len(words) > 2 and distinct <= len(words) // 2),
            )
        )
        seen.add(line)
        sizes.append(n)
    return np.array(rows).reshape(-1, N_FEATURES), np.array(sizes, np.int64)


def viterbi(emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Best label of every line: ``emission`` is lines x 2, ``transition[i, j]`` scores j after i."""
    n = len(emission)
    if not n:
        return np.empty(0, np.int64)
    (t00, t01), (t10, t11) = transition.tolist()
    came = np.empty((n, 2), np.int8)
    a, b = emission[0].tolist()
    for i, (ea, eb) in enumerate(emission.tolist()):
        if not i:
            continue
        came[i] = (a + t00 < b + t10, a + t01 < b + t11)
        a, b = max(a + t00, b + t10) + ea, max(a + t01, b + t11) + eb
    best = np.empty(n, np.int64)
    best[-1] = int(b > a)
    for i in range(n - 1, 0, -1):
        best[i - 1] = came[i, best[i]]
    return best


def _marginals(emission: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and label pair probabilities by forward-backward in log space."""
    n = len(emission)
    ahead, back = np.empty((n, 2)), np.zeros((n, 2))
    ahead[0] = emission[0]
    for i in range(1, n):
        ahead[i] = emission[i] + np.logaddexp.reduce(ahead[i - 1][:, None] + transition, axis=0)
    for i in range(n - 2, -1, -1):
        back[i] = np.logaddexp.reduce(transition + (emission[i + 1] + back[i + 1])[None, :], axis=1)
    whole = np.logaddexp.reduce(ahead[-1])
    pairs = np.zeros((2, 2))
    if n > 1:
        joint = ahead[:-1, :, None] + transition[None] + (emission[1:] + back[1:])[:, None, :] - whole
        pairs = np.exp(joint).sum(axis=0)
    return np.exp(ahead + back - whole), pairs


def fit_lines(texts: list[tuple[str, bool]], params: LineParams | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (features x 2) and transitions from (text, is good) pairs.

    Gradient ascent on the penalised conditional likelihood. After a third and two
    thirds of the rounds, lines of bad texts that the field finds clearly like good
    lines turn into content: a bad text may hold good lines, but not the reverse.
    """
    params = params or LineParams()
    chains = [(line_features(t)[0], good) for t, good in texts]
    chains = [(x, np.full(len(x), CONTENT if good else BOILERPLATE), good) for x, good in chains if len(x)]
    weights, transition = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    if not chains or len({good for _, _, good in chains}) < 2:
        return weights, transition
    total = sum(len(x) for x, _, _ in chains)
    for turn in range(params.rounds):
        g_w, g_t = -1e-4 * weights * total, -1e-4 * transition * total
        for k, (x, y, good) in enumerate(chains):
            p, pairs = _marginals(x @ weights, transition)
            g_w += x.T @ (np.eye(2)[y] - p)
            if len(y) > 1:
                np.add.at(g_t, (y[:-1], y[1:]), 1.0)
                g_t -= pairs
            if not good and turn in (params.rounds // 3, 2 * params.rounds // 3):
                chains[k] = (x, np.where(p[:, CONTENT] > 0.8, CONTENT, BOILERPLATE), good)
        weights += params.step * 8 * g_w / total
        transition += params.step * 8 * g_t / total
    return weights, transition


def _verdict_batches(weights: np.ndarray, transition: np.ndarray, content_share: float):
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_content_lines", "content_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py()
                n, chars, symbols, dups, repeats = base_counts(text)
                failed = n < 50 or 100 * repeats > 50 * n
                features, sizes = line_features(text)
                labels = viterbi(features @ weights, transition)
                content = int(sizes[labels == CONTENT].sum())
                kept = not failed and content >= content_share * n
                rows.append((n, chars, symbols, dups, repeats, failed, kept, len(sizes), int((labels == CONTENT).sum()), content))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 10
            kinds = [pa.bool_() if c in ("base_failed", "kept") else pa.int64() for c in names[1:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names
            )

    return run


def fit_line_field(train: DataFrame, params: LineParams | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most about ``sample_rows`` of ``train(text, good)``, picked by a digest of the text."""
    params = params or LineParams()
    rows = train.where("text is not null and good is not null").select("text", F.col("good").cast("boolean").alias("good"))
    share = min(1.0, params.sample_rows / max(rows.count(), 1))
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    return fit_lines(sorted((r["text"], r["good"]) for r in picked.collect()), params)


def line_quality(
    docs: DataFrame,
    field: tuple[np.ndarray, np.ndarray],
    params: LineParams | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, the base counts, base_failed, kept, and line counts; no shuffle.

    Null, empty and blank texts have no words, fail the base rule and are not kept.
    Lines without a word take no label. Only the two named columns are read.
    """
    params = params or LineParams()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = (
        f"id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
        " base_failed boolean, kept boolean, n_lines bigint, n_content_lines bigint, content_words bigint"
    )
    return rows.mapInArrow(_verdict_batches(*field, params.content_share), out).withColumnRenamed("id", id_col)
