"""Line labelling: exact base counts, Viterbi against all labellings, and held-out verdicts."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
from helpers import WORDS

from riskloom.llm.line_crf import _marginals, base_counts, fit_lines, line_features, line_quality, viterbi


def plain_counts(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_base_counts():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a b c a b c", "x\nx\nx \n\nx", "é ü|<>é\x0b#1\x1fq"]
    texts += ["".join(rng.choice("ab #é\n \t") for _ in range(120)) for _ in range(60)]
    for text in texts:
        assert base_counts(text) == plain_counts(text)


def test_viterbi_and_marginals():
    rng = np.random.default_rng(1)
    for n in range(1, 7):
        emission, transition = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        score = {
            y: sum(emission[i, y[i]] for i in range(n)) + sum(transition[a, b] for a, b in zip(y, y[1:]))
            for y in itertools.product((0, 1), repeat=n)
        }
        assert tuple(viterbi(emission, transition)) == max(score, key=score.get)
        whole = sum(map(np.exp, score.values()))
        p, pairs = _marginals(emission, transition)
        for i in range(n):
            assert np.isclose(p[i, 1], sum(np.exp(s) for y, s in score.items() if y[i]) / whole)
        assert np.isclose(pairs.sum(), n - 1)


def corpus(seed, n=80):
    rng = random.Random(seed)
    good = lambda: " ".join(rng.choice(["tree", "river", "house", "walks", "under", "green"]) + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randint(6, 18))).capitalize() + "."
    bad = lambda: rng.choice([" | ".join(good().split()), "%%% ".join(good().split()), good().upper().replace(" ", "!! ")])
    return [("\n".join((good if i % 2 else bad)() for _ in range(12)), bool(i % 2)) for i in range(n)]


def test_held_out_verdicts_and_edges(spark):
    field = fit_lines(corpus(1))
    rows = [(i, t) for i, (t, _) in enumerate(corpus(2))] + [(None, None), (900, ""), (901, "few words"), (902, "spam ham eggs " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "2 as n_words")
    got = {r["doc_id"]: r for r in line_quality(docs, field).collect()}
    assert len(got) == len(rows)
    for i, (text, good) in enumerate(corpus(2)):
        assert got[i]["kept"] == good and not got[i]["base_failed"]
        assert got[i]["n_lines"] == len(line_features(text)[1]) == 12
    for i in (None, 900, 901, 902):
        assert got[i]["base_failed"] and not got[i]["kept"]
    assert line_quality(docs.limit(0), field).count() == 0


def test_field_without_both_classes():
    weights, transition = fit_lines([("a b\nc", True), ("", False)])
    assert not weights.any() and not transition.any()
    assert viterbi(line_features("a\nb")[0] @ weights, transition).tolist() == [0, 0]
