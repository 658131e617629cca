"""Toxicity: held-out accuracy, both scoring ways, and edge cases."""

from __future__ import annotations

import random

import pytest

from riskloom.llm.toxicity import ToxicityModel, ToxicityParams, fit_toxicity, toxicity_scores, without_toxic

BAD = ["vile", "rotten", "foul"]


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(5000)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([5, 30, 300, 1500]))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(BAD).title() + rng.choice(["", ".", ","]))
        rows.append((i, " ".join(text), toxic))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    train = spark.createDataFrame([r[1:] for r in corpus(seed=2)], "text string, toxic boolean")
    return train, fit_toxicity(train)


def test_held_out_accuracy(spark, fitted):
    rows = corpus(seed=9)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity_scores(docs, fitted[1], ["doc_id"]).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert sum(got[i]["predicted"] == toxic for i, _, toxic in rows) >= 0.98 * len(rows)


def test_joined_model_scores_alike(spark, fitted):
    train, model = fitted
    joined = fit_toxicity(train, ToxicityParams(broadcast_rows=0))
    docs = spark.createDataFrame([r[:2] for r in corpus(60, 9)] + [(None, None), (7, "")], "doc_id long, text string")
    a = sorted((r["doc_id"] or -1, round(r["score"], 6)) for r in toxicity_scores(docs, model, ["doc_id"]).collect())
    b = sorted((r["doc_id"] or -1, round(r["score"], 6)) for r in toxicity_scores(docs, joined, ["doc_id"]).collect())
    assert len(a) == 62 and [x for x, _ in a] == [x for x, _ in b]
    assert all(abs(x - y) < 0.05 for (_, x), (_, y) in zip(a, b, strict=True))


def test_rows_and_columns_stay(spark, fitted):
    rows = [(1, "vile rotten thing", "s"), (2, None, None), (3, "", "s"), (3, "", "s"), (None, "w1 w2", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = without_toxic(docs, fitted[1])
    assert out.columns == docs.columns
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, rows[1:]))
    assert toxicity_scores(docs.limit(0), fitted[1], ["doc_id"]).count() == 0


def test_without_labels_or_one_class(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for rows, low, high in (([], 0.49, 0.51), ([("a b", True)], 0.9, 1.0), ([("a b", False)], 0.0, 0.1)):
        model = fit_toxicity(spark.createDataFrame(rows, "text string, toxic boolean"))
        assert low <= toxicity_scores(docs, model, ["doc_id"]).first()["score"] <= high


PHRASES = {"pair of harmless words": "cold harbor", "second word after one word only": "so grimfell", "first word": "^zorn"}


@pytest.mark.parametrize("kind", PHRASES)
def test_expressions_count_by_themselves(spark, kind):
    """Only the phrase tells the classes apart: its words are harmless alone, follow one word only, or open texts."""
    rng, phrase = random.Random(5), PHRASES[kind].split()

    def text(toxic):
        words = [f"w{rng.randint(1, 60)}" for _ in range(20)]
        if phrase[0].startswith("^"):
            return " ".join([phrase[0][1:]] * toxic + words)
        for w in ("cold", "harbor", "so"):
            words.insert(rng.randrange(len(words)), w)
        words = " ".join(words).replace("cold harbor", "harbor cold").split()
        if toxic:
            for w in ("cold", "harbor"):
                words.remove(w)
            at = rng.randrange(len(words))
            words[at:at] = phrase if phrase[0] == "cold" else ["cold", "w1", "harbor", *phrase]
        return " ".join(words)

    rows = [(text(i % 4 == 0), i % 4 == 0) for i in range(600)]
    model = fit_toxicity(spark.createDataFrame(rows[:400], "text string, toxic boolean"))
    docs = spark.createDataFrame([(i, *rows[i]) for i in range(400, 600)], "doc_id long, text string, toxic boolean")
    for m in (model, ToxicityModel(model.grams, model.rows, model.offset, model.weights, ToxicityParams(broadcast_rows=0))):
        got = toxicity_scores(docs, m, ["doc_id", "toxic"]).collect()
        assert sum(r["toxic"] == bool(r["predicted"]) for r in got) >= 196
