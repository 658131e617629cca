"""Near duplicates against all pairs, and the edge cases of the docstring."""

from __future__ import annotations

import random

import numpy as np
from helpers import component_ids, shingles, similar

from riskloom.llm import near_duplicates as module
from riskloom.llm.components import components
from riskloom.llm.near_duplicates import PERMUTATIONS, min_max_signature, near_duplicates, without_near_duplicates


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own) if rng.random() < 0.7 else "\n".join(own).upper())
    texts += ["", None, " \t", "one", "ONE", "one two"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_against_all_pairs(spark):
    rows = corpus()
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])]
    want = component_ids(sets, links)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as component_id", "'k' as kept", "1 as id")
    got = {r["id"]: r for r in near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_chain_between_components(spark):
    """b links a and c, which are not similar; the star of their bucket need not see it."""
    rng = random.Random(1)
    base = [f"x{i}" for i in range(120)]
    rows = []
    for i in range(12):
        own = list(base)
        for j in range(i * 3, i * 3 + 6):
            own[(j * 9) % 120] = f"y{i}-{j}-{rng.random()}"
        rows.append((i, " ".join(own)))
    sets = {i: shingles(t) for i, t in rows}
    want = component_ids(sets, [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])])
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["id"]: r["component_id"] for r in got} == want


def test_kept_rows_nulls_and_repeated_rows(spark):
    long = " ".join(f"v{i}" for i in range(50))
    rows = [(5, long, "a"), (5, long, "a"), (7, long, None), (None, long, "b"), (None, None, "c"), (8, None, "d"), (9, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `kept` string")
    out = without_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(
        map(repr, [(5, long, "a"), (None, None, "c"), (8, None, "d"), (9, "", None)])
    )
    empty = docs.limit(0)
    assert near_duplicates(empty).count() == 0 and without_near_duplicates(empty).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**64, 3000, np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    equal = (min_max_signature(a) == min_max_signature(b)).mean()
    assert abs(equal - 1500 / 2500) < 0.15 and len(min_max_signature(a)) == 2 * PERMUTATIONS


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 400)]
    got = components(spark.createDataFrame(path + star + [(7, 7)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 400)}}


def test_copies_around_a_center(spark):
    """Many copies of one text, more or less edited with few words: some are linked to others only, most to the center."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(90)] = rng.choice(["and", "the", "of", f"r{rng.randint(0, 9)}"])
        rows.append((i, " ".join(own)))
    rows[20] = (20, " ".join(["q"] * 3 + base[12:80] + ["r", "s", "t", "u"]))
    rows[120] = (120, " ".join(["q"] * 3 + base[12:80] + ["r", "s", "t", "v"]))
    sets = {i: shingles(t) for i, t in rows}
    want = component_ids(sets, [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])])
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["id"]: r["component_id"] for r in got} == want
    assert 2 < len(set(want.values())) < 100


def test_two_groups_in_the_same_buckets(spark, monkeypatch):
    """Members of two groups that are not linked share all buckets: their pairs are ruled out without being compared."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    other = [*base[:50], *(f"c{i}" for i in range(20)), *base[70:]]
    rows = []
    for i in range(120):
        own = list(base if i % 2 == 0 else other)
        own[rng.choice([*range(40), *range(80, 120)])] = f"y{i}"
        rows.append((i, " ".join(own)))
    sets = {i: shingles(t) for i, t in rows}
    want = component_ids(sets, [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])])
    assert set(want.values()) == {0, 1}
    compared = []
    plain = module._compared

    def counted(pairs, texts):
        compared.append(pairs.count())
        return plain(pairs, texts)

    monkeypatch.setattr(module, "_compared", counted)
    hits = spark.createDataFrame([(k, i, 0) for k in range(8) for i, _ in rows], "key long, id long, center long")
    got = module.linked_components(hits, spark.createDataFrame(rows, "id long, text string")).collect()
    assert {r["node"]: r["component"] for r in got} == want
    assert sum(compared) < 1200
