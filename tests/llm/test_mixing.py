"""Mixing: exact targets, schedule balance, and the bounds on what is taken."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from helpers import WORDS

from riskloom.llm.mixing import MixParams, mix_sources, mixed_documents


def targets(sizes):
    """Reshare the excess until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    limit = {s: 2 * sizes[s] for s in order}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(limit[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > limit[s]}
        if not over:
            return {**{s: float(limit[s]) for s in full}, **share}
        full |= over


def corpus(seed, n=400):
    rng = random.Random(seed)
    names = ["a", "b", "é", "z", None, "hot", "B", ""]
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.35 else rng.choice(names)
        rows.append((i, " ".join("w" for _ in range(rng.choice([0, 3, 40, 300, 2000]))), source))
    return rows + [(n, None, "a"), (n + 1, "", None), (5, rows[5][1], rows[5][2]), (None, "x y z", "b"), (n + 2, "", "void")]


@pytest.mark.parametrize("seed", range(2))
def test_targets_and_bounds(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as place", "3 as taken")
    got = mix_sources(docs)[0].collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, text, source in rows:
        size[source] += len(WORDS.findall(text or ""))
    want = targets(size)
    by_id = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        source = by_id[r["id"]]
        assert r["source_size"] == size[source] and r["target"] == pytest.approx(want[source], rel=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= 3 * 128 + 0.01 * target
    again = mix_sources(docs)[0].collect()
    assert sorted((r["id"] or -1, r["taken"]) for r in got) == sorted((r["id"] or -1, r["taken"]) for r in again)


def test_schedule_is_balanced_everywhere(spark):
    rows = [(i, "w " * 500, s) for i, s in enumerate("abc" * 40)]
    documents, draws = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), MixParams(block=50))
    source = {r["row_id"]: rows[r["id"]][2] for r in documents.collect()}
    slots = sorted({(r["slot"], source[r["row_id"]]) for r in draws.collect()})
    share = Counter(s for _, s in slots)
    for start in range(0, len(slots) - 60, 30):
        part = Counter(s for _, s in slots[start : start + 60])
        for s, n in share.items():
            assert abs(part[s] - 60 * n / len(slots)) <= 3


def test_mixed_documents(spark):
    rows = corpus(3, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixed_documents(docs)
    copies = Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect())
    assert out.columns == docs.columns and set(copies) <= {tuple(r) for r in rows}
    assert max(copies[k] / rows.count(k) for k in copies) <= 2 and not any(k[1] in (None, "") for k in copies)
    assert mixed_documents(docs.limit(0)).count() == 0
    assert mix_sources(docs.where("text is null"))[0].first()["taken"] == 0
