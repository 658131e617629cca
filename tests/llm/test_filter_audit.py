"""The filter audit against counting every order document by document."""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
from helpers import WORDS
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm.filter_audit import audit_documents, gray_states, removed_over_orders

DOCS = "doc_id long, text string, lang string, good string, part int"


def fails(text):
    text = text or ""
    w = WORDS.findall(text)
    return {
        "A": len(w) < 200,
        "B": 100 * len(set(w)) < 50 * len(w),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }


def brute(docs, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    rows = []
    for doc_id, text, lang, *_ in docs:
        f = fails(text)
        f["E"] = doc_id is not None and any((o[1] or "") == (text or "") and o[0] is not None and o[0] < doc_id for o in docs)
        rows.append((lang or "", f, doc_id in good, doc_id in toxic))
    out, orders = set(), ["".join(p) for p in permutations("ABCDE")]
    for part in {r[0] for r in rows}:
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in orders:
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                failing = sum(r[1][f] for r in rows if r[0] == part)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in rows if r[0] == part)
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                steps.append((order, step, f, len(left), len(gone), failing - len(gone), unique, sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out |= {(part, o, s, *rest, shapley[f]) for o, s, f, *rest in steps}
    return out


def audited(spark, docs, labels):
    found = audit_documents(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    )
    assert found.columns == [
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    ]
    rows = found.collect()
    assert len(rows) == len({(r.part, r.filter_order, r.step) for r in rows})
    return {tuple(r) for r in rows}


def test_against_every_order(spark):
    plain = " ".join(f"word{i}" for i in range(220))
    texts = [
        None, "", "short $ text", plain, plain + " #", plain.upper(), "same " * 300, "same " * 300 + "& B" * 50, "É ÀÉ é" * 100,
        "a b c " * 250, "tab\tand\x0bfeed\x0c" * 100, "word " * 60_000 + plain,
    ]
    rng = np.random.default_rng(5)
    docs = [
        (None if i % 17 == 0 else int(rng.integers(0, 60)), texts[int(rng.integers(0, len(texts)))],
         [None, "", "en", "de"][int(rng.integers(0, 4))], "x", i)
        for i in range(150)
    ]
    docs += [docs[3]] * 3 + [(200 + i, plain, "en", None, 1) for i in range(40)]
    labels = [(int(rng.integers(0, 60)) if i % 9 else None, [None, 0, 1][i % 3], [None, 0, 1][i % 4 % 3]) for i in range(80)]
    assert audited(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == set()
    docs = [(1, "x", "en", None, None)]
    assert audited(spark, docs, []) == brute(docs, [])


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(0, 2**32))
def test_walk_equals_sums_over_cells(k, seed):
    cells = np.random.default_rng(seed).integers(0, 9, (2**k, 2))
    states = gray_states(cells)
    for subset in range(2**k):
        assert states[subset].tolist() == cells[[m for m in range(2**k) if not m & subset]].sum(axis=0).tolist()
    totals = [0] * k
    for order in permutations(range(k)):
        before = 0
        for f in order:
            totals[f] += states[before][0] - states[before | 1 << f][0]
            before |= 1 << f
    assert removed_over_orders(states[:, 0], k) == totals
