"""Repeated byte strings against every window of every text."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import repeats
from riskloom.llm.repeats import longest_repeats, remove_repeats


def brute(rows, length=400):
    raws = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for (doc_id, _), b in zip(rows, raws, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(11)
    make = lambda n: "".join(rng.choice("abcde éfgh\n") for _ in range(n))
    passage, other = make(900), make(450)
    rows = [(i, make(rng.randint(0, 300)) + passage[rng.randint(0, 200) :] + make(rng.randint(0, 300))) for i in range(12)]
    rows += [(20 + i, make(500) + other + make(100) + other) for i in range(3)]
    rows += [(30, passage), (31, passage), (32, passage[:399]), (33, None), (34, ""), (34, ""), (35, "ab" * 700), (36, "ab" * 200)]
    rows += [(40, passage), (40, passage), (None, make(600)), (41, make(350) + passage[100:430]), (42, passage[100:430] + make(90))]
    return rows


@pytest.mark.parametrize("group", [512, 3])
def test_against_every_window(spark, monkeypatch, group):
    """Small groups, and the same with groups that count as large from four members on."""
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as n", "3 as raw").repartition(3)
    got = remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_long_texts_are_read_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    rng = random.Random(2)
    a = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    rows = [(1, a), (2, a[1500:4800] + "z"), (3, "y" + a[900:1400])]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("spans").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_interval_tree_against_all_pairs():
    rng = random.Random(4)
    for _ in range(300):
        room, n = rng.randint(0, 8), rng.randint(2, 9)
        side = lambda: bytes(rng.choice(b"ab") for _ in range(rng.choice([room, room, rng.randint(0, room)])))
        members = sorted(((side(), side()) for _ in range(n)), key=lambda m: m[1])
        want = []
        for i, (l, r) in enumerate(members):
            best = None
            for j, (l2, r2) in enumerate(members):
                if i != j:
                    a = next((k for k, (x, y) in enumerate(zip(l, l2)) if x != y), min(len(l), len(l2)))
                    b = next((k for k, (x, y) in enumerate(zip(r, r2)) if x != y), min(len(r), len(r2)))
                    if a + b >= room:
                        best = (max(a, best[0]), max(b, best[1])) if best else (a, b)
            want.append(best)
        assert longest_repeats([m[0] for m in members], [m[1] for m in members], room) == want
