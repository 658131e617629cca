"""The conversation trie against a plain trie of lists."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from helpers import WORDS

from riskloom.llm.prefix_trie import TrieParams, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs string, depth int"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            print_ = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), role, print_, text))
    own = {c: [(r, t) for _, r, _, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    paths = rebuilt(rows)
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            key = tuple(turns[:d])
            members[key].append(c)
            if d:
                children[key[:-1]].add(key)
        ends[tuple(turns)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, cs in members.items():
        words = len(WORDS.findall(key[-1][1])) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(cs) - 1) * words
    return {
        (min(cs), len(key), min(members[key[:-1]]) if key else None, len(cs), len(children[key]), leaves[key], saved[key],
         hashlib.sha256(",".join(map(str, sorted(ends[key]))).encode()).hexdigest())
        for key, cs in members.items()
    }


def trie(spark, rows, **params):
    found = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), TrieParams(**params))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus():
    rng = random.Random(7)
    rows = []

    def add(c, turns, start=0):
        rows.extend((c, start + i, r, t, "x", i) for i, (r, t) in enumerate(turns))

    openings = [[("user", f"hello {i} there"), ("assistant", "yes \t of course"), ("user", "")] for i in range(3)]
    for c in range(0, 130):
        turns = list(rng.choice(openings))[: rng.randint(0, 3)]
        turns += [(rng.choice(["user", "assistant", None]), rng.choice(["a b", None, "a b c\n", f"own {c}"])) for _ in range(rng.randint(0, 4))]
        if c % 7 == 0:
            turns = [("user", "copied text"), ("assistant", "all the same"), ("user", "end")]
        add(c, turns)
    # Gaps between base conversations, negative ids, numbers out of order, missing and equal numbers, repeated rows.
    for c in (205, 206, 219, -3, -20, -21, -39, 1000):
        add(c, [("user", "hello 1 there"), ("assistant", "yes \t of course"), ("user", f"z{c % 2}")], start=-5)
    rows += [(300, None, "user", "first"), (300, 4, "b", "x"), (300, 4, "a", "y"), (300, None, "user", "first"), (301, 2, None, None)]
    rows += [(None, 0, "user", "nobody's")]
    # Long conversations over several blocks, two of them equal for most of their length.
    for c in (400, 420, 440):
        add(c, [("user", f"turn {i} {'q' if c == 440 and i == 700 else ''}") for i in range(900)])
    add(441, [("user", f"turn {i}") for i in range(300)], start=-100)
    rows = [r if len(r) == 6 else (*r, None, None) for r in rows]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cells", [2**26, 2**12, 2**3])
def test_against_plain_trie(spark, cells):
    rows = corpus()
    assert trie(spark, rows, most_cells=cells, block_bits=6) == brute(rows)


def test_small_tables(spark):
    assert trie(spark, []) == set()
    for rows in (
        [(7, 0, "user", "alone", None, None)],
        [(27, 0, "user", "a", None, 1), (25, 0, "user", "b", None, 2)],
        # Conversations that keep no turn at all end at the root.
        [(c, 0, "user", "x", None, None) for c in range(1, 60) if c % 20 and zlib.crc32(str(c).encode()) % 4],
    ):
        assert trie(spark, rows) == brute(rows)


def test_large_group_of_copies(spark):
    rows = [(c, i, "user", f"t{i} w", None, None) for c in range(0, 200_000, 20) for i in range(2)]
    rows += [(c, 2, "user", str(c), None, None) for c in range(0, 2_000, 20)]
    assert trie(spark, rows) == brute(rows)
