"""Repeated paragraphs against all pairs of lines, and passages inside lines."""

from __future__ import annotations

import random

from helpers import component_ids, shingles, similar, words

from riskloom.llm.paragraphs import repeated_paragraphs


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)) + "."


def corpus(seed=1):
    rng = random.Random(seed)
    pool = [sentence(rng, rng.randint(21, 60)) for _ in range(12)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(1, 6)):
            if rng.random() < 0.5:
                own = rng.choice(pool).split()
                for _ in range(rng.choice([0, 0, 1, 3])):
                    own[rng.randrange(len(own) - 1)] = "zz" + str(rng.random())[2:7]
                lines.append(" ".join(own))
            else:
                lines.append(sentence(rng, rng.randint(1, 50)))
        rows.append((i, "\n".join(lines)))
    return rows


def test_lines_against_all_pairs(spark):
    rows = corpus()
    lines = {}
    for i, text in rows:
        at = 0
        for line in text.split("\n"):
            if len(words(line)) >= 20:
                lines[i, at] = shingles(line)
            at += len(words(line))
    links = [(a, b) for a in lines for b in lines if a < b and similar(lines[a], lines[b])]
    comp = component_ids(lines, links)
    want = {(k, comp[k]) for k in lines if any(k in link for link in links)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as digest", "3 as kind")
    got = [r for r in repeated_paragraphs(docs).collect() if r["kind"] == "paragraph"]
    assert {((r["doc_id"], r["start_word"]), (r["component_id"], r["component_word"])) for r in got} == want
    assert all(r["removed"] == ((r["doc_id"], r["start_word"]) != (r["component_id"], r["component_word"])) for r in got)


def test_passage_inside_lines(spark):
    rng = random.Random(5)
    passage = " ".join(sentence(rng, n) for n in (9, 12, 3, 8, 11, 10))
    rows = [(i, f"{sentence(rng, 30)[:-1]} {passage} {sentence(rng, 40)}") for i in (3, 1, 2)]
    rows += [(4, sentence(rng, 80)), (5, None), (6, ""), (None, passage)]
    got = repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"], r["removed"]) for r in got} == {(1, 1, False), (2, 1, True), (3, 1, True)}
    assert all(r["n_words"] >= 40 for r in got)
    assert repeated_paragraphs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeats_within_one_document_and_repeated_rows(spark):
    rng = random.Random(6)
    line = sentence(rng, 30)
    rows = [(1, f"{line}\nother\n{line}"), (2, sentence(rng, 50)), (2, sentence(random.Random(9), 50))]
    got = repeated_paragraphs(spark.createDataFrame(rows + [rows[0]], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start_word"], r["removed"]) for r in got) == [(1, 0, False), (1, 31, True)]
