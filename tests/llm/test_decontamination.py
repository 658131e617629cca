"""Decontamination: verbatim and re-parameterised passages are found, clean texts are not."""

from __future__ import annotations

import random

from riskloom.llm.decontamination import TemplateParams, contaminated, template

ITEM = "A train leaves Paris at 9 with 120 people and travels 300 km to Lyon while Anna counts 120 red cars along the way"
OTHER = "if Bob has 7 apples and gives 7 of them to Carla then Bob keeps nothing at all for the rest of the day"


def words(rng, n):
    return " ".join(rng.choice(["lo", "mi", "ta", "re", "so", "fu", "ba", "ne"]) + str(rng.random())[2:6].translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))


def test_planted_cases(spark):
    rng = random.Random(1)
    changed = ITEM.replace("Paris", "Rome").replace("9", "8").replace("120", "450").replace("km", "miles").replace("Anna", "Zoe")
    broken = changed.replace("450", "77", 1)
    rows = [
        (1, words(rng, 40) + " " + ITEM + " " + words(rng, 40)),
        (2, words(rng, 9) + "\n" + changed.upper().replace("ROME", "Rome").replace("LYON", "Lyon").replace("ZOE", "Zoe") + " " + words(rng, 9)),
        (3, words(rng, 20) + " " + broken + " " + words(rng, 20)),
        (4, words(rng, 200)), (5, None), (6, ""), (None, ITEM), (7, OTHER), (7, OTHER),
        (8, OTHER.replace("7", "9").replace("Bob", "Eve")), (9, OTHER.replace("7 apples", "9 apples")),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as windows", "3 as pos")
    bench = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (None, ITEM), (4, "too short"), (5, "")], "item_id long, text string")
    for block in (4_000_000, 5):
        got = {(r["doc_id"], r["item_id"]): r["n_changed"] for r in contaminated(docs, bench, TemplateParams(block=block)).collect()}
        assert set(got) == {(1, 1), (2, 1), (7, 2), (8, 2)}
        assert got[1, 1] == 0 and got[7, 2] == 0 and got[2, 1] > 0 and got[8, 2] > 0


def test_short_items_use_shorter_windows(spark):
    bench = spark.createDataFrame([(1, "every small zebra sleeps late")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so every small zebra sleeps late today"), (2, "every small zebra sleeps")], "doc_id long, text string")
    assert [tuple(r)[:2] for r in contaminated(docs, bench).collect()] == [(1, 1)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_placeholders():
    tokens, slots = template("The car costs $1,200.50 today. Anna paid 5 kg of it, said (Bob).")
    assert tokens == ["the", "car", "costs", "<num>", "today", "anna", "paid", "<num>", "<unit>", "of", "it", "said", "<name>"]
    assert [s for s in slots if s] == ["1,200.50", "5", "kg", "Bob"]


def test_verbatim_items_of_few_literals(spark):
    """Tables, arithmetic and lists of names: copies are found, other values are not."""
    rng = random.Random(4)
    items = ["12 7 33 9 81 45 6 70 11 3 52", "Anna Bob Carla David Emil Felix Greta Hugo Ivers Jakob", "3 kg 20 cm 15 min 7 km 9 g 4 l", "Rita 5 8 13 21 34"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(i, f"{words(rng, 30)} {x} {words(rng, 30)}") for i, x in enumerate(items)] + [(9, f"{words(rng, 9)} 12 7 33 9 80 44 6 70 12 3 52 {words(rng, 9)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["windows"] > 0, r["n_changed"]) for r in contaminated(docs, bench).collect()}
    assert got == {(i, i): (True, 0) for i in range(4)}
