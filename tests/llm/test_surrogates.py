"""Surrogates: types, distinctness, coreference, collisions, and texts around the entities."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from riskloom.llm import surrogates
from riskloom.llm.surrogates import FEMALE, MALE, SurrogateParams, entity_surrogates, replace_entities

TEXTS = [
    "Mail anna.b@mail3.example.com or call +1 (385) 555-1563 now, card 4003845627459628.",
    "From 71.206.93.8 to anna.b@mail3.example.com; SSN 123-45-6789, IBAN DE44500105175407324931",
    "Mrs. Anna Smith met Mr Smith and Dr. Lee; Госпожа Mrs Анна Белова. Mrs. Anna Smith left.",
    "nothing here but 12 and 3.14 and v1.2.3.4.5", "", None, "4003 8456 2745 9628 and 4003845627459628",
]


def luhn(number):
    digits = [int(c) for c in reversed(re.sub(r"\D", "", number))]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


@pytest.fixture(scope="module")
def replaced(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(0, TEXTS[0])], "doc_id long, text string").selectExpr("*", "'x' as entity", "1 as own", "2 as print")
    return {r["doc_id"]: r for r in replace_entities(docs).collect()}


def test_texts_around_entities_stay(replaced):
    assert [replaced[i]["n_entities"] for i in range(7)] == [3, 4, 5, 0, 0, 0, 2]
    assert replaced[2]["n_distinct"] == 4 and replaced[3]["text"] == TEXTS[3] and replaced[4]["text"] == "" and replaced[5]["text"] is None
    text = replaced[0]["text"]
    got = re.fullmatch(r"Mail (\S+)@(mail\d+\.example\.com) or call \+1 \((\d{3})\) (\d{3})-(\d{4}) now, card (\d{16})\.", text)
    assert got and luhn(got.group(6)) and got.group(6)[0] == "4" and re.fullmatch(r"[a-z]{4}\.[a-z]", got.group(1))
    assert re.fullmatch(r"[a-z]{4}\.[a-z]@\S+; SSN \d{3}-\d{2}-\d{4}, IBAN DE[0-9]{20}", replaced[1]["text"].split(" to ")[1])
    for secret in ("anna.b@", "555-1563", "4003845627459628", "71.206.93.8", "123-45-6789", "500105175407324931", "Smith", "Белова"):
        assert not any(secret in (r["text"] or "") for r in replaced.values())


def test_coreference_gender_and_script(replaced):
    mail = [re.search(r"\S+@\S+\.com", replaced[i]["text"]).group() for i in (0, 1)]
    assert mail[0] == mail[1]
    first, mr, last = re.search(r"Mrs\. (.+?) met (Mr .+?) and", replaced[2]["text"]).groups() + (replaced[2]["text"].split(". ")[-1],)
    assert first in last and first.split()[0] in FEMALE and len(mr.split()) == 2
    assert re.search(r"Mrs [А-Яа-я]+ [А-Яа-я]+\.", replaced[2]["text"])
    assert replaced[6]["text"].split(" and ")[0].count(" ") == 3


def test_collisions_are_drawn_again(spark, monkeypatch):
    names = [f"{t} {g} {f}" for t in ("Mrs", "Mr") for g in (FEMALE + MALE)[:12] for f in ("Aa", "Bb", "Cc")]
    names += [f"{a}.{b}.1.1" for a in range(10, 16) for b in range(30)]
    # A stream of few values makes nearly every first draw collide.
    stream = surrogates._stream
    monkeypatch.setattr(surrogates, "_stream", lambda s, k, v, t: F.when(t == 0, F.repeat(F.lit("0a"), 130)).otherwise(stream(s, k, v, t)))
    got = entity_surrogates(spark.createDataFrame([(n,) for n in names], "entity string"), SurrogateParams()).collect()
    drawn = [r["surrogate"] for r in got]
    assert len(got) == len(names) == len(set(drawn)) and not set(drawn) & set(names)


def test_keyed_and_repeatable(spark):
    docs = spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string")
    texts = [replace_entities(docs, SurrogateParams(secret=s)).first()["text"] for s in ("a", "a", "b")]
    assert texts[0] == texts[1] != texts[2]
    assert replace_entities(docs.limit(0)).count() == 0


def test_long_tokens_and_hosts_end_soon(spark):
    texts = ["x" * 1_000_000 + " @", "a." * 200_000 + "@", "me@" + "hh." * 20_000 + "org", "7" * 300_000, "a@b.com-x, ..c.d@e.co.x 9@1.org9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in replace_entities(docs).collect()}
    assert out[0] == texts[0] and out[1] == texts[1] and out[3] == texts[3]
    # Beyond 127 labels a host is none: what an address can hold is replaced, the rest stays.
    assert not out[2].startswith("me@hh.") and out[2].endswith("hh.org")
    found = spark.createDataFrame([(texts[4],)], "t string").select(surrogates.mentions(F.col("t"))).first()[0]
    assert found == ["a@b.com", "c.d@e.co", "9@1.org"]


def test_only_texts_with_a_mention_are_dealt_out(spark):
    docs = spark.createDataFrame([(i, "plain words " * 500) for i in range(50)] + [(50, TEXTS[0]), (51, None), (52, "")], "doc_id long, text string")
    out = replace_entities(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "strategy=merge" in plan
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 53 and got[3].text == "plain words " * 500 and got[51].text is None and got[52].text == ""
    assert got[50].text != TEXTS[0] and got[50].n_entities > 0 and got[3].n_entities == got[51].n_entities == 0
