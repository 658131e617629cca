"""Every stage of the pipeline against a plain version on its own input, and the whole run."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import WORDS, component_ids, shingles, similar
from tokenizers import Tokenizer

import corpus_pipeline
from riskloom.llm.queries import QUERIES, SQL

BAD = ["vile", "rotten", "foul"]


def text_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    path = tmp_path_factory.mktemp("corpus")
    items = [(i, text_of(rng, 30)) for i in range(3)]
    rows, labels = [], []
    for i in range(260):
        words = text_of(rng, rng.choice([6, 60, 200])).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        text = " ".join(words)
        if i % 17 == 3:
            text = f"{text} {items[i % 3][1]} {text_of(rng, 5)}"
        rows.append((i, text, f"s{i % 4}" if i % 9 else None, "en", "own"))
        if i < 200:
            labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 5 and r[0] % 17 != 3]
    for k in range(30):
        words = rng.choice(clean)[1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((300 + k, " ".join(words), "s0", None, None))
    rows += [(400, None, "s1", None, None), (401, "", None, "en", "x"), (1, rows[1][1], rows[1][2], "en", "own"), (None, text_of(rng, 70), "s2", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, component_id string")
    docs.repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), items


def test_stages_and_run(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    outs = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, path), "stage")
        assert docs.columns == columns
        outs.append([tuple(r) for r in docs.collect()])

    want = Counter(r for r in rows if not any(b in (r[1] or "") for b in BAD))
    assert Counter(outs[0]) == want

    sets = {r: shingles(r[1]) for r in set(outs[0]) if r[0] is not None}
    links = [(a[0], b[0]) for a in sets for b in sets if a[0] < b[0] and similar(sets[a], sets[b])]
    component = component_ids([r[0] for r in sets], links)
    assert Counter(outs[1]) == Counter({r for r in outs[0] if r[0] is None or component[r[0]] == r[0]})

    assert Counter(outs[2]) == Counter(r for r in outs[1] if not any(t.rstrip(".").lower() in (r[1] or "").lower() for _, t in items))

    copies, source = Counter(outs[3]), Counter()
    assert set(copies) <= set(outs[2]) and max(copies.values()) <= 2 and all(WORDS.search(r[1] or "") for r in copies)
    size = Counter()
    for r in outs[2]:
        size[r[2]] += len(WORDS.findall(r[1] or ""))
    for r, n in copies.items():
        source[r[2]] += n * len(WORDS.findall(r[1]))
    assert abs(sum(source.values()) - 1.5 * sum(size.values())) < 0.1 * sum(size.values())

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = Counter(), 0
    for r in sorted(outs[3], key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(r[1], add_special_tokens=False).ids + [2]
        want[r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert Counter(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()) == want
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, path).collect()) == want


def test_registered():
    import __spark_entry__ as contract

    assert {q.split("_")[0] for q in QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert {*QUERIES, "pipeline"} <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())
