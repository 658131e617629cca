"""Token counts against the library's count of whole texts."""

from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskloom.llm import token_counts as counting
from riskloom.llm.token_counts import TokenCountParams, WordCutter, text_slices, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CUTTER = WordCutter(PATH)
TEXTS = [
    None, "", " \t\n\x0b ", "Hello, hello HELLO world!", "it's they're I'M 'tis o'clock ''s 'S 'Re", "café café STRASSE Straße ÉÀ ŸŽ",
    "a b\u0085c d　e", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|> <|endoftext|><|endoftext|>.<|endof", "3.14 1,000 x2y ¼² ٣",
    "漢字 かな 🙂🙂 ‍", "İstanbul ΟΔΟΣ ΣΑΣ ǅ ẞ", "word " * 5000, "\x00\x01 \x1c\x1f\x7f a\x1cb", "soft­hyphen ÷ × ª º µ",
    "x" * 20_000, "é" * 50, "= " * 3000, "[" * 300, "́ ́a",
]


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def summed(text):
    _, at, counts, tokens = CUTTER.frequencies(pa.array([text or ""], pa.string()))
    return sum(int(n) * CUTTER.pieces(tokens[int(t)].as_py()) for t, n in zip(at, counts, strict=True))


@pytest.mark.parametrize("text", TEXTS)
def test_pretokens_in_sum_are_the_text(text):
    assert summed(text) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(list(" '<|>.sStTrRé éÉ1²")), max_size=40))
def test_any_text(text):
    assert summed(text) == library(text)


def rows_of(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, token int").repartition(3)
    found = token_counts(docs, TokenCountParams(PATH, **options))
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    return sorted(map(tuple, found.collect()), key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("frequent", [0, 5, 500_000])
def test_every_way_gives_the_library_count(spark, frequent):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice(["tor", "Mole,", "éa", "zz9"]) + str(rng.randint(0, 30)) for _ in range(900)) for _ in range(20)]
    rows = [(None if i % 7 == 0 else i % 11, t, "x", i) for i, t in enumerate(texts)] + [(3, "Hello", None, None)] * 4
    want = sorted((i, len((t or "").encode()), library(t), library(t) > 2048) for i, t, *_ in rows if i is not None)
    got = rows_of(spark, rows, frequent=frequent, frequent_bytes=40)
    assert sorted(r for r in got if r[0] is not None) == want
    assert sorted(r[1:] for r in got if r[0] is None) == sorted(
        (len((t or "").encode()), library(t), library(t) > 2048) for i, t, *_ in rows if i is None
    )


def test_empty_table_and_long_text(spark, monkeypatch):
    assert rows_of(spark, []) == []
    text = ("some words, and more; " * 400_000) + "end"
    assert rows_of(spark, [(1, text, "", 0)]) == [(1, len(text), 400_000 * library("some words, and more;") + 1, True)]
    monkeypatch.setattr(counting, "SLICE", 6)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["aaa b", None, "", "ccccccccc", "d", "e f\n"])})
    slices = [(first, texts.to_pylist(), sizes.tolist()) for first, texts, sizes in text_slices(batch)]
    assert slices == [(0, ["aaa b", "", ""], [5, 0, 0]), (3, ["ccccccccc"], [9]), (4, ["d", "e f\n"], [1, 4])]
    of_text, at, counts, tokens = CUTTER.frequencies(pa.array(["b a,  a\n", "", "a b b"]))
    assert sorted((int(i), tokens[int(t)].as_py(), int(n)) for i, t, n in zip(of_text, at, counts, strict=True)) == [
        (0, ",", 1), (0, "a", 2), (0, "b", 1), (2, "a", 1), (2, "b", 2),
    ]


def test_refuses_tokenizers_that_keep_white_space():
    with pytest.raises(ValueError, match="white space"):
        WordCutter(public_tokenizers.path("byte_bpe_50k.json"))
