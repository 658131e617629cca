"""Token files hold exactly the ids that the library gives for whole texts."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from riskloom.llm.token_files import TokenFileParams, WordEncoder, read_checksums, token_files, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \t\n ", "Hello, hello HELLO world!", "it's they're I'M 'tis o'clock", "café café STRASSE Straße ÉÀ",
    "a b c\u0085d", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "3.14 1,000 x2y __init__ a_b a--b ...!?", "漢字 かな 🙂🙂 ‍",
    "İstanbul ΟΔΟΣ ǅ", "word " * 5000, "\x00\x01 \x1f\x7f", "soft­hyphen ÷ × ª º µ",
]


def expected(text):
    ids = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]
    return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("text", TEXTS)
def test_words_in_a_row_are_the_text(text):
    ids = np.frombuffer(WordEncoder(PATH, 10).text(text), "<u4").tolist()
    assert ids == Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_round_trip(spark):
    rows = [(i * 7 % 13 if i else None, t, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for encoding in ("dictionary", "delta"):
        got = token_files(docs, TokenFileParams(PATH, encoding=encoding)).collect()
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
        want, start = set(), 0
        for doc_id, text, _ in order:
            n, crc = expected(text)
            want.add((doc_id, start, n, crc))
            start += n
        assert {tuple(r) for r in got} == want


def test_empty_table_and_selective_files(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files(docs, TokenFileParams(PATH)).collect() == []
    docs = spark.createDataFrame([(i, f"word{i} " * 30) for i in range(3000)], "doc_id long, text string").repartition(3)
    write_token_files(docs, TokenFileParams(PATH, encoding="delta"), str(tmp_path / "t"))
    part = next((tmp_path / "t").glob("*.parquet"))
    columns = pq.ParquetFile(part).metadata.row_group(0)
    by_name = {columns.column(i).path_in_schema: columns.column(i) for i in range(columns.num_columns)}
    lists = by_name["ids.list.element"]
    assert "DELTA_BINARY_PACKED" in lists.encodings and lists.has_column_index and lists.has_offset_index
    back = read_checksums(spark.read.parquet(str(tmp_path / "t")))
    assert back.count() == 3000 and back.selectExpr("max(start + n_tokens) = sum(n_tokens)").first()[0]
