import random

import pytest
from tokenizers import Tokenizer

from assayflow.llm.tokens import decode_corpus, encode_corpus


@pytest.fixture(scope="module")
def judge():
    import public_tokenizers as public

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def texts():
    r = random.Random(4)
    parts = [" ", "  ", "\n", "\t \n", "it's", "we'll", "abc", "Ünïcode", "日本語", "12345", "--", "...", "<|endoftext|>", "é", "👩‍🔬", "x" * 50, " " * 40, " ", "'s"]
    mixed = ["".join(r.choice(parts) for _ in range(n)) for n in (1, 5, 80, 200, 400, 900) for _ in range(6)]
    return [None, "", " ", "a" * 700, " " * 500, "ab " * 300, "\n" * 300 + "x", "'" * 400, *mixed]


def test_chunks_equal_one_go(spark, judge):
    rows = [(i, t, "extra") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in encode_corpus(df, "doc_id", "text", chunk=64, overlap=16).collect()}
    want = {i: judge.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    assert {i: rows[i][1] for i in got if got[i] != want[i]} == {}
    assert got.keys() == want.keys()


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b " * 50), (1, "a b " * 50), (1, None)], "doc_id long, text string")
    assert sorted(len(r.ids) for r in encode_corpus(df, "doc_id", "text", chunk=64, overlap=16).collect())[:2] == [0, 101]
    assert encode_corpus(df, "doc_id", "text", chunk=64, overlap=16).count() == 3
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(texts()) if t is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    back = decode_corpus(encode_corpus(df, "doc_id", "text", chunk=64, overlap=16), "doc_id", "ids")
    assert {r.doc_id: r.text for r in back.collect()} == dict(rows)
