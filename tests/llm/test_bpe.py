import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stemloom.llm import bpe
from stemloom.llm.bpe import FragmentEncoder, count_tokens, decode_ids, encode_texts, vocabulary_path


@pytest.fixture(scope="module")
def data():
    return open(vocabulary_path(), "rb").read()


@pytest.fixture(scope="module")
def mine(data):
    return FragmentEncoder(data)


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def encode(mine, texts):
    out = []
    for lo, hi, ids, off in mine.batches(pa.array(texts, pa.string())):
        out += [ids[off[i] : off[i + 1]].tolist() for i in range(hi - lo)]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("asmtdlrve'' \n\t中文1.　")), max_size=50), min_size=1, max_size=8))
def test_any_text(mine, other, texts):
    assert encode(mine, texts) == other(texts)


def test_contractions_and_blanks(mine, other):
    random.seed(7)
    texts = ["".join(random.choice("aaellstdmrv'''  \n\t0 ,’中é ") for _ in range(random.randint(0, 30))) for _ in range(20_000)]
    texts += ["it's they'll 'tis don't'''s", "   ", "<|endoftext|>", "a" * 5000, "中" * 5000, "x \n"]
    assert encode(mine, texts) == other(texts)


def test_long_texts_in_chunks(mine, other, monkeypatch):
    random.seed(9)
    text = "".join(random.choice(["the ", "cat ", " sat", "'s ", "题库", "\n\n", "  ", "x1 "]) for _ in range(40_000))
    want = other([text, "b", text[:500]])
    monkeypatch.setattr(bpe, "CHUNK", 2000)
    assert encode(mine, [text, "b", text[:500]]) == want


def test_table(spark, mine):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (1, "a b"), (4, " ")], "doc_id long, text string").selectExpr("*", "7 AS ids", "8 AS n_tokens")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_texts(df, "doc_id", "text").collect())
    assert got == [(1, [64, 275]), (1, [64, 275]), (2, []), (3, []), (4, [220])]
    assert sorted(tuple(r) for r in count_tokens(df, "doc_id", "text").collect()) == [(1, 2), (1, 2), (2, 0), (3, 0), (4, 1)]
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_documents(spark, other):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], other([r.text or "" for r in rows])))
    assert {r.doc_id: list(r.ids) for r in encode_texts(df, "doc_id", "text").collect()} == want
    assert {r.doc_id: r.n_tokens for r in count_tokens(df, "doc_id", "text").collect()} == {k: len(v) for k, v in want.items()}


def test_no_token_holds_a_forced_cut(mine):
    for t in mine.ranks:
        b = np.frombuffer(t, np.uint8).astype(int)
        assert mine.inside[b[:-1] * 256 + b[1:]].all()


def test_ids_give_the_texts_back(spark):
    rows = [(1, "Hello, 世界 😀\r\n"), (2, ""), (3, None), (4, "x" * 50_000), (5, " \t<|endoftext|>")]
    df = spark.createDataFrame(rows, "k long, t string").selectExpr("*", "1 AS ids", "2 AS text")
    got = {r.k: r.text for r in decode_ids(encode_texts(df, "k", "t"), "k", "ids").collect()}
    assert got == {k: t or "" for k, t in rows}
    lists = spark.createDataFrame([(1, None), (2, [])], "k long, ids array<int>")
    assert [r.text for r in decode_ids(lists, "k", "ids").collect()] == ["", ""] and decode_ids(lists.limit(0), "k", "ids").count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        decode_ids(spark.createDataFrame([(1, [10**7])], "k long, ids array<int>"), "k", "ids").collect()


@pytest.mark.parametrize("text", ["早期的骨帆肽信号，误将样本写成韧沟波。" * 90, "plain words without an end " * 90, "早期的骨帆肽信号" * 200, "，。" * 500 + "甲，" * 300 + " x，。y" * 100])
def test_long_texts_are_cut_where_pieces_begin(mine, monkeypatch, text):
    raw = np.frombuffer(text.encode(), np.uint8)
    whole, _ = mine.encode(raw, np.array([0, len(raw)]))
    monkeypatch.setattr(bpe, "CHUNK", 200)
    ids, off = mine._long(raw, False)
    assert ids.tolist() == whole.tolist() and off.tolist() == [0, len(whole)]
    parts = []
    monkeypatch.setattr(mine, "encode", lambda data, o, c: parts.append(len(data)) or (np.zeros(0, np.int32), np.array([0, 0])))
    mine._long(raw, True)
    if "，误将" in text or "words" in text:
        assert max(parts) < 800 and len(parts) > 5
