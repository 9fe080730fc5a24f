import random
import unicodedata
from collections import defaultdict
from itertools import combinations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stemloom.llm.plain import _plain_char, lookalike_members, lookalike_pairs, plain_form, with_plain_form


def slow(t):
    """The plain form one text at a time."""
    return unicodedata.normalize("NFC", "".join(_plain_char(c) for c in unicodedata.normalize("NFKD", t)))


ALPHABET = "aeiоеАВ ｅ　  \t\n\r ​­️̣́̈̂ṩǖéÅ가각각⼀⻢𝐀①ﬁµμ℃…中😀क़कɑԁ"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(st.sampled_from(ALPHABET), max_size=30), st.text(max_size=20)), max_size=12))
def test_vector_form_equals_slow_form(texts):
    assert plain_form(pa.array(texts, pa.large_string())).to_pylist() == [slow(t) for t in texts]


def test_random_bulk():
    random.seed(3)
    texts = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 60))) for _ in range(20_000)]
    assert plain_form(pa.array(texts, pa.string())).to_pylist() == [slow(t) for t in texts]


@pytest.mark.parametrize(
    "a, b",
    [("ＡＢ１", "AB1"), ("é", "é"), ("е", "e"), ("ё", "ë"), ("a b", "a b"), ("x​y", "xy"), ("⼭", "山"), ("⻢", "马"), ("路", "路"), ("ﬁ", "fi"), ("ⅹ", "x"), ("co­op", "coop"), ("❤️", "❤"), ("ɡ", "g"), ("ԁ", "d"), ("（", "("), ("　", " "), ("а\u030a", "å"), ("\u0456\u0308", "ï"), ("o\u200b\u0308", "ö"), ("Υ\u0308", "Ÿ"), ("\u00b5", "\u03bc")],
)
def test_same_look(a, b):
    got = plain_form(pa.array([a, b])).to_pylist()
    assert got[0] == got[1]


@pytest.mark.parametrize("a, b", [("a", "A"), ("a  b", "a b"), ("a\tb", "a b"), ("a\nb", "a b"), ("。", "."), ("“", '"'), ("é", "e")])
def test_other_look(a, b):
    got = plain_form(pa.array([a, b])).to_pylist()
    assert got[0] != got[1]


def pairs(rows):
    seen = defaultdict(dict)
    for no, stem, options in rows:
        texts = [stem or ""] + [(o or {}).get("text") or "" for o in options or []]
        seen[tuple(map(slow, texts))][no] = tuple(texts)
    return {(a, b) for g in seen.values() for a, b in combinations(sorted(g), 2) if g[a] != g[b]}


def test_pairs_match_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/extracted_questions.parquet")
    rows = [(r.extract_no, r.stem, [o.asDict() for o in r.options or []]) for r in df.collect()]
    got = [tuple(r) for r in lookalike_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs(rows) and len(got) > 20


def test_pairs_of_odd_rows(spark):
    big = "长" * 200_000
    rows = [(1, None, None), (2, "", []), (3, "a", [("A", None)]), (4, "ａ", [("B", "")]), (5, "а", [None]), (5, "а", [None]), (6, "a", []), (7, big, []), (8, big + "​", None), (9, "a​", [])]
    df = spark.createDataFrame(rows, "extract_no long, stem string, options array<struct<label string, text string>>").selectExpr("*", "1 AS plain", "2 AS h")
    # a null text counts as empty, so 1 and 2 are equal; 3 to 5 have one option each
    assert {tuple(r) for r in lookalike_pairs(df).collect()} == {(3, 4), (3, 5), (4, 5), (6, 9), (7, 8)}
    assert lookalike_pairs(df.limit(0)).count() == 0


def test_column(spark):
    df = spark.createDataFrame([("Ａ",), (None,), ("",)], "t string")
    assert [r.p for r in with_plain_form(df, "t", "p").collect()] == ["A", None, ""]


def test_members_and_hot_rows(spark):
    """The membership form holds the same pairs; salted members give the same result."""
    df = spark.read.parquet("/root/testdata/sf0.01/extracted_questions.parquet")
    want = {tuple(r) for r in lookalike_pairs(df).collect()}
    rows = [tuple(r) for r in lookalike_pairs(df, hot=1).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    for hot in (1, 100_000):
        m = lookalike_members(df, hot=hot).collect()
        by = defaultdict(list)
        for r in m:
            by[r.class_id].append(r)
        assert {tuple(sorted((a.extract_no, b.extract_no))) for g in by.values() for a, b in combinations(g, 2) if a.spelling_first != b.spelling_first} == want
        assert all(r.n_rows == len(g) and r.first == min(x.extract_no for x in g) and r.n_spellings == len({x.spelling_first for x in g}) for g in by.values() for r in g)
    assert lookalike_members(df.limit(0)).count() == 0


def test_the_plain_form_gives_the_pairs(spark, monkeypatch):
    from stemloom.llm import plain

    df = spark.read.parquet("/root/testdata/sf0.001/extracted_questions.parquet")
    assert lookalike_pairs(df).count() > 0
    monkeypatch.setattr(plain, "plain_points", lambda points, offsets: (points, offsets))
    assert lookalike_pairs(df).count() == 0
