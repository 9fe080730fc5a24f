import unicodedata
from collections import defaultdict

import numpy as np
import pytest

from stemloom.llm import canonical
from stemloom.llm.canonical import bloom_filter, canonical_rows, collapsed, hidden_copies, possible_repeats
from tests.llm.test_plain import slow


def canon(t):
    return "".join(c for c in slow(t or "").lower() if unicodedata.category(c)[0] in "LN")


def brute(rows):
    groups = defaultdict(set)
    for no, stem, options in rows:
        groups[canon(stem), tuple(sorted(canon((o or {}).get("text")) for o in options or []))].add(no)
    return groups.values()


def test_copies_match_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/extracted_questions.parquet")
    groups = brute([(r.extract_no, r.stem, [o.asDict() for o in r.options or []]) for r in df.collect()])
    want = {(min(g), x) for g in groups for x in g if len(g) > 1}
    copies, singles = hidden_copies(df)
    got = [tuple(r) for r in copies.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert sorted(r[0] for r in singles.collect()) == sorted(x for g in groups if len(g) == 1 for x in g)
    assert {(r.extract_no, r.n_copies) for r in collapsed(df).collect()} == {(min(g), len(g)) for g in groups}


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "。 ", []), (3, "a", [("A", "x"), ("B", "y"), ("C", "y")]), (4, " Ａ!", [("A", "Y"), ("B", "Y."), ("C", "x")]), (5, "a", [("A", "x"), ("B", "x"), ("C", "y")]), (5, "a", [("A", "x"), ("B", "x"), ("C", "y")]), (6, "ax", [("A", "y"), ("B", "y")]), (7, "a", [None])]
    df = spark.createDataFrame(rows, "extract_no long, stem string, options array<struct<label string, text string>>").selectExpr("*", "1 AS hash", "2 AS canonical", "3 AS k")
    copies, singles = hidden_copies(df)
    assert {tuple(r) for r in copies.collect()} == {(1, 1), (1, 2), (3, 3), (3, 4)}
    assert sorted(r[0] for r in singles.collect()) == [5, 6, 7]
    copies, singles = hidden_copies(df.limit(0))
    assert copies.count() == singles.count() == 0


@pytest.mark.parametrize("range_rows", [500, 1 << 20])
def test_filter_misses_no_repeat(spark, range_rows):
    df = spark.range(0, 6000, numPartitions=5).selectExpr("id", "concat('t', CASE WHEN id % 3 = 0 THEN id % 500 ELSE id + 10000 END) AS canonical").selectExpr("*", "xxhash64(canonical) AS hash")
    marked = possible_repeats(df, 6000, range_rows)
    counts = df.groupBy("canonical").count()
    assert marked.where("NOT again").join(counts.where("count > 1"), "canonical", "left_semi").count() == 0
    assert marked.count() == 6000 and marked.where("again").count() < 2100


def test_share_of_passing_rows_does_not_grow_with_the_table(spark):
    """Unique rows that pass by chance: as few with 25 ranges as with one, since bits a row are fixed."""
    df = spark.range(0, 400_000, numPartitions=8).selectExpr("id", "xxhash64(id, 7) AS hash")
    passed = [possible_repeats(df.limit(n) if n < 400_000 else df, n, 16_384).where("again").count() / n for n in (16_384, 400_000)]
    assert max(passed) < 0.01


def test_ranges_give_the_same_copies(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/extracted_questions.parquet")
    one, many = ([sorted(tuple(r) for r in x.collect()) for x in hidden_copies(df, range_rows=n)] for n in (1 << 24, 20))
    assert one == many and one[0] and one[1]


def test_one_group_with_a_third_of_the_rows(spark):
    df = spark.range(0, 3000).selectExpr("id AS extract_no", "CASE WHEN id % 3 = 0 THEN concat('Same', repeat(' ', int(id % 7))) ELSE concat('t', id) END AS stem", "CAST(array() AS array<struct<label string, text string>>) AS options")
    copies, singles = hidden_copies(df)
    assert copies.where("first = 0").count() == 1000 and singles.count() == 2000


def test_segments_are_put_back_in_place(spark):
    df = spark.range(0, 4000, numPartitions=3).selectExpr("xxhash64(id % 1000) AS hash")
    packed = bloom_filter(df, 1 << 16, segment_bits=1 << 13)
    h = np.array([r.hash for r in df.distinct().collect()])
    pos = canonical._bits(h, 1 << 16)
    assert np.unpackbits(packed)[pos.astype(np.int64)].all()


def test_canonical_text(spark):
    df = spark.createDataFrame([(1, "B a-1", [("A", "二"), ("B", "一")])], "k long, stem string, options array<struct<label string, text string>>")
    r = canonical_rows(df, "k", "stem", "options").collect()[0]
    assert r.canonical.split("\U0010ffff") == ["ba1", "一", "二", ""]


def test_the_filters_give_the_copies(spark, monkeypatch):
    """What the filters call single is never grouped."""
    df = spark.read.parquet("/root/testdata/sf0.001/extracted_questions.parquet")
    assert hidden_copies(df)[0].count() > 0
    monkeypatch.setattr(canonical, "bloom_filter", lambda hashes, bits: np.zeros(-(-bits // 8), np.uint8))
    copies, singles = hidden_copies(df)
    assert copies.count() == 0 and singles.count() == df.count()
