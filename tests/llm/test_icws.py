import unicodedata
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from stemloom.llm import icws
from stemloom.llm.icws import band_keys, candidate_texts, idf, near_duplicate_pairs, pair_similarities, near_duplicates, shingle_sets, slot
from stemloom.llm.codepoints import to_codepoints


def shingles(texts):
    out = set()
    for t in texts or []:
        t = "".join(c for c in (t or "") if unicodedata.category(c)[0] in "LN").lower()
        out |= {t[i : i + 3] for i in range(len(t) - 2)}
    return out


def brute(rows, threshold=0.6):
    """Every pair of records with a shingle in common is compared, however many records hold that shingle."""
    sets = {k: s for k, t in rows if (s := shingles(t))}
    by: dict = {}
    out = set()
    for k in sorted(sets):
        both = Counter(o for x in sets[k] for o in by.get(x, ()))
        out |= {(o, k) for o, n in both.items() if n >= threshold * (len(sets[k]) + len(sets[o]) - n) - 1e-9}
        for x in sets[k]:
            by.setdefault(x, []).append(k)
    return out


def test_pairs_match_brute_force(spark):
    d = "/root/testdata/sf0.01/"
    t = candidate_texts(spark.read.parquet(d + "candidates.parquet"), spark.read.parquet(d + "question_bank.parquet"))
    rows = [(r.candidate_id, r.texts) for r in t.collect()]
    assert len(rows) == len({k for k, _ in rows})
    got = [tuple(r) for r in near_duplicate_pairs(t, "candidate_id", "texts").collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(want) > 100 and len(set(got)) >= 0.999 * len(want)


def test_odd_rows(spark):
    long = "".join(chr(0x4E00 + i % 5000) for i in range(60_000))
    rows = [("a", ["Hello, World", None]), ("b", ["helloworld"]), ("c", ["hello", "world"]), ("d", None), ("e", []), ("f", ["xy"]), ("g", [long]), ("h", [long + "终"]), ("b", ["helloworld"]), ("i", [None])]
    df = spark.createDataFrame(rows, "id string, texts array<string>").selectExpr("*", "1 AS c1", "2 AS body", "3 AS key")
    assert {tuple(r) for r in near_duplicate_pairs(df, "id", "texts").collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("g", "h")}
    members, links = near_duplicates(df.limit(0), "id", "texts")
    assert members.count() == 0 and links.count() == 0


def skewed(spark):
    """Every row holds one long passage."""
    common = "".join(chr(0x4E00 + i) for i in range(40))
    rows = [(f"k{i:03}", [common + "".join(chr(0x6000 + i * 40 + j) for j in range(24 if i % 10 else 8))]) for i in range(120)] + [(f"m{i:03}", [common + "".join(chr(0x6000 + i * 40 + j) for j in range(23))]) for i in range(0, 120, 7)]
    return rows, spark.createDataFrame(rows, "id string, texts array<string>")


@pytest.mark.parametrize("limit, crowded", [(3, 64), (64, 64), (512, 2), (3, 2)])
def test_large_buckets_lose_no_link(spark, monkeypatch, limit, crowded):
    """The pairs over the threshold stay, whether buckets count as large or not, and wherever that shows."""
    rows, df = skewed(spark)
    want = brute(rows)
    monkeypatch.setattr(icws, "BUCKET_LIMIT", limit)
    monkeypatch.setattr(icws, "CROWDED", crowded)
    got = [tuple(r) for r in near_duplicate_pairs(df, "id", "texts").collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)


def test_hot_classes_are_salted_without_a_change(spark):
    rows = [(f"a{i:03}", ["the same question " + "text" * (i % 2)]) for i in range(60)] + [("b", ["the same question texts"]), ("c", ["something else altogether"])]
    df = spark.createDataFrame(rows, "id string, texts array<string>")
    got = [tuple(r) for r in near_duplicate_pairs(df, "id", "texts", hot=5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_one_bucket_spread_over_batches(spark):
    """Keys that 4 % of the classes share, a few in each batch: no pair is lost."""
    passage = "".join(chr(0x4E00 + i) for i in range(60))
    rows = [(f"k{i:05}", [passage + chr(0x6000 + i) if i % 25 == 0 else "".join(chr(0x5000 + (i * 37 + j * j) % 20000) for j in range(40))]) for i in range(4000)]
    df = spark.createDataFrame(rows, "id string, texts array<string>").repartition(16)
    members, links = near_duplicates(df, "id", "texts")
    # 160 classes differ in their last shingle only: all their pairs are links
    assert links.count() == 160 * 159 // 2


def test_common_passage_with_defaults(spark):
    """Pairs alike through a passage that all rows hold; all are found as called by p1_found."""
    common = "".join(chr(0x4E00 + i) for i in range(102))
    rows = [(f"k{i:03}", [common + "".join(chr(0x6000 + i * 60 + j) for j in range(20 + i % 3 * 12))]) for i in range(90)] + [("s1", ["abcd"]), ("s2", ["abcde"]), ("s3", ["abc"])]
    df = spark.createDataFrame(rows, "id string, texts array<string>")
    want = brute(rows)
    got = [tuple(r) for r in near_duplicate_pairs(df, "id", "texts").collect()]
    assert 0 < len(want) < 93 * 92 / 2
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.999 * len(want)


def test_weighted_similarity_end_to_end(spark):
    rows, df = skewed(spark)
    members, links = near_duplicates(df, "id", "texts", threshold=0.7, weighted=True)
    of = {(r.c1, r.c2): r.id for r in members.collect()}
    got = {tuple(sorted((of[r.a1, r.a2], of[r.b1, r.b2]))) for r in links.collect()}
    code = lambda s: np.array(sorted((ord(x[0]) << 42) | (ord(x[1]) << 21) | ord(x[2]) for x in s), dtype=np.uint64)
    sets = {k: code(shingles(t)) for k, t in rows}
    counts = np.zeros(1 << icws.SKETCH_BITS, dtype=np.int64)
    for c in {c.tobytes(): c for c in sets.values()}.values():
        counts += np.bincount(slot(c), minlength=len(counts))
    weights = idf(counts, len(of))
    w = lambda c: weights[slot(c)].astype(float).sum()
    want = set()
    for a, b in combinations(sorted(of.values()), 2):
        both = w(np.intersect1d(sets[a], sets[b]))
        if both / (w(sets[a]) + w(sets[b]) - both) >= 0.7:
            want.add((a, b))
    assert want and got <= want and len(got) >= 0.995 * len(want)


def test_weighted_check_loses_no_plain_pair():
    """No sets of plain similarity 0.6 have a weighted one below the bound that the weighted check uses."""
    rng = np.random.default_rng(5)
    lowest = icws.least_weighted(0.6)
    for _ in range(2000):
        both, apart = 60, 40
        w = rng.choice([1.0, icws.RATIO, 1.1], both + apart)
        assert w[:both].sum() / w.sum() >= lowest - 1e-9
    assert abs(both * 1.0 / (both + apart * icws.RATIO) - lowest) < 1e-12
    counts = np.array([0, 1, 2, 50, 100, 1000])
    assert abs(idf(counts, 100).min() - 1) < 1e-6 and abs(idf(counts, 100).max() - icws.RATIO) < 1e-6 and (idf(counts, 1) == 1).all() and (idf(counts, 0) == 1).all()


def test_the_bands_give_the_pairs(spark, monkeypatch):
    """Without a band there is no pair: nothing stands beside the samples."""
    rows, df = skewed(spark)
    monkeypatch.setattr(icws, "band_keys", lambda *a: iter(()))
    assert near_duplicates(df, "id", "texts")[1].count() == 0


def test_sets_when_hashes_collide(monkeypatch):
    text = pa.array(["abcabcab", "", "zabc", "b" * 9])
    want = [{"abc", "bca", "cab"}, set(), {"zab", "abc"}, {"bbb"}]
    for collide in (False, True):
        if collide:
            monkeypatch.setattr(icws, "mix", lambda x: np.zeros_like(x))
        code, at = shingle_sets(*to_codepoints(text))
        read = lambda c: "".join(chr(int(c) >> s & 0x1FFFFF) for s in (42, 21, 0))
        got = [[read(c) for c in code[a:b]] for a, b in zip(at, at[1:])]
        assert [set(g) for g in got] == want and [len(g) for g in got] == [3, 0, 2, 1]


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    words = np.array([chr(0x4E00 + i) for i in range(400)])
    a = rng.choice(words, 120, replace=False)
    b = np.concatenate([a[:90], rng.choice(words, 30)])
    code, at = shingle_sets(*to_codepoints(pa.array(["".join(a), "".join(b)])))
    weights = idf(rng.integers(1, 50, 1 << icws.SKETCH_BITS), 100)
    keys = np.array(list(band_keys(code, at, weights, 4000, 1)))
    x, y = set(code[: at[1]].tolist()), set(code[at[1] :].tolist())
    w = lambda s: weights[slot(np.array(sorted(s), dtype=np.uint64))].sum()
    exact = w(x & y) / w(x | y)
    plain, weighted = pair_similarities(pa.array(["".join(a), "ab", "xyz"]), pa.array(["".join(b), "xyz", "xyz"]), weights)
    assert abs(weighted[0] - exact) < 1e-5 and abs(plain[0] - len(x & y) / len(x | y)) < 1e-9 and plain[1:].tolist() == [0, 1] and weighted[1:].tolist() == [0, 1]
    assert abs((keys[:, 0] == keys[:, 1]).mean() - exact) < 0.03
