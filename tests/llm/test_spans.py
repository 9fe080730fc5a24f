import random
from collections import defaultdict

import numpy as np
import pytest

from stemloom.llm import spans
from stemloom.llm.spans import node_ranks, shared_spans


def brute(rows, length=100):
    owners = defaultdict(set)
    for k, t in rows:
        for i in range(len(t or "") - length + 1):
            owners[t[i : i + length]].add(k)
    out = set()
    for k, t in dict(rows).items():
        n = len(t or "")
        flag = [False] * n
        for i in range(n - length + 1):
            if len(owners[t[i : i + length]]) > 1:
                flag[i : i + length] = [True] * length
        i = 0
        while i < n:
            j = i
            while j < n and flag[j]:
                j += 1
            if j > i:
                out.add((k, i + 1, j - i))
            i = max(j, i + 1)
    return out


def result(df, **how):
    got = [tuple(r) for r in shared_spans(df, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert result(df) == want and len(want) > 100


def made(seed):
    random.seed(seed)
    word = lambda n: "".join(random.choice("ab中文😀 é") for _ in range(n))
    seeds = [word(n) for n in (30, 40, 41, 60, 200)]
    rows = []
    for k in range(80):
        t = "".join(random.choice([word(random.randint(0, 50)), random.choice(seeds), random.choice(seeds) * 2]) for _ in range(random.randint(0, 8)))
        rows.append((k, random.choice([t, t, t, "", None])))
    rows += [(100, "aa" * 300), (101, "aa" * 200), (102, "z" * 39), (103, "z" * 40), (104, "z" * 41), (105, "q" * 500)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot, chunk", [(20_000, 1 << 19), (5, 300), (60, 1 << 19), (1, 1 << 19)])
def test_made_texts(spark, monkeypatch, seed, hot, chunk):
    """With repeats inside a text, periodic texts, lengthened prefixes and texts longer than a chunk."""
    monkeypatch.setattr(spans, "HOT", hot)
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS h", "3 AS lo")
    want = brute(rows, 40)
    assert result(df, length=40, gram=12) == want and want
    if chunk < 1000:
        check_parts(rows, chunk)


def test_longer_prefixes_keep_equal_runs_together():
    """Every run of a stretch goes to one longer prefix, and equal runs to the same."""
    from stemloom.llm.codepoints import to_codepoints
    import pyarrow as pa

    texts = [t for _, t in made(5) if t and len(t) >= 40]
    keys: dict[str, set] = defaultdict(set)
    n_keys = set()
    for t in texts:
        points, _ = to_codepoints(pa.array([t]))
        h, part, lo, hi, _ = spans.anchors(points, np.array([0]), 40, 12)
        bodies = [t[a : b + 40] for a, b in zip(lo, hi)]
        p, off = to_codepoints(pa.array(bodies))
        key, row, first, last = spans.lengthened(p, off, h.view(np.uint64), 40, 12)
        seen = defaultdict(int)
        for k, r, a, b in zip(key.tolist(), row, first, last):
            n_keys.add(k)
            for s in range(a, b + 1):
                keys[bodies[r][s : s + 40]].add((int(h[r]), k))
                seen[r, s] += 1
        assert set(seen.values()) == {1} and len(seen) == sum(len(x) - 39 for x in bodies)
    assert all(len(x) == 1 for x in keys.values()) and len(n_keys) > 10


def check_parts(rows, chunk):
    """The parts of a long row cover each run exactly once."""
    from stemloom.llm.codepoints import to_codepoints
    import pyarrow as pa

    old, spans.CHUNK = spans.CHUNK, chunk
    try:
        points, off = to_codepoints(pa.array([t for _, t in rows]))
        runs = defaultdict(int)
        for p, starts, row, base in spans.pieces(points, off, 40):
            ends = np.append(starts[1:], len(p))
            h, part, lo, hi, at = spans.anchors(p, starts, 40, 12)
            for q, a, b in zip(part, lo, hi):
                for s in range(a, b + 1):
                    assert s + 40 <= ends[q]
                    runs[row[q], base[q] + s - starts[q]] += 1
        assert set(runs.values()) == {1} and len(runs) == sum(max(0, len(t or "") - 39) for _, t in rows)
    finally:
        spans.CHUNK = old


@pytest.mark.parametrize("hot", [20_000, 5])
def test_forged_hashes_share_nothing(spark, monkeypatch, hot):
    """All k-grams of one hash: texts decide, in groups and in lengthened prefixes."""
    monkeypatch.setattr(spans, "HOT", hot)
    monkeypatch.setattr(spans, "gram_hashes", lambda points, k: np.zeros(max(0, len(points) - k + 1), dtype=np.uint64))
    rows = made(3)[:40]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 40)
    assert result(df, length=40, gram=12) == want and want


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "y" * 300), (5, "y" * 300)], "doc_id long, text string")
    assert result(df) == set()
    assert result(df.limit(0)) == set()
    random.seed(4)
    long = "".join(chr(0x4E00 + random.randrange(20_000)) for _ in range(700_000))
    df = spark.createDataFrame([(1, long), (2, "a" + long[1:-1] + "b")], "doc_id long, text string")
    assert result(df) == {(1, 2, 699_998), (2, 2, 699_998)}


def test_ranks():
    points = np.frombuffer("abcabcabxabcab".encode("utf-32-le"), np.uint32)
    text = "abcabcabxabcab"
    starts = np.array([i for i in range(len(text) - 4)])
    ranks = node_ranks(points, starts, 5)
    keys = [text[i : i + 5] for i in starts]
    assert [sorted(set(keys)).index(k) for k in keys] == ranks.tolist()


def test_the_trees_give_the_spans(spark, monkeypatch):
    """Without the level of the suffix trees there is no span."""
    rows = made(1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, length=40, gram=12)
    monkeypatch.setattr(spans, "shared_runs", lambda points, starts, owner, depth: np.zeros(len(starts), dtype=bool))
    assert result(df, length=40, gram=12) == set()
