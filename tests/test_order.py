import pytest

from stemloom.functions import order
from stemloom.operators import registry


@pytest.mark.parametrize("texts", [[], [None], ["Straße", None, "STRASSE", "", "ΣΑΣ", "题A"], ["x\U0010fffeY", "Z", None]])
def test_folding(texts):
    assert order.fold_texts(texts) == [t if t is None else t.casefold() for t in texts]


def test_orders(spark):
    d = spark.createDataFrame([(1, "b"), (2, "Straße"), (3, "strasse"), (4, "B"), (5, "STRASSE2"), (6, None)], "id long, path string")
    want = sorted([(1, "b"), (2, "Straße"), (3, "strasse"), (4, "B"), (5, "STRASSE2")], key=lambda r: (r[1].casefold(), r[1]))
    assert [tuple(r) for r in d.where("path IS NOT NULL").orderBy(*order.by_path("path", "path")).collect()] == want
    e = spark.createDataFrame([("s", "line:2", "a"), ("s", "line:10", "b"), ("r", "x", "c")], "source_id string, locator string, evidence_fingerprint string")
    assert [r.evidence_fingerprint for r in e.orderBy(*order.by_evidence()).collect()] == ["c", "b", "a"]
    f = spark.createDataFrame([(2, "b", "x"), (2, "a", "y"), (1, "z", "z"), (2, "a", "x")], "line int, code string, summary string")
    assert [tuple(r) for r in f.orderBy(*order.by_line()).collect()] == [(1, "z", "z"), (2, "a", "x"), (2, "a", "y"), (2, "b", "x")]
    o = spark.createDataFrame([("b",), (None,), ("a",)], "o string")
    assert [r.o for r in o.orderBy(order.by_option("o")).collect()] == [None, "a", "b"]


def test_chains(spark):
    rows = [("a", None, 1, "x", None), ("b", "a", 2, "y", "x"), ("c", "b", 4, "z", "y"), ("d", "b", 3, "w", "q"), ("e", "gone", 1, "v", None), ("f", None, 2, "u", None), ("g", "h", 2, "t", "t"), ("h", "g", 3, "t", "t")]
    d = spark.createDataFrame(rows, "k string, p string, n int, h string, ph string")
    got = {tuple(r) for r in registry.chain_faults(d, "k", "p", "n", "h", "ph").collect()}
    # g and h form a cycle: one of its links must break the count
    assert got == {("c", "generation"), ("d", "digest"), ("e", "parent"), ("f", "generation"), ("g", "generation")}
    assert registry.chain_faults(d.limit(0), "k", "p", "n", "h", "ph").count() == 0
