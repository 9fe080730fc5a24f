"""question_children against a plain recursive reading of the same documents."""

import json

import pytest

from stemloom.operators.dewey import dewey_nodes, dewey_tables, parse_document, question_children

DATA = "/root/testdata/sf0.01/raw_banks.parquet"


def plain(file_no, body):
    try:
        doc = json.loads(body, parse_int=str, parse_float=str, object_pairs_hook=list_of_pairs)
    except (ValueError, TypeError):
        return []
    out, n = [], 0
    if not isinstance(doc, Pairs):
        return out
    for k, v in doc:
        groups = [v] if k == "questions" else [w for s in v if isinstance(s, Pairs) for x, w in s if x == "questions"] if k == "sections" and isinstance(v, list) else []
        for g in groups:
            if isinstance(g, Pairs) or not isinstance(g, list):
                continue
            for q in g:
                if not isinstance(q, Pairs):
                    continue
                n += 1
                m = dict(q)
                rows = {"option": [], "locator": [], "note": []}
                o = m.get("options")
                if isinstance(o, Pairs):
                    rows["option"] = [k for k, _ in o]
                elif isinstance(o, list):
                    for e in o:
                        label = dict(e).get("label") if isinstance(e, Pairs) else None
                        rows["option"].append("" if label is None else str(label))
                r = m.get("source_reference")
                for one in [r] if isinstance(r, Pairs) else r if isinstance(r, list) else []:
                    if isinstance(one, Pairs):
                        loc = dict(one).get("locator")
                        rows["locator"] += [x for x in loc if x is not None] if isinstance(loc, list) else [loc] if loc is not None else []
                meta = m.get("metadata")
                notes(dict(meta).get("qbc_extraction_notes") if isinstance(meta, Pairs) else None, rows["note"])
                out += [(file_no, kind, n, i, str(x)) for kind, xs in rows.items() for i, x in enumerate(xs, 1)]
    return out


class Pairs(list):
    pass


def list_of_pairs(p):
    return Pairs(p)


def notes(v, into):
    if isinstance(v, str):
        if v.strip():
            into.append(v)
    elif isinstance(v, Pairs):
        for k in ("text", "items"):
            for a, b in v:
                if a == k:
                    notes(b, into)
    elif isinstance(v, list):
        for x in v:
            notes(x, into)


def test_children_match_plain_reading(spark):
    df = spark.read.parquet(DATA)
    want = sorted(r for x in df.collect() for r in plain(x.file_no, x.body) if x.body)
    got = sorted(tuple(r) for r in question_children(df).collect())
    assert got == want
    assert {"option", "locator", "note"} == {r[1] for r in got}


def test_shapes(spark):
    q = '{"options": [null, "x", {"label": 1.50}, {"label": null}], "source_reference": [{"locator": ["a", null, 7]}, {"locator": ""}], "metadata": {"qbc_extraction_notes": {"items": ["b", " "], "text": "a"}}}'
    rows = [(1, '{"questions": [%s, null, {"options": {"B": {}, "A": 1}}]}' % q), (2, None), (3, ""), (4, "{"), (5, '{"questions": NaN}'), (6, "[]"), (7, '{"sections": [{"questions": [{"options": ["z"]}]}, null], "questions": [{}, {"options": ["w"]}]}'), (8, '{"questions": {"options": []}}')]
    df = spark.createDataFrame(rows, "file_no long, body string").selectExpr("*", "'x' AS label", "'y' AS value")
    got = sorted(tuple(r) for r in question_children(df).collect())
    assert got == sorted([
        (1, "option", 1, 1, ""), (1, "option", 1, 2, ""), (1, "option", 1, 3, "1.50"), (1, "option", 1, 4, ""),
        (1, "locator", 1, 1, "a"), (1, "locator", 1, 2, "7"), (1, "locator", 1, 3, ""),
        (1, "note", 1, 1, "a"), (1, "note", 1, 2, "b"), (1, "option", 2, 1, "B"), (1, "option", 2, 2, "A"),
        (7, "option", 1, 1, ""), (7, "option", 3, 1, ""),
    ])


def test_a_repeated_row_counts_once(spark):
    body = '{"questions": [{"options": [{"label": "A"}, {"label": "B"}, {}], "source_reference": {"locator": ["x", "x"]}}, {"options": {"C": 1}}]}'
    one = spark.createDataFrame([(1, body)], "file_no long, body string")
    want = sorted(tuple(r) for r in question_children(one).collect())
    assert sorted(tuple(r) for r in question_children(one.union(one).union(one)).collect()) == want and len(want) == 6


def test_deep_and_long_documents(spark):
    deep = "[" * 30_000 + "]" * 30_000
    assert parse_document(deep)[0]
    body = '{"questions": [{"metadata": {"qbc_extraction_notes": %s"n"%s}}]}' % ("[" * 1_500, "]" * 1_500)
    df = spark.createDataFrame([(1, body)], "file_no long, body string")
    assert [tuple(r) for r in question_children(df).collect()] == [(1, "note", 1, 1, "n")]
    many = spark.createDataFrame([(1, json.dumps({"questions": [{"options": [{"label": str(i)} for i in range(1200)]}]}))], "file_no long, body string")
    assert [r.child_key for r in question_children(many).orderBy("child_pos").collect()] == [str(i) for i in range(1200)]


@pytest.mark.parametrize("text, ok", [("1", True), ('"\\ud800"', True), ("[1,]", False), ("{} x", False), ('{"a":1,"a":2}', True), ("Infinity", False), ("  ", False)])
def test_validity(text, ok):
    assert parse_document(text)[0] is ok


def test_tables_keep_parent_links(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": "x"}, {"b": "\\ud800"}]}')], "file_no long, body string")
    t = {(r.table_path, r.label): r for r in dewey_tables(dewey_nodes(df, "file_no", "body"), "file_no").collect()}
    leaf = next(r for (p, _), r in t.items() if p == "$/a/[]/b" and r.value == "x")
    assert t[("$/a/[]", leaf.parent_label)].kind == "object"
    assert t[("$", "")].parent_label is None
    assert dewey_nodes(df.limit(0), "file_no", "body").count() == 0
