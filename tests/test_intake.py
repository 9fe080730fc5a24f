import datetime as dt

import pytest
from pyspark.sql import functions as F

from stemloom.functions import documents as D
from stemloom.operators import intake as I
from stemloom.sources import versions


def test_documents(spark):
    df = spark.createDataFrame([(1, '{"b": 1, "a": ["é", null]}'), (2, '{"a":["\\u00e9",null],"b":1}'), (3, "{"), (4, None), (5, "NaN")], "id long, body string")
    r = {x.id: x for x in df.select("id", D.canonical_json(F.col("body")).alias("c"), D.json_digest(F.col("body")).alias("d")).collect()}
    assert r[1].c == '{"a":["é",null],"b":1}' and r[1].d == r[2].d and r[3].c is None and r[4].d is None and r[5].c is None
    paths = {"a/b.md": True, "../a": False, "a//b": False, "/a": False, "a\\b": False, "c:/a": False, "a./b": False, "con.txt": False, "x/COM1": False, "题/一.md": True, "": False, "a ": False}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", D.safe_relative_path(F.col("p")).alias("ok")).collect()
    assert {x.p: x.ok for x in got} == paths
    t = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5),), (dt.datetime(2024, 1, 2, 3, 4, 5, 60),)], "t timestamp").select(D.utc_z(F.col("t")).alias("z")).collect()
    assert [x.z[-7:] for x in t] == ["3:04:05Z", "000060Z"] or len(t) == 2


@pytest.mark.parametrize(
    "value, schema, want",
    [
        (True, {"type": "integer"}, ["type"]), (1.0, {"type": "integer"}, ["type"]), (0, {"type": "integer", "minimum": 1}, ["minimum"]), ("ab", {"type": "string", "pattern": "a"}, ["pattern"]), ("", {"minLength": 1}, ["minLength"]),
        ({"x": 1}, {"type": "object", "required": ["y"], "additionalProperties": False, "properties": {"y": {}}}, ["required", "additionalProperties"]), ([1, "a"], {"items": {"type": "integer"}, "minItems": 3}, ["minItems", "type"]),
        (1, {"const": True}, ["const"]), (1, {"enum": [True, 2]}, ["enum"]), (3, {"oneOf": [{"const": 3}, {"minimum": 1}]}, ["oneOf"]), (None, {"type": ["null", "string"]}, []),
    ],
)
def test_schema(value, schema, want):
    assert [r for _, r in D.schema_errors(value, schema)] == want


def test_schema_table(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "{"), (3, None)], "id long, body string")
    assert {tuple(r) for r in D.schema_violations(df, "id", "body", {"type": "object", "properties": {"a": {"type": "string"}}}).collect()} == {(1, "$.a", "type"), (2, "$", "json")}


def extracted(spark):
    o = lambda *x: [{"label": a, "text": b} for a, b in x]
    ref = {"source_id": "s", "locator": "page:1"}
    ab = o(("A", "x"), ("B", "y"))
    rows = [
        (1, "b", 1, "single_choice", "s", ab, '"A"', ref, None), (2, "b", 2, "multiple_choice", "s", ab, '["A","B"]', ref, "note"), (3, "b", 3, "true_false", "s", [], "false", ref, None), (4, "b", 4, "single_choice", "s", ab, None, ref, None),
        (5, "b", 5, "essay", " ", o(("B", ""), ("A", "y")), "true", None, None), (6, "b", 6, "single_choice", "s", ab, '"C"', ref, None), (7, "b", 7, "multiple_choice", "s", ab, '["A","A"]', ref, None), (8, "b", 8, "true_false", "s", ab, '"A"', ref, None), (9, "b", 9, None, None, None, "null", ref, None),
    ]
    return spark.createDataFrame(rows, "no long, bank string, pos int, question_type string, stem string, options array<struct<label string, text string>>, answer string, source_reference struct<source_id string, locator string>, extraction_notes string").selectExpr("*", "NULL AS explanation", "NULL AS chapter")


def test_extraction(spark):
    v = {(r.record_id, r.rule) for r in I.extraction_violations(extracted(spark), "no").collect()}
    assert v == {(5, "type"), (5, "stem"), (5, "option_labels"), (5, "option_text"), (5, "source"), (5, "answer"), (6, "answer"), (7, "answer"), (8, "option_count"), (8, "answer"), (9, "type"), (9, "stem"), (9, "option_count")}
    q = {r.stem and i: r for i, r in enumerate(I.compile_questions(extracted(spark).where("no < 5"), "bank", "pos").collect(), 1)}
    assert q[1].answer_label == "A" and q[2].answer_labels == ["A", "B"] and q[3].answer_bool is False and q[4].answer_label is None and q[2].metadata == {"qbc_extraction_notes": "note"} and q[1].metadata == {}
    assert len({r.question_id for r in q.values()}) == 4 and q[1].question_id[14] == "4" and q[1].question_revision == 1


def test_matching(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(1,), (3,), (3,), (4,)], "k int")
    ok, bad = I.one_to_one(a, b, ["k"])
    assert [r.k for r in ok.collect()] == [1]
    assert {tuple(r) for r in bad.collect()} == {(2, "left_repeated"), (2, "right_only"), (3, "right_repeated"), (4, "right_only")} or {tuple(r) for r in bad.collect()} == {(2, "left_repeated"), (2, "left_only"), (3, "right_repeated"), (4, "right_only")}
    old = spark.createDataFrame([("o1", "x", "l1"), ("o2", "y", "l2"), ("o3", "y", "l3"), ("o4", None, "l4")], "oid string, fp string, loc string")
    new = spark.createDataFrame([("n1", "x", "l9"), ("n2", "y", "l3"), ("n3", "z", "l4"), ("n4", None, "l1")], "nid string, fp string, loc string")
    assert {tuple(r) for r in I.match_rescan(old, new, [["fp"], ["loc"]], "oid", "nid").collect()} == {("o1", "n1", 1), ("o3", "n2", 2), ("o4", "n3", 2)}


def test_small_operators(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    assert {tuple(r) for r in I.latest(d, ["k"], ["t"], ["v"]).collect()} == {("a", "y"), ("b", "z")}
    c = spark.createDataFrame([("s", 1, ["a"]), ("s", 2, ["a", "b"]), ("s", 3, ["b"])], "k string, n int, h array<string>")
    assert [r.n for r in I.lineage_closed(c, "k", "n", "h").collect()] == [3]


def test_versions(spark, tmp_path):
    base = f"file://{tmp_path}/t"
    a, b = spark.range(3), spark.range(4)
    assert versions.current(spark, base) is None and versions.restore(spark, base) == 0
    assert versions.publish(a, base) == 1 and versions.publish(a, base) == 1 and versions.publish(b, base, expect=1) == 2
    with pytest.raises(ValueError):
        versions.publish(a, base, expect=1)
    assert versions.current(spark, base).count() == 4
    for f in tmp_path.glob("t/v2-*/*.parquet"):
        f.unlink()
    assert versions.restore(spark, base) == 1 and versions.current(spark, base).count() == 3
    versions.log_event(spark, base, "restore", version=1)
    versions.log_event(spark, base, "note")
    assert spark.read.json(f"{base}/events").count() == 2


def test_a_version_is_never_overwritten(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}/t"
    assert versions.publish(spark.range(3), base) == 1 and versions.publish(spark.range(4), base) == 2
    (tmp_path / "t/current.json").unlink()  # as after a crash between two steps
    assert versions.current(spark, base).count() == 4
    assert versions.publish(spark.range(5), base) == 3
    assert [spark.read.parquet(f"{base}/{versions._read(spark, f'{base}/v{n}.json')['folder']}").count() for n in (1, 2, 3)] == [3, 4, 5]
    (tmp_path / "t/v4.json").write_text('{"versi')  # a record whose writer died
    assert versions.publish(spark.range(6), base, expect=3) == 5 and versions.current(spark, base).count() == 6
    assert versions.ancestry_faults(spark, base) == [(4, "unreadable")]
    # a second writer publishes between the look and the write of the first
    real, done = versions.fingerprint, []

    def slow(df):
        out = real(df)
        if not done:
            done.append(1)
            assert versions.publish(spark.range(8), base, expect=5) == 6
        return out

    monkeypatch.setattr(versions, "fingerprint", slow)
    monkeypatch.setattr(versions, "_numbers", lambda *a: [1, 2, 3, 4, 5])
    with pytest.raises(ValueError):
        versions.publish(spark.range(7), base, expect=5)
    assert versions.current(spark, base).count() == 8


def test_unsafe_characters(spark):
    paths = {"a|b/c": False, "x\u0085y": False, "a<b": False, "a?": False, "CONIN$": False, "com¹.txt": False, "con .txt": False, "conin": True, "课程/一?": False, "课程/一": True}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", D.safe_relative_path(F.col("p")).alias("ok")).collect()
    assert {x.p: x.ok for x in got} == paths


def test_depth_of_canonical_documents(spark):
    rows = [(n, "[" * n + "]" * n) for n in (64, 65, 66, 5000)] + [(1, '{"a": "\\ud800"}')]
    got = {r.id: r.c for r in spark.createDataFrame(rows, "id long, body string").select("id", D.canonical_json(F.col("body")).alias("c")).collect()}
    assert got[64] and got[65] and got[66] is None and got[5000] is None and got[1] is None


def test_bank_rules():
    from stemloom.plans.intake import BANK_SCHEMA, bank_rules

    u = lambda n: f"3f2504e0-4f89-41d3-9a0c-{n:012d}"
    option = lambda label, n: {"label": label, "text": "", "source_option_id": u(n)}
    question = {"question_id": u(1), "question_revision": 1, "question_type": "single_choice", "stem": "", "options": [option("A", 2), option("B", 3)], "source_reference": {"source_id": u(9), "locator": "page:1"}, "status": "candidate"}
    bank = {"schema_version": "1.0", "bank_id": u(0), "title": "t", "questions": [question], "sources": [{"source_id": u(9), "source_file": "a/b.md", "source_type": "text"}]}
    check = lambda b: {(p, r) for p, r in [*D.schema_errors(b, BANK_SCHEMA), *bank_rules(b)]}
    assert check(bank) == set()
    with_question = lambda **x: {**bank, "questions": [{**question, **x}]}
    assert check({k: v for k, v in bank.items() if k != "sources"}) == {("$.sources", "required"), ("$.questions[0].source_reference.source_id", "known")}
    assert check({**bank, "bank_id": "f" * 36}) == {("$.bank_id", "pattern")} and check({**bank, "questions": []}) == {("$.questions", "minItems")}
    assert check(with_question(question_id=u(1) + "\n")) == {("$.questions[0].question_id", "pattern")}
    assert check(with_question(extra=1)) == {("$.questions[0].extra", "additionalProperties")}
    assert check(with_question(options=[option("A", 2), option("A", 2), option("F", 4)])) == {("$.questions[0].options", "unique label"), ("$.questions[0].options", "unique source_option_id"), ("$.questions[0].options[2].label", "choice label")}
    assert check(with_question(question_type="true_false")) == {("$.questions[0].options", "empty")}
    assert check({**bank, "questions": [question, question]}) == {("$.questions", "unique question_id")}
    assert check({**bank, "sources": [{"source_id": u(9), "source_file": "C:\\x", "source_type": "text"}]}) == {("$.sources[0].source_file", "relative")}
    assert {r for _, r in D.schema_errors("xab", {"pattern": "ab"}, search=True)} == set()


def test_matching_by_place(spark):
    old = [("s", "l1", "a"), ("s", "l2", "b"), ("s", "l3", "c"), ("s", "l4", "d"), ("s", "l5", "e"), ("s", "l6", "f"), ("t", "l1", "g"), ("u", "l1", "h"), ("u", "l2", "i")]
    new = [("s", "l1", "A"), ("s", "l2", "B"), ("s", "l3", "C"), ("s", "l4", "D"), ("s", "l5", "E"), ("s", "l7", "F"), ("t", "l1", "G"), ("t", "l2", "H"), ("u", "l1", "I"), ("u", "l3", "J")]
    o, n = (spark.createDataFrame(r, f"s string, o string, {k} string") for r, k in ((old, "oid"), (new, "nid")))
    m = spark.createDataFrame([("a", "A"), ("c", "C"), ("f", "F")], "old_id string, new_id string")
    got = {tuple(r) for r in I.match_by_order(o, n, m, "s", "o", "oid", "nid").collect()}
    # b alone between its neighbours, d and e in order; t has one more now; u has no anchor but its ends
    assert got == {("b", "B", 1), ("d", "D", 2), ("e", "E", 2), ("h", "I", 2), ("i", "J", 2)}
    crossed = spark.createDataFrame([("a", "C"), ("c", "A")], "old_id string, new_id string")
    assert ("b", "B", 1) not in {tuple(r) for r in I.match_by_order(o, n, crossed, "s", "o", "oid", "nid").collect()}
    assert I.match_by_order(o.limit(0), n.limit(0), m.limit(0), "s", "o", "oid", "nid").count() == 0


def test_nearest_values_over_many_partitions(spark):
    from stemloom.operators.export import nearest

    rows = [(i, f"v{i}" if i in (3, 4, 150, 151, 290) else None) for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.i: (r.b, r.a) for r in nearest(spark.createDataFrame(rows, "i int, v string"), ["i"], "v", "b", "a").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    known = [i for i, v in rows if v]
    assert got == {i: (next((f"v{k}" for k in reversed(known) if k < i), None), next((f"v{k}" for k in known if k > i), None)) for i, _ in rows}
