import datetime as dt
import hashlib
import json
import unicodedata

import pytest

from stemloom.functions import text as T
from stemloom.functions.answers import multiple_choice_list
from stemloom.operators import evidence, export, integrity, registry
from stemloom.sources import files, sinks, versions
from pyspark.sql import functions as F


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, " Café\tx　y ", ["b", "a", "b"]), (2, "  ", []), (3, None, None), (4, "s", ["a", " "])], "id long, stem string, texts array<string>")
    d = T.normal_options(df, "normal", "texts").withColumn("n", T.normalize_text(F.col("stem")))
    r = {x.id: x for x in d.select("id", "n", T.text_fingerprint(F.col("n")).alias("f"), T.option_set_fingerprint(F.col("normal")).alias("o"), T.revision_fingerprint(F.col("n"), F.col("normal"), F.lit("single_choice")).alias("r")).collect()}
    assert r[1].n == "Café x y" and r[1].f == hashlib.sha256("Café x y".encode()).hexdigest()
    assert r[1].o == hashlib.sha256(b'["a","b","b"]').hexdigest()
    assert r[1].r == hashlib.sha256(json.dumps({"options": ["b", "a", "b"], "question_type": "single_choice", "stem": "Café x y"}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert r[2].n is None and r[2].f is None and r[2].o is None and r[3].o is None and r[4].o is None
    e = spark.range(1).select(T.evidence_fingerprint(F.lit(12), F.lit("C")).alias("x"), T.stable_id(F.lit("a"), F.lit("line:1")).alias("u")).collect()[0]
    assert e.x == hashlib.sha256(b"m3-answer-evidence-v1\x0012\x00C").hexdigest()
    assert spark.createDataFrame([(e.u,)], "u string").where(T.is_uuid(F.col("u"))).count() == 1


@pytest.mark.parametrize("texts", [[], [None], ["", None, "a"], ["e", "\u0301e\u0301", None, "가"], ["e\u0301", "x\U0010fffee\u0301", None], ["é"] * 3, ["a\u0323\u0307", "\u1e9b\u0323"]])
def test_composition_of_batches(texts):
    assert T.compose(texts) == [t if t is None else unicodedata.normalize("NFC", t) for t in texts]


def test_registry(spark):
    old = [("s1", "a", ["a"], "h1", 1), ("s2", "b", ["b"], "h2", 1), ("s3", "c", ["c"], "h3", 2), ("s4", "d", ["d"], "h4", 1), ("s5", "e", ["e"], "h5", 1), ("s6", "f", ["f"], "h5", 1), ("s7", "g", ["g"], None, 1)]
    new = [("a", "h1"), ("b", "h2x"), ("c2", "h3"), ("e2", "h5"), ("n", "h9"), ("u", None), ("g", "h7")]
    prev = spark.createDataFrame(old, "source_id string, path string, history array<string>, hash string, revision int")
    cur = spark.createDataFrame(new, "path string, hash string")
    rows, issues = registry.reconcile(prev, cur)
    got = {(r.path, r.change): r for r in rows.collect()}
    assert {k for k in got} == {("a", "unchanged"), ("b", "changed"), ("c2", "renamed"), ("d", "missing"), ("e", "missing"), ("f", "missing"), ("e2", "new"), ("n", "new"), ("g", "changed")}
    assert got["b", "changed"].revision == 2 and got["c2", "renamed"].revision == 2 and got["c2", "renamed"].history == ["c", "c2"]
    assert [tuple(r) for r in issues.collect()] == [("QB-IDENTITY-AMBIGUOUS", "h5", 2, 1)]
    assert {tuple(r) for r in registry.ambiguous_paths(prev, cur, issues).collect()} == {("h5", "old", "e"), ("h5", "old", "f"), ("h5", "new", "e2")}
    assert {r.change for r in registry.reconcile(prev.limit(0), cur)[0].collect()} == {"new"}
    assert {r.change for r in registry.reconcile(prev, cur.limit(0))[0].collect()} == {"missing"}


def test_ancestry_by_doubling(spark):
    n = 37
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)], "k long, p long")
    got = {(r.key, r.ancestor, r.distance) for r in registry.ancestry(chain, "k", "p").collect()}
    assert got == {(i, j, i - j) for i in range(n) for j in range(i)}


def test_ancestry_of_long_chains_and_cycles(spark):
    n = 150
    links = [(f"c{i}", f"c{i - 1}") for i in range(1, n)] + [("x", "y"), ("y", "z"), ("z", "x"), ("t", "x"), ("u", "t"), ("s", "s"), ("r", None)]
    got = sorted(tuple(r) for r in registry.ancestry(spark.createDataFrame(links, "k string, p string"), "k", "p").collect())
    chain = [(f"c{i}", f"c{j}", i - j) for i in range(n) for j in range(i)]
    ring = [("x", "y", 1), ("x", "z", 2), ("x", "x", 3), ("y", "z", 1), ("y", "x", 2), ("y", "y", 3), ("z", "x", 1), ("z", "y", 2), ("z", "z", 3), ("s", "s", 1)]
    tail = [("t", "x", 1), ("t", "y", 2), ("t", "z", 3), ("u", "t", 1), ("u", "x", 2), ("u", "y", 3), ("u", "z", 4)]
    assert got == sorted(chain + ring + tail)


def test_association(spark):
    q = spark.createDataFrame([("s", 1, "q1", ["A", "B"]), ("s", 2, "q2", ["A", "B"]), ("s", 3, "q3", ["A"]), ("s", 4, "q4", ["A", "B"]), ("s", 4, "q5", ["A"]), ("s", None, "q6", ["A"]), ("t", 1, "q7", ["A"])], "source_id string, question_number long, question_id string, labels array<string>")
    e = spark.createDataFrame([("s", 1, "A", "l1"), ("s", 1, "A", "l9"), ("s", 2, "A", "l2"), ("s", 2, "B", "l3"), ("s", 3, "Z", "l4"), ("s", 9, "A", "l5"), ("s", None, "A", "l6"), ("s", 4, "A", "l7")], "source_id string, question_number long, label string, locator string")
    c, left = evidence.associate(q, e)
    assert {r.question_id: (r.conclusion, r.label, r.n_evidence) for r in c.collect()} == {"q1": ("confirmable", "A", 2), "q2": ("conflict", None, 2), "q3": ("conflict", None, 1), "q4": ("low_confidence", None, 1), "q5": ("low_confidence", None, 1), "q6": ("low_confidence", None, 0), "q7": ("missing", None, 0)}
    assert [tuple(r) for r in left.collect()] == [("s", 9, 1)]
    assert {tuple(r) for r in evidence.alternatives(q, e).collect()} == {("q2", "A", True, 1), ("q2", "B", True, 1), ("q3", "Z", False, 1)}


def test_answer_lines(spark):
    df = spark.createDataFrame([(1, "1: A\n\n 2 : B "), (2, "1: A\nbad"), (3, None), (4, "1.A 2.B；3.C\n答案：ACD\n【答案】正确\n答案: 文字\n4）b\nprose")], "id long, text string")
    good, bad = evidence.strict_answers(df, "id", "text")
    assert [(r.id, r.line, r.question_number, r.label) for r in good.orderBy("line").collect()] == [(1, 1, 1, "A"), (1, 3, 2, "B")]
    assert {(r.id, r.bad) for r in bad.collect()} == {(2, 1), (4, 6)}
    rich = [(r.line, r.entry, r.kind, r.question_number, "".join(r.labels), r.confidence) for r in evidence.rich_answers(df.where("id = 4"), "id", "text").orderBy("line", "entry").collect()]
    assert rich == [(1, 1, "ANSWER_KEY_BLOCK", 1, "A", "high"), (1, 2, "ANSWER_KEY_BLOCK", 2, "B", "high"), (1, 3, "ANSWER_KEY_BLOCK", 3, "C", "high"), (2, 1, "UNRESOLVED_ANSWER", None, "ACD", "low"), (3, 1, "JUDGMENT_ANSWER", None, "", "runtime_only"), (4, 1, "TEXT_ANSWER", None, "", "runtime_only"), (5, 1, "NUMBERED_ANSWER", 4, "B", "high"), (6, 1, "UNRESOLVED_ANSWER", None, "", "low")]
    near = spark.createDataFrame([(i, "答案：A、C", n, u, a, x) for i, (n, u, a, x) in enumerate([(7, True, True, False), (None, True, True, False), (7, False, True, False), (7, True, None, False), (7, True, True, True), (7, True, True, None)])], "id long, text string, n int, u boolean, a boolean, x boolean")
    got = evidence.rich_answers(near, "id", "text", "n", "u", "a", "x").orderBy("id").collect()
    assert [(r.kind, r.question_number, r.confidence) for r in got] == [("INLINE_CURRENT", 7, "medium"), *[("UNRESOLVED_ANSWER", None, "low")] * 4, ("INLINE_CURRENT", 7, "medium")] and got[0].labels == ["A", "C"]


def questions(spark):
    o = lambda *xs: [{"label": a, "text": b} for a, b in xs]
    rows = [("q1", "single_choice", 'st "x", y', o(("a", "one, 1"), ("B", 'two "2"')), None, "why\nnot", "b", None, None), ("q2", "multiple_choice", "m", o(("A", "x"), ("C", "z")), "c1", None, None, ["C", "A", "C"], None), ("q3", "true_false", "t", [], None, None, None, None, False), ("q4", "single_choice", "bad", o(("A", "x"), ("a", "y")), None, None, "A", None, None), ("q5", "essay", "bad", [], None, None, None, None, None), ("q6", "single_choice", "blank", o(("A", "x")), None, None, None, None, None), ("q7", "single_choice", "bad", [], None, None, "F", None, None)]
    return spark.createDataFrame(rows, "question_id string, question_type string, stem string, options array<struct<label string, text string>>, chapter string, explanation string, answer_label string, answer_labels array<string>, answer_bool boolean")


def test_csv_round_trip(spark, tmp_path):
    rows = export.csv_rows(questions(spark), ["question_id"])
    assert {(r.question_id, r.reason) for r in export.rejected_rows(questions(spark)).collect()} == {("q4", "duplicate_option_label"), ("q5", "question_type"), ("q7", "answer")}
    out = rows.orderBy("sequence_number").drop("question_id").select(*files.CSV_COLUMNS)
    got = [tuple(r) for r in out.collect()]
    assert [g[0] for g in got] == [1, 2, 3, 4] and [g[9] for g in got] == ["B", "AC", "错误", ""]
    path = str(tmp_path / "bank.csv")
    sinks.write_csv_file(out, path, export.HEADER)
    text = open(path, encoding="utf-8").read()
    assert text.split("\n")[0] == ",".join(export.HEADER) and '"st ""x"", y","one, 1","two ""2"""' in text and not text.startswith("﻿")
    back = files.read_standard_csv(spark, path, export.HEADER).na.fill("")
    assert [tuple(map(str, g)) for g in got] == [tuple(r) for r in back.collect()]
    with pytest.raises(ValueError):
        files.read_standard_csv(spark, path, export.HEADER[:-1] + ("x",))
    sinks.write_csv(out, str(tmp_path / "parts"), export.HEADER)
    assert files.read_standard_csv(spark, str(tmp_path / "parts"), export.HEADER).count() == 4


def test_labels_and_grading(spark):
    d = spark.createDataFrame([("多选题", "A,C", "CA"), ("多选题", "AC", "A"), ("单选题", "B", " B "), ("单选题", "", "B"), ("单选题", None, "B"), ("判断题", "正确", None)], "kind string, k string, r string")
    g = export.grade(d, "k", "r", "kind")
    assert [r.is_correct for r in g.collect()] == [True, False, True, None, None, False]
    s = export.score(g).collect()[0]
    assert (s.graded, s.correct, s.wrong, s.accuracy) == (4, 2, 2, 50.0)
    assert export.score(g.limit(0)).collect()[0].accuracy is None
    assert spark.range(1).select(multiple_choice_list(F.array(F.lit("e"), F.lit("A"), F.lit("A")))).first()[0] == "AE"
    assert export.with_fallback(spark.createDataFrame([(" ",)], "e string"), "e").first()[0] == export.FALLBACK_EXPLANATION


def test_violations(spark):
    v = integrity.shape_violations(spark.createDataFrame([("x", "not-a-uuid", "0" * 64, ""), ("y", "3f2504e0-4f89-41d3-9a0c-0305e82c3301", "zz", "ok")], "id string, u string, h string, s string"), "id", ["u"], ["h"], ["s"])
    assert {(r.record_id, r.field) for r in v.collect()} == {("x", "u"), ("x", "s"), ("y", "h")}
    with pytest.raises(ValueError):
        integrity.assert_none(v)
    u = integrity.unknown_fields(spark.createDataFrame([(1, '{"a":1,"zz":2}'), (2, "{"), (3, None)], "id long, b string"), "id", "b", ["a"])
    assert [tuple(r) for r in u.collect()] == [(1, "zz")]


def test_files(spark, tmp_path):
    root = tmp_path / "in"
    (root / "nested").mkdir(parents=True)
    (root / "alpha.txt").write_bytes("﻿题 one".encode())
    (root / "nested" / "gamma.TXT").write_bytes(b"x")
    (root / "b.markdown").write_bytes(b"\xff\xfe")
    (root / "c.pdf").write_bytes(b"%PDF")
    d = {r.relative_path: r for r in files.discover(spark, str(root)).collect()}
    assert {k: r.support_status for k, r in d.items()} == {"alpha.txt": "builtin_text", "nested/gamma.TXT": "builtin_text", "b.markdown": "unsupported", "c.pdf": "unsupported"}
    assert d["c.pdf"].content_hash == hashlib.sha256(b"%PDF").hexdigest() and d["c.pdf"].size_bytes == 4
    t = {r.relative_path: r.text for r in files.read_texts(spark, str(root)).collect()}
    assert t == {"alpha.txt": "题 one", "nested/gamma.TXT": "x", "b.markdown": None}
    reg = spark.createDataFrame([("s1", "alpha.txt", d["alpha.txt"].content_hash, "present"), ("s2", "nested/gamma.TXT", "old", "present"), ("s3", "gone", "h", "present"), ("s4", "c.pdf", "h", "missing")], "source_id string, path string, hash string, presence string")
    current, stale = files.registered_texts(reg, files.read_texts(spark, str(root)))
    assert [r.source_id for r in current.collect()] == ["s1"] and {(r.source_id, r.reason) for r in stale.collect()} == {("s2", "stale"), ("s3", "suffix"), ("s4", "not_present")}
    other = spark.createDataFrame([("s1", "b.markdown", d["b.markdown"].content_hash, "present"), ("s2", "../a.md", "h", "present"), ("s3", "gone.md", "h", "present"), ("s5", "alpha.txt", "h", "present"), ("s5", "b.md", "h", "present")], "source_id string, path string, hash string, presence string")
    assert {(r.source_id, r.reason) for r in files.registered_texts(other, files.read_texts(spark, str(root)))[1].collect()} == {("s1", "encoding"), ("s2", "unsafe_path"), ("s3", "missing"), ("s5", "not_unique")}
    assert {(r.code, r.relative_path) for r in files.discovery_issues(files.discover(spark, str(root), "nested/")).collect()} == {("QB-SOURCE-UNSUPPORTED", "b.markdown"), ("QB-SOURCE-UNSUPPORTED", "c.pdf")}
    assert files.discover(spark, str(root), "nested").where("relative_path like 'nested%'").count() == 0 and files.discover(spark, str(root), "nest").count() == 4
    (tmp_path / "else").mkdir()
    (tmp_path / "else" / "far.txt").write_bytes(b"far")
    (root / "linked").symlink_to(tmp_path / "else")
    (root / "nested" / "link.md").symlink_to(root / "alpha.txt")
    assert [tuple(r) for r in files.skipped(spark, f"file://{root}").collect()] == [("linked", "reparse_point"), ("nested/link.md", "reparse_point")]
    assert {r.relative_path for r in files.discover(spark, str(root)).collect()} == set(d)
    files.check_roots(str(root), str(tmp_path / "else"))
    for source, workspace in ((root, root), (root, tmp_path), (tmp_path / "none", tmp_path / "w"), (root / "linked", tmp_path / "else")):
        with pytest.raises(ValueError):
            files.check_roots(str(source), str(workspace))
    (tmp_path / "batch.json").write_text(json.dumps({"questions": [{"question_type": "single_choice", "stem": "s", "options": [{"label": "A", "text": "x"}], "answer": ["A"], "source_reference": {"source_id": "s", "locator": "page:1"}}, {"stem": "t", "answer": None}]}))
    rows = files.read_extracted(spark, str(tmp_path / "batch.json")).orderBy("position").collect()
    assert [(r.position, r.stem, r.answer) for r in rows] == [(1, "s", '["A"]'), (2, "t", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "position long, stem string")
    sinks.bank_document(df, {"schema_version": "1.0"}, str(tmp_path / "bank.json"))
    text = (tmp_path / "bank.json").read_text()
    assert text == json.dumps({"schema_version": "1.0", "questions": [{"stem": "a"}, {"stem": "b"}]}, indent=2) + "\n"
    sinks.bank_document(df.limit(0), {"v": 1}, str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == {"v": 1, "questions": []}
    bad = df.withColumn("stem", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        sinks.bank_document(bad, {"schema_version": "2.0"}, str(tmp_path / "bank.json"))
    assert (tmp_path / "bank.json").read_text() == text and not list(tmp_path.glob("*.tmp"))
    assert sinks.indented_json({"b": ["é"], "a": None}) == '{\n  "a": null,\n  "b": [\n    "é"\n  ]\n}\n'
    path = str(tmp_path / "t")
    assert sinks.write_once(df, path, ["position"]) and not sinks.write_once(df, path, ["position"])
    with pytest.raises(ValueError):
        sinks.write_once(df.limit(1), path, ["position"])
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_streams(spark, tmp_path):
    from stemloom.streaming import intake

    t = dt.datetime(2024, 1, 1)
    like = spark.createDataFrame([("a", t), ("a", t + dt.timedelta(hours=1)), ("b", t + dt.timedelta(days=1))], "id string, ts timestamp")
    like.write.parquet(str(tmp_path / "in"))
    s = intake.stream_table(spark, str(tmp_path / "in"), like)
    q = intake.once_each(s, "id", "ts").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 2
    q = intake.arrivals(s, "ts").writeStream.format("memory").outputMode("complete").queryName("arr").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("arr").collect()) == [1, 2]
    scan = spark.createDataFrame([(1, "p", "h", 2), (1, "q", "g", 2), (2, "p", "h2", 2), (3, "r", "g", 1)], "scan_id int, path string, hash string, n_files int")
    where = f"file://{tmp_path}/reg/registry"
    for part, want in (("path = 'p' AND scan_id = 1", None), ("path = 'q' OR scan_id = 2", {("p", "new"), ("q", "new")}), ("scan_id = 3", {("r", "renamed"), ("p", "missing")})):
        scan.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "scan"))
        intake.follow_registry(intake.stream_table(spark, str(tmp_path / "scan"), scan, per_trigger=1), f"file://{tmp_path}/reg", str(tmp_path / "c3")).awaitTermination(120)
        now = versions.current(spark, where)
        # scan 1 comes in two files; scan 2 is never whole, one of its two rows is missing
        assert (now and {(r.path, r.change) for r in now.collect()}) == want


def test_every_response_is_graded(spark, tmp_path):
    from stemloom.plans.curation import QUERIES

    spark.createDataFrame([(i, 1, "单选题", "A") for i in (1, 2)] + [(3, 1, "多选题", "AB"), (4, 2, "单选题", ""), (5, 9, "单选题", "A")], "csv_row_id long, sequence_number int, question_type string, correct_answer string").write.parquet(f"{tmp_path}/standard_bank_rows.parquet")
    given = [(1, "A"), (1, "B"), (1, "B"), (1, "b, a"), (1, None), (2, "A"), (None, "A")]
    spark.createDataFrame([(i, "s", n, a, None) for i, (n, a) in enumerate(given)] + [(0, "s", 1, "A", None)], "entry_id long, source_id string, question_number int, raw_answer string, raw_entry string").write.parquet(f"{tmp_path}/answer_key_entries.parquet")
    got = {(r.question_type, r.graded, r.correct, r.wrong, r.accuracy) for r in QUERIES["grade_responses"](spark, str(tmp_path)).collect()}
    assert got == {("单选题", 10, 2, 8, 20.0), ("多选题", 5, 1, 4, 20.0)}
