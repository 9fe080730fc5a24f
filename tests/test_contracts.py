from stemloom.operators import contracts as C

U = "3f2504e0-4f89-41d3-9a0c-0305e82c330"
H = "0" * 64


def test_shapes(spark):
    kind = "candidate_id string, candidate_revision int, source_id string, locator string, stem string, question_type string, status string, fingerprints struct<stem_fingerprint:string,option_set_fingerprint:string,content_revision_fingerprint:string>, duplicate_group string, options array<struct<option_id:string,candidate_id:string,option_revision:int,normalized_text_fingerprint:string,current_position:int,source_label:string,source_ref:struct<source_id:string,locator:string>,previous_labels:array<string>>>"
    option = (U + "1", U + "0", 1, H, 1, "A", (U + "9", "p"), [])
    rows = [
        (U + "0", 1, U + "9", "l", "s", "single_choice", "candidate", (H, H, H), None, [option]),
        (U + "2", 0, "odd", "", None, "essay", "candidate", (H, None, "x"), "", [option, ("x", U + "0", None, H, 0, "", (None, ""), None)]),
        (U + "3", 1, U + "9", "l", "s", "ambiguous", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, kind)
    got = {(r.record_id[-1], r.path, r.code.removeprefix("QB-CONTRACT-")) for r in C.contract_violations(df, "candidate_id", C.CANDIDATE, {"options": C.OPTION}).collect()}
    assert got == {
        ("2", "candidate_revision", "CARDINALITY"), ("2", "source_id", "PATTERN"), ("2", "locator", "CARDINALITY"), ("2", "stem", "TYPE"), ("2", "question_type", "ENUM"), ("2", "fingerprints.option_set_fingerprint", "PATTERN"), ("2", "fingerprints.content_revision_fingerprint", "PATTERN"), ("2", "duplicate_group", "CARDINALITY"),
        ("2", "options[1].option_id", "PATTERN"), ("2", "options[1].option_revision", "TYPE"), ("2", "options[1].current_position", "CARDINALITY"), ("2", "options[1].source_label", "CARDINALITY"), ("2", "options[1].source_ref.source_id", "PATTERN"), ("2", "options[1].source_ref.locator", "CARDINALITY"), ("2", "options[1].previous_labels", "TYPE"),
        ("3", "status", "ENUM"), ("3", "options", "TYPE"), *(("3", f"fingerprints.{f}", "PATTERN") for f in ("stem_fingerprint", "option_set_fingerprint", "content_revision_fingerprint")),
    }
    assert C.contract_violations(df.limit(0), "candidate_id", C.CANDIDATE, {"options": C.OPTION}).count() == 0


def test_option_pairing(spark):
    c = spark.createDataFrame([("q", [("A", 1, "a"), ("B", 2, "b"), ("C", 3, "c")]), ("alone", [("A", 1, "a")]), ("q", [("A", 1, "a"), ("B", 2, "b"), ("C", 3, "c")])], "candidate_id string, options array<struct<source_label:string,current_position:int,option_id:string>>")
    b = spark.createDataFrame([("q", [("A", "x", "a"), ("B", "y", "other"), ("D", "z", "d")]), ("none", None)], "question_id string, options array<struct<label:string,text:string,source_option_id:string>>")
    assert {tuple(r) for r in C.option_pairing(c, b).collect()} == {("q", "B", 2, "option_id"), ("q", "C", 3, "candidate_only"), ("q", "D", 3, "bank_only")}
    k = spark.createDataFrame([("q", "A", "confirmable"), ("q", "Z", "confirmable"), ("q", None, "missing"), ("gone", "A", "confirmable")], "question_id string, label string, conclusion string")
    assert {tuple(r) for r in C.answer_options(k, c).collect()} == {("q", "A", "a"), ("q", "Z", None), ("gone", "A", None)}


def test_manifest(spark):
    kind = "source_id string, kind string, path string, history array<string>, hash string, revision int"
    p = spark.createDataFrame([(s, "q", "a", ["a"], "h", 2) for s in "abcde"], kind)
    e = spark.createDataFrame([("a", "q", "b", ["a", "b"], "i", 3), ("b", "x", "a", ["a"], "h", 2), ("c", "q", "a", ["a"], "h", 1), ("d", "q", "b", ["b"], "h", 2), ("f", "q", "n", ["n"], "h", 1), ("g", "q", "n", ["m"], "h", 1), ("h", "q", "n", [], "h", 1)], kind)
    rows, faults = C.merge_manifest(p, e)
    assert {(r.source_id, r.path, r.revision) for r in rows.collect()} == {("a", "b", 3), ("b", "a", 2), ("c", "a", 2), ("d", "a", 2), ("e", "a", 2), ("f", "n", 1)}
    assert {tuple(r) for r in faults.collect()} == {("b", "kind"), ("c", "revision"), ("d", "history"), ("g", "path"), ("h", "path")}
    assert C.merge_manifest(p.limit(0), e.limit(0))[0].count() == 0


def test_reviews(spark):
    r = spark.createDataFrame([("r1", "k1", "open", 1), ("r2", "k2", "open", 1), ("r3", "k2", "open", 2), ("r4", "k3", "resolved", 5), ("r5", "k3", "archived", 7), ("r6", "k1", "resolved", 9)], "review_id string, k string, status string, at int")
    w = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("k4",), ("k3",)], "k string")
    assert {tuple(x) for x in C.find_or_create(r, w, ["k"], ["at"]).collect()} == {("k1", "reuse", "r1", None), ("k2", "ambiguous", None, None), ("k3", "create", None, "r5"), ("k4", "create", None, None)}
