from stemloom.operators.lines import boundaries, document_lines, marker_evidence, option_markers, option_report

PAPER = "# title\n1、Glaïtun手册把冰腺规则分为三类\n  A. 港苯沟槽\nB. 78.0 cycles\n- C. 岬氟反应\n接上一行\n2024.01.02\n(2) 第二题的题干文字\nA. one B. two　C、three\nD.\nA、B两组\nb) low\n第三章 复习\n3.\n四、综合题题干"


def run(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    return document_lines(df, "doc_id", "text")


def test_lines(spark):
    d = run(spark, [(1, "﻿a​b c\r\nx\ry\n"), (2, None), (3, "")]).orderBy("doc_id", "line").collect()
    assert [(r.doc_id, r.line, r.normalized_text) for r in d] == [(1, 1, "ab c"), (1, 2, "x"), (1, 3, "y"), (1, 4, ""), (3, 1, "")]
    assert (d[0].bom_removed, d[0].zero_width_removed, d[0].whitespace_replaced) == (1, 1, 0)
    tabs = run(spark, [(1, "a b\tc　d")]).collect()[0]
    assert tabs.whitespace_replaced == 2 and tabs.normalized_text == "a b c d"


def test_boundaries(spark):
    rows = {r.line: r for r in boundaries(run(spark, [(1, PAPER)]), "doc_id").collect()}
    assert {n: r.strength for n, r in rows.items() if r.strength != "NONE"} == {2: "MEDIUM", 8: "STRONG", 14: "WEAK", 15: "MEDIUM"}
    assert (rows[2].question_number, rows[2].question_marker) == (1, "1、") and (rows[8].question_number, rows[8].question_marker) == (2, "(2)")
    assert rows[7].warning == "numeric_false_positive" and rows[13].warning == "section_heading" and rows[14].warning == "incomplete_marker"
    assert rows[3].option_state is False and rows[4].option_state and rows[5].previous_complete and rows[8].previous_complete
    assert rows[15].question_number is None and rows[15].question_marker == "四、"


def test_options(spark):
    rows = option_markers(boundaries(run(spark, [(1, PAPER)]), "doc_id"), "doc_id").orderBy("ordinal").collect()
    assert [(r.line, r.label, r.option_text, r.style) for r in rows] == [
        (3, "A", "港苯沟槽", "dot"), (4, "B", "78.0 cycles", "dot"), (5, "C", "岬氟反应\n接上一行\n2024.01.02", "dot"), (9, "A", "one", "dot"), (9, "B", "two", "dot"), (9, "C", "three", "ideographic_comma"), (12, "B", "low\n第三章 复习\n3.", "close_parenthesis"),
    ]
    assert ["DUPLICATE_OPTION_LABEL" in r.warnings for r in rows] == [False, False, False, True, True, True, True]
    assert [r.continuation_lines for r in rows] == [[], [], [6, 7], [], [], [], [13, 14]]
    assert rows[-1].warnings == ["LOWERCASE_LABEL_NORMALIZED", "DUPLICATE_OPTION_LABEL"]


def test_option_reports(spark):
    texts = [(1, PAPER), (2, "1、题干文字在此\nA. x\nB. y"), (3, "1、题干文字在此\n没有选项"), (4, "A. x\nB. y"), (5, "1、题干文字在此\nA：x\nB）not a marker")]
    b = boundaries(run(spark, texts), "doc_id")
    got = {r.doc_id: (r.n_options, r.confidence, r.warnings) for r in option_report(b, "doc_id").collect()}
    assert got == {1: (7, "medium", ["DUPLICATE_OPTION_LABEL", "INCOMPLETE_OPTION_MARKER", "LETTER_GROUP_NOT_OPTION"]), 2: (2, "high", []), 3: (0, "none", []), 5: (1, "high", [])}
    m = {(r.doc_id, r.line, r.marker): (r.confidence, r.warnings) for r in marker_evidence(b, "doc_id").collect()}
    assert m[1, 10, "D."] == ("low", ["INCOMPLETE_OPTION_MARKER"]) and m[1, 12, "b)"] == ("high", ["LOWERCASE_LABEL_NORMALIZED"]) and len(m) == 11


def test_labels_follow_the_alphabet(spark):
    rows = option_markers(boundaries(run(spark, [(1, "1、题干文字在此\nB. x\nC. y\nA. z\nE. w")]), "doc_id"), "doc_id").orderBy("ordinal").collect()
    assert ["OPTION_SEQUENCE_GAP" in r.warnings for r in rows] == [True, False, True, True]  # expected: A, C, D, D


def test_section_titles(spark):
    rows = {r.normalized_text: r.warning for r in boundaries(run(spark, [(1, "课程名称\n判断题\n单项选择题\n 多项选择题 \n第2节 x")]), "doc_id").collect()}
    assert rows == {"课程名称": "section_heading", "判断题": None, "单项选择题": "section_heading", " 多项选择题 ": "section_heading", "第2节 x": "section_heading"}


def test_no_lines(spark):
    assert option_markers(boundaries(run(spark, [(1, None)]), "doc_id"), "doc_id").count() == 0
