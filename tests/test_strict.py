"""The grammar on texts put together from blocks whose result is known by construction."""

import random

import pytest

from stemloom.operators.strict import NOTHING_FOUND, STRUCTURE, SUMMARIES, UNSUPPORTED, parse_issues, strict_parse

# (lines, question (number, stem, options) or None, finding (offset, code, summary) or None); offsets count from the block's first line
S = SUMMARIES
BLOCKS = [
    (["1. [single_choice] Q one", "- A. a", "- B. b"], ("1", "Q one", "AB"), None),
    (["2) [single_choice]  stem\u3000x ", "", "\t- A) a", "  ", "* B. b", "+ C) c"], ("2", "stem\u3000x", "ABC"), None),
    (["17. [single_choice] many", *[f"- {chr(65 + i)}. {i}" for i in range(26)]], ("17", "many", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), None),
    (["3. [multiple_choice] m", "- A. a", "- B. b"], None, (0, UNSUPPORTED, S["type"])),
    (["4. plain", "prose"], None, (0, STRUCTURE, S["header"])),
    (["007) [single_choice] z"], None, (0, STRUCTURE, S["header"])),
    (["9."], None, (0, STRUCTURE, S["header"])),
    (["5. [single_choice] few", "- A. a"], None, (0, STRUCTURE, S["options"])),
    (["5. [single_choice] none"], None, (0, STRUCTURE, S["options"])),
    (["6. [single_choice] order", "- A. a", "- C. c"], None, (0, STRUCTURE, S["options"])),
    (["6. [single_choice] twice", "- A. a", "- B. b", "- A. a"], None, (0, STRUCTURE, S["options"])),
    (["6. [single_choice] low", "- a. a", "- B. b"], None, (0, STRUCTURE, S["options"])),
    (["7. [single_choice] bad", "- A. a", "- B.x", "prose"], None, (2, STRUCTURE, S["malformed"])),
    (["8. [single_choice] prose", "- A. a", "- B. b", "", "prose", "- D.x"], None, (4, STRUCTURE, S["unknown"])),
    (["8. [single_choice] fenced", "- A. a", "```", "1. [single_choice] hidden", "- A. a", "````", "- B. b"], None, (2, STRUCTURE, S["unknown"])),
    (["4. plain", "~~~~", "1. [single_choice] hidden", "~~~", "```", "- A. a", "~~~~~"], None, (0, STRUCTURE, S["header"])),
]
BEFORE = [
    ([], []), (["prose", "", "1.5 mg"], []), (["```", "1. [single_choice] hidden", "- A. a", "- B. b", "``` "], []),
    (["- A. a", "prose", "- b. b", "* C.c"], [(0, STRUCTURE, S["outside"]), (2, STRUCTURE, S["outside"]), (3, STRUCTURE, S["outside"])]),
]


def documents(n):
    random.seed(11)
    for i in range(n):
        lines, findings = (list(x) for x in random.choice(BEFORE))
        findings = [(line + 1, c, t) for line, c, t in findings]
        questions, blocks = [], random.choices(BLOCKS, k=random.randint(0, 6))
        for body, question, finding in blocks:
            at = len(lines) + 1
            lines += body
            if question:
                questions.append((*question, at))
            if finding:
                findings.append((at + finding[0], *finding[1:]))
        rejected = len(blocks) - len(questions)
        if blocks and not blocks[-1][1] and random.random() < 0.3:  # a fence left open after a block that is rejected anyway
            plain = ["4. plain"], (len(lines) + 1, STRUCTURE, S["header"])
            lines += [*plain[0], "```x", "1. [single_choice] hidden", "~~~"]
            findings += [plain[1], (plain[1][0] + 1, STRUCTURE, S["fence"])]
            rejected += 1
        yield i, random.choice(["\n", "\r\n", "\r"]).join(lines), questions, sorted(findings), rejected


def test_known_documents(spark):
    made = list(documents(400))
    odd = [(900, ""), (901, None), (904, "x" * 200_000)]
    df = spark.createDataFrame([(i, t) for i, t, *_ in made] + odd, "id long, text string").selectExpr("*", "1 AS line", "2 AS block", "3 AS k")
    questions, findings, report = strict_parse(df, "id", "text")
    q, f = {}, {}
    for r in questions.orderBy("header_line").collect():
        q.setdefault(r.id, []).append((r.display_number, r.stem, "".join(o.label for o in r.options), r.header_line))
    for r in findings.collect():
        f.setdefault(r.id, []).append((r.line, r.code, r.summary))
    rep = {r.id: r for r in report.collect()}
    for i, text, want_q, want_f, rejected in made:
        assert q.get(i, []) == want_q and sorted(f.get(i, [])) == want_f, text
        assert (rep[i].accepted, rep[i].rejected, rep[i].question_like, rep[i].publishable) == (len(want_q), rejected, len(want_q) + rejected, bool(want_q) and not want_f), text
    assert 901 not in rep and not rep[900].question_like and not rep[904].n_findings
    issues = parse_issues(findings, report, "id").collect()
    by = {}
    for r in issues:
        by.setdefault(r.id, []).append(r)
    assert [(r.locator, r.code, r.summary, r.blocking_level) for r in by[900]] == [("line:1", STRUCTURE, NOTHING_FOUND, "review_required")]
    assert all((r.blocking_level == "blocking") == (r.code == UNSUPPORTED) and r.allowed_user_actions[-1] == ("mark unsupported" if r.code == UNSUPPORTED else "exclude") for r in issues)
    assert all(len(by.get(i, [])) == (len(want_f) or (0 if want_q else 1)) for i, _, want_q, want_f, _ in made)


def test_option_texts(spark):
    df = spark.createDataFrame([(1, "1. [single_choice] a\n- A.  x y \n\n* B) z")], "id long, text string")
    assert [(o.label, o.text, o.line) for o in strict_parse(df, "id", "text")[0].first().options] == [("A", "x y", 2), ("B", "z", 4)]


def test_empty_table(spark):
    for d in strict_parse(spark.createDataFrame([], "id long, text string"), "id", "text"):
        assert d.count() == 0


@pytest.mark.parametrize("text, n", [("1. [single_choice] a\n- A. x\n- B. y", 1), ("1. [single_choice] a\n- A. x", 0), ("```\n1. [single_choice] a\n```\n1. [single_choice] b\n- A. x\n- B. y", 1)])
def test_small(spark, text, n):
    assert strict_parse(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text")[0].count() == n
