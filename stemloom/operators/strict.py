"""The strict question grammar as windows over classified lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemloom.functions.text import WHITE, logical_lines

# Patterns and finding texts of the grammar.
EDGE = rf"[^{WHITE}](?:(?d:.*)[^{WHITE}])?"
PATTERNS = {
    "FENCE": r"^[ \t]*(`{3,}|~{3,})(?d:.*)\z",
    "HEADER": rf"^[ \t]*([1-9][0-9]*)[.)][ \t]+\[single_choice\][ \t]+({EDGE})[ \t]*\z",
    "QLIKE": r"^[ \t]*[0-9]+[.)](?=[ \t]|\[|\z)[ \t]*((?d:.*))\z",
    "OPTION": rf"^[ \t]*[-*+][ \t]+([A-Z])[.)][ \t]+({EDGE})[ \t]*\z",
    "LOWER": rf"^[ \t]*[-*+][ \t]+[a-z][.)][ \t]+{EDGE}[ \t]*\z",
    "OPTLIKE": r"^[ \t]*[-*+][ \t]+[A-Za-z][.)](?d:.*)\z",
    "BLANK": r"^[ \t]*\z",
}
STRUCTURE, UNSUPPORTED = "QB-STRUCTURE-AMBIGUOUS", "QB-TYPE-UNSUPPORTED"
SUMMARIES = {
    "options": "Question block does not satisfy supported option structure.",
    "header": "Question-like header does not match the supported grammar.",
    "type": "Question-like header uses an unsupported type marker.",
    "outside": "Option-like line appears outside a question block.",
    "malformed": "Question block contains a malformed option line.",
    "unknown": "Question block contains an unsupported nonblank line.",
    "fence": "Markdown fence is not closed.",
}


def classified_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, text, class of all lines outside fences; a fence's opening line stays, as FENCE.

    Which fence line opens and which closes is a fold over only the document's fence candidates: (line, mark, length,
    closing form) triples; all else is one projection.
    """
    d = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), logical_lines(F.col(text)).alias("lines"))
    marks = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, PATTERNS["FENCE"], 1).alias("f"), F.trim(F.translate(x, "\t", " ")).alias("bare"))), lambda s: s["f"] != "")
    start = F.struct(F.lit(-1).alias("open"), F.lit("").alias("mark"), F.array().cast("array<struct<a:int,b:int>>").alias("done"))

    def step(acc, s):
        closes = (F.substring(s["f"], 1, 1) == F.substring(acc["mark"], 1, 1)) & (F.length(s["bare"]) >= F.length(acc["mark"])) & (F.length(F.translate(s["bare"], "`~", "")) == 0) & (F.length(F.replace(s["bare"], F.substring(acc["mark"], 1, 1), F.lit(""))) == 0)
        opened = F.struct(s["i"].cast("int").alias("open"), s["f"].alias("mark"), acc["done"].alias("done"))
        closed = F.struct(F.lit(-1).alias("open"), F.lit("").alias("mark"), F.concat(acc["done"], F.array(F.struct(acc["open"].alias("a"), s["i"].cast("int").alias("b")))).alias("done"))
        return F.when(acc["open"] < 0, opened).when(closes, closed).otherwise(acc)

    d = d.withColumn("fold", F.aggregate(marks, start, step))
    d = d.withColumn("hidden", F.concat("fold.done", F.when(F.col("fold.open") >= 0, F.array(F.struct(F.col("fold.open").alias("a"), F.lit(2147483647).alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))))
    rows = d.select("k", "hidden", "fold.open", F.posexplode("lines").alias("i", "t"))
    inside = F.exists("hidden", lambda h: (F.col("i") > h["a"]) & (F.col("i") <= h["b"]))
    rows = rows.where(~inside)
    kind = F.lit("OTHER")
    for name, p in reversed(PATTERNS.items()):
        kind = F.when(F.col("t").rlike(p), F.lit(name)).otherwise(kind)
    return rows.select(F.col("k").alias(key), (F.col("i") + 1).alias("line"), F.col("t").alias("text"), kind.alias("class"), (F.col("i") == F.col("open")).alias("unclosed"))


def _blocks(lines: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("line")
    d = lines.withColumn("block", F.sum(F.col("class").isin("HEADER", "QLIKE").cast("int")).over(w))
    b = Window.partitionBy(key, "block")
    d = d.withColumns({"head": F.first("class").over(b.orderBy("line")), "head_line": F.min("line").over(b), "nth": F.sum((F.col("class") == "OPTION").cast("int")).over(b.orderBy("line"))})
    in_header = F.col("head") == "HEADER"
    wrong = (F.col("class") == "OPTION") & (F.ascii(F.regexp_extract("text", PATTERNS["OPTION"], 1)) - 64 != F.col("nth"))
    bad = (
        F.when((F.col("block") == 0) & F.col("class").isin("OPTION", "LOWER", "OPTLIKE"), F.struct("line", F.lit(STRUCTURE).alias("code"), F.lit(SUMMARIES["outside"]).alias("summary")))
        .when((F.col("head") == "QLIKE") & (F.col("line") == F.col("head_line")), F.struct("line", F.when(F.regexp_extract("text", PATTERNS["QLIKE"], 1).rlike(r"^\[[^\]\r\n]*\]") & ~F.regexp_extract("text", PATTERNS["QLIKE"], 1).startswith("[single_choice]"), F.lit(UNSUPPORTED)).otherwise(F.lit(STRUCTURE)).alias("code"), F.when(F.regexp_extract("text", PATTERNS["QLIKE"], 1).rlike(r"^\[[^\]\r\n]*\]") & ~F.regexp_extract("text", PATTERNS["QLIKE"], 1).startswith("[single_choice]"), F.lit(SUMMARIES["type"])).otherwise(F.lit(SUMMARIES["header"])).alias("summary")))
        .when(in_header & (wrong | (F.col("class") == "LOWER")), F.struct(F.col("head_line").alias("line"), F.lit(STRUCTURE).alias("code"), F.lit(SUMMARIES["options"]).alias("summary")))
        .when(in_header & (F.col("class") == "OPTLIKE"), F.struct("line", F.lit(STRUCTURE).alias("code"), F.lit(SUMMARIES["malformed"]).alias("summary")))
        .when(in_header & F.col("class").isin("OTHER", "FENCE"), F.struct("line", F.lit(STRUCTURE).alias("code"), F.lit(SUMMARIES["unknown"]).alias("summary")))
    )
    return d.withColumn("bad", bad)


def strict_parse(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, findings, report) of strict question texts.

    A block runs from a header (or a line that only looks like one) to the next.  In a header's block the first bad line
    makes its finding; a block with 2 to 26 options labelled A, B, C... and no bad line is a question.  questions: key,
    display_number, stem, header_line, options array<struct<label, text, line>>.  findings: key, line, code, summary.
    report: key, accepted, rejected, question_like, n_findings, publishable.  Null texts are left out; an empty text has
    a report of zeros.  One shuffle by document.
    """
    # texts are shuffled, not their lines: all windows and groups below are by document
    lines = classified_lines(df.select(key, text).repartition(F.col(key)), key, text)
    d = _blocks(lines, key)
    opt = F.when(F.col("class") == "OPTION", F.struct(F.col("line").alias("line"), F.regexp_extract("text", PATTERNS["OPTION"], 1).alias("label"), F.regexp_extract("text", PATTERNS["OPTION"], 2).alias("text")))
    head = F.when(F.col("class") == "HEADER", F.struct(F.regexp_extract("text", PATTERNS["HEADER"], 1).alias("number"), F.regexp_extract("text", PATTERNS["HEADER"], 2).alias("stem")))
    blocks = d.groupBy(key, "block").agg(
        F.min("head").alias("head"), F.min("head_line").alias("header_line"), F.min_by("bad", F.when(F.col("bad").isNotNull(), d["line"])).alias("bad"), F.array_sort(F.collect_list(opt)).alias("options"), F.max(head).alias("h"),
        F.count_if((F.col("block") == 0) & F.col("bad").isNotNull()).alias("outside"), F.count_if("unclosed").alias("fences"),
    )
    few = (F.col("head") == "HEADER") & (F.size("options") < 2)
    blocks = blocks.withColumn("bad", F.coalesce("bad", F.when(few, F.struct(F.col("header_line").alias("line"), F.lit(STRUCTURE).alias("code"), F.lit(SUMMARIES["options"]).alias("summary")))))
    g = blocks.where("block > 0")
    questions = g.where(F.col("bad").isNull()).select(
        key, F.col("h.number").alias("display_number"), F.col("h.stem").alias("stem"), "header_line", F.transform("options", lambda o: F.struct(o["label"].alias("label"), o["text"].alias("text"), o["line"].alias("line"))).alias("options")
    )
    fence = lines.where("unclosed").select(key, "line", F.lit(STRUCTURE).alias("code"), F.lit(SUMMARIES["fence"]).alias("summary"))
    findings = (
        g.where(F.col("bad").isNotNull()).select(key, "bad.line", "bad.code", "bad.summary")
        .unionByName(d.where((F.col("block") == 0) & F.col("bad").isNotNull()).select(key, "bad.line", "bad.code", "bad.summary"))
        .unionByName(fence)
    )
    real, bad = F.col("block") > 0, F.col("bad").isNotNull()
    report = blocks.groupBy(key).agg(F.count_if(real & ~bad).alias("accepted"), F.count_if(real & bad).alias("rejected"), F.count_if(real).alias("question_like"), (F.count_if(real & bad) + F.sum("outside") + F.sum("fences")).alias("n_findings"))
    report = report.withColumn("publishable", (F.col("accepted") > 0) & (F.col("n_findings") == 0))
    return questions, findings, report


# What an issue of each code asks for, and the issue of a text without anything supported.
ISSUE_LEVELS = {STRUCTURE: ("review_required", ["correct source", "retain", "exclude"]), UNSUPPORTED: ("blocking", ["retain", "mark unsupported"])}
NOTHING_FOUND = "No supported single-choice questions were found."


def parse_issues(findings: DataFrame, report: DataFrame, key: str) -> DataFrame:
    """Open issues of a parse: every finding, and one at line 1 for a text with neither question nor finding.

    key, code, blocking_level, status, locator, summary, allowed_user_actions.
    """
    none = report.where("accepted = 0 AND n_findings = 0").select(key, F.lit(1).alias("line"), F.lit(STRUCTURE).alias("code"), F.lit(NOTHING_FOUND).alias("summary"))
    rows = findings.select(key, "line", "code", "summary").unionByName(none)
    pick = lambda i: F.coalesce(*[F.when(F.col("code") == c, F.lit(v[i]) if i == 0 else F.array(*map(F.lit, v[i]))) for c, v in ISSUE_LEVELS.items()])
    return rows.select(key, "code", pick(0).alias("blocking_level"), F.lit("open").alias("status"), F.concat(F.lit("line:"), F.col("line")).alias("locator"), "summary", pick(1).alias("allowed_user_actions"))
