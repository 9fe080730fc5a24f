"""Documents as line rows: normalisation, question boundaries, option markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemloom.functions.text import WHITE, ZERO_WIDTH, logical_lines, strip

# Patterns and titles of the line grammar.
NUMBER_MARKER = r"^[ \t]*(?:(\(([1-9][0-9]*)\)|（([1-9][0-9]*)）)|([1-9][0-9]*)([.)、．]))[ \t]*((?s:.*))\z"
CHINESE_MARKER = r"^[ \t]*([一二三四五六七八九十])、[ \t]*((?s:.*))\z"
OPTION_LINE = rf"^[ \t]*[-*+]?[ \t]*([A-Z])[.)、．][ \t]+[^{WHITE}](?s:.*[^{WHITE}])?[ \t]*\z"
HEADING = r"^第[一二三四五六七八九十0-9]+[章节]"
HEADING_TITLES = ("单项选择题", "多项选择题", "课程名称")
FALSE_NUMBERS = (
    r"^[0-9]{4}[.．][0-9]{1,2}[.．][0-9]{1,2}(?:\P{Nd}|\z)",
    r"(?i)^[0-9]+[.．][0-9]+(?:[ \t]*(?:mg|g/L|mmHg|℃|cm|mm|ml))?(?:\P{Nd}|\z)",
    rf"(?i)^(?:患者?体温[{WHITE}]*[0-9]+[.．]?[0-9]*℃|(?:Hb|PaO2)[{WHITE}]*[0-9]+(?:[ \t]*(?:g/L|mmHg))?)\z",
    r"^第[0-9]+[、,][0-9]+肋间",
    rf"^(?:第[{WHITE}]*)?[0-9]+[{WHITE}]*页\z|^页[{WHITE}]*[0-9]+\z",
)
TYPE_MARKER = "[single_choice]"
MARKER = r"(?:\([A-Za-z]\)|（[A-Za-z]）|[A-Za-z][.、．)：])"
LETTER_GROUP = "^[ \\t]*[A-Za-z]、[A-Za-z](?:两组|组)"


def document_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), raw_text, normalized_text and the number of changes of each kind.

    Line endings become LF, a leading byte-order mark and zero-width characters go, any other white space becomes one
    blank each.  A null text has no lines; an empty one has one empty line; repeated rows give repeated lines.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(logical_lines(F.col(text))).alias("p", "raw_text"))
    raw = F.col("raw_text")
    bom = (F.col("p") == 0) & raw.startswith("\ufeff")
    zero = F.length(raw) - F.length(F.regexp_replace(raw, f"[{ZERO_WIDTH}]", ""))
    normal = F.regexp_replace(F.regexp_replace(raw, f"[{ZERO_WIDTH}]", ""), f"[{WHITE}]", " ")
    # blanks (U+0020) are no change
    other = F.regexp_count(raw, F.lit(f"[{WHITE}&&[^ ]]"))
    return rows.select(
        F.col("key").alias(key), (F.col("p") + 1).alias("line"), "raw_text", normal.alias("normalized_text"),
        bom.cast("int").alias("bom_removed"), (zero - bom.cast("int")).alias("zero_width_removed"), other.alias("whitespace_replaced"),
    )


def numeric_false_positive(c: Column) -> Column:
    s = strip(c)
    hit = F.lit(False)
    for p in FALSE_NUMBERS:
        hit = hit | s.rlike(p)
    return hit


def section_heading(c: Column) -> Column:
    s = strip(c)
    return s.rlike(HEADING) | s.isin(*HEADING_TITLES)


def boundaries(lines: DataFrame, key: str, text: str = "normalized_text") -> DataFrame:
    """Each line with its boundary strength (STRONG, MEDIUM, WEAK, NONE), number, marker, preview, warning and signals.

    Signals about the question before a line come from running windows over the document's lines.  One shuffle by
    document; a window's state is one document's lines.
    """
    t = F.col(text)
    group = lambda i: F.regexp_extract(t, NUMBER_MARKER, i)
    is_number, is_chinese = t.rlike(NUMBER_MARKER), t.rlike(CHINESE_MARKER)
    d = lines.withColumns({"heading": section_heading(t), "false_number": numeric_false_positive(t), "is_number": is_number, "has_marker": is_number | is_chinese})
    d = d.withColumns({
        "number": F.when(F.col("is_number"), F.coalesce(*[F.nullif(group(i), F.lit("")) for i in (2, 3, 4)]).cast("bigint")),
        "marker": F.when(F.col("is_number"), F.coalesce(F.nullif(group(1), F.lit("")), F.concat(group(4), group(5)))).when(F.col("has_marker"), F.concat(F.regexp_extract(t, CHINESE_MARKER, 1), F.lit("、"))),
        "stem0": F.when(F.col("is_number"), group(6)).when(F.col("has_marker"), F.regexp_extract(t, CHINESE_MARKER, 2)),
    })
    stem0 = strip(F.col("stem0"))
    typed = stem0.startswith(TYPE_MARKER)
    d = d.withColumns({"typed": typed, "stem": strip(F.when(typed, F.substring(stem0, F.lit(len(TYPE_MARKER) + 1), F.length(stem0))).otherwise(stem0))})
    plausible = (F.length("stem") >= 4) & ~numeric_false_positive(F.col("stem")) & F.col("stem").rlike(r"[^\p{Nd}]")
    d = d.withColumn("plausible", plausible)
    strength = (
        F.when(F.col("heading") | F.col("false_number") | ~F.col("has_marker"), F.lit("NONE"))
        .when(F.col("stem") == "", F.lit("WEAK"))
        .when(F.col("plausible") & (F.col("typed") | F.col("marker").startswith("(")), F.lit("STRONG"))
        .when(F.col("plausible"), F.lit("MEDIUM"))
        .otherwise(F.lit("WEAK"))
    )
    d = d.withColumn("strength", strength).withColumn("is_boundary", F.col("strength").isin("STRONG", "MEDIUM"))
    w = Window.partitionBy(key).orderBy("line")
    d = d.withColumn("block", F.sum(F.col("is_boundary").cast("int")).over(w))
    before = F.coalesce(F.sum(F.col("is_boundary").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    label = F.nullif(F.regexp_extract(t, OPTION_LINE, 1), F.lit(""))
    # state of the question that a line follows: its block is the one of the line before
    d = d.withColumns({"before": before, "label": label})
    own = Window.partitionBy(key, "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    n_own = F.size(F.collect_set(F.when(F.col("block") > 0, F.col("label"))).over(own))
    whole = F.size(F.collect_set(F.when(F.col("block") > 0, F.col("label"))).over(Window.partitionBy(key, "block")))
    d = d.withColumns({"n_own": n_own, "n_whole": whole})
    prev_whole = F.lag("n_whole").over(w)
    d = d.withColumn("n_labels", F.when(F.col("is_boundary"), F.when(F.col("before") > 0, prev_whole).otherwise(0)).otherwise(F.col("n_own")))
    shown = ~F.col("heading") & ~F.col("false_number") & F.col("has_marker")
    warning = F.when(F.col("heading"), "section_heading").when(F.col("false_number"), "numeric_false_positive").when(shown & (F.col("stem") == ""), "incomplete_marker")
    return d.select(
        key, "line", "strength", "is_boundary", F.when(shown, F.col("number")).alias("question_number"), F.when(shown, F.col("marker")).alias("question_marker"),
        F.when(shown, F.nullif(F.substring("stem", 1, 80), F.lit(""))).alias("stem_preview"), warning.alias("warning"), F.col("has_marker").alias("number_marker"),
        (F.coalesce("n_labels", F.lit(0)) >= 2).alias("previous_complete"), (F.coalesce("n_labels", F.lit(0)) >= 1).alias("option_state"), F.when(shown, F.col("plausible")).alias("plausible_stem"), text,
        *(["raw_text"] if "raw_text" in lines.columns and text != "raw_text" else []),
    )


def _marked(bounded: DataFrame, key: str, text: str) -> DataFrame:
    """The lines under question boundaries as rows: markers with their text, continuation lines (marker null), letter groups.

    `ordinal` numbers the options of the document; rows that are no option have that of the option before them.
    """
    w = Window.partitionBy(key).orderBy("line")
    raw = F.col("raw_text" if "raw_text" in bounded.columns else text)
    d = bounded.withColumn("active", F.max(F.col("is_boundary").cast("int")).over(w)).where("active = 1 AND NOT is_boundary")
    t = F.col(text)
    lead = rf"^[ \t]*(?:[-*+][ \t]*)?({MARKER}(?s:.*))\z"
    d = d.withColumns({"group_line": t.rlike(LETTER_GROUP), "body": F.nullif(F.regexp_extract(t, lead, 1), F.lit(""))})
    inline = rf"(?<![^{WHITE}]){MARKER}"
    marks, texts = F.regexp_extract_all("body", F.lit(f"({inline})"), F.lit(1)), F.split("body", inline, -1)
    one = F.array(F.struct(F.lit(None).cast("string").alias("m"), raw.alias("x")))
    zipped = F.when(F.col("group_line") | F.col("body").isNull(), one).otherwise(F.arrays_zip(marks.alias("m"), F.slice(texts, F.lit(2), F.size(marks)).alias("x")))
    rows = d.where(F.col("group_line") | F.col("body").isNotNull() | (strip(t) != "")).select(key, "line", "group_line", F.posexplode(zipped).alias("at", "z"))
    rows = rows.select(key, "line", "group_line", "at", F.col("z.m").alias("marker"), strip(F.col("z.x")).alias("found"))
    last = F.substring("marker", -1, 1)
    style = (
        F.when(F.col("marker").startswith("("), "parenthesized").when(F.col("marker").startswith("（"), "fullwidth_parenthesized")
        .when(last == ".", "dot").when(last == "、", "ideographic_comma").when(last == "．", "fullwidth_dot").when(last == ")", "close_parenthesis").when(last == "：", "fullwidth_colon")
    )
    rows = rows.withColumns({"label": F.upper(F.regexp_extract("marker", "([A-Za-z])", 1)), "style": style, "is_option": F.col("marker").isNotNull() & (F.col("found") != "")})
    lower = F.when(F.col("marker").rlike("^[a-z]"), F.lit("LOWERCASE_LABEL_NORMALIZED"))
    empty = F.when(F.col("found") == "", F.lit("INCOMPLETE_OPTION_MARKER"))
    rows = rows.withColumn("own_warnings", F.when(F.col("marker").isNotNull(), F.array_compact(F.array(lower, empty))))
    return rows.withColumn("ordinal", F.sum(F.col("is_option").cast("int")).over(Window.partitionBy(key).orderBy("line", "at")))


def marker_evidence(bounded: DataFrame, key: str, text: str = "normalized_text") -> DataFrame:
    """Every option marker, those without a text too: key, line, marker, label, style, confidence, warnings."""
    m = _marked(bounded, key, text).where(F.col("marker").isNotNull())
    return m.select(key, "line", "at", "marker", "label", "style", F.when(F.col("found") == "", "low").otherwise("high").alias("confidence"), F.col("own_warnings").alias("warnings"))


def option_markers(bounded: DataFrame, key: str, text: str = "normalized_text") -> DataFrame:
    """Options found under question boundaries: key, line, ordinal, label, marker, style, option_text, continuation_lines, warnings.

    Lines before the first boundary and boundary lines yield none; text after a marker runs to the next marker of the
    line; non-blank lines without a marker are added to the option before them, as they stand (raw_text, where the table
    has it).  Labels are checked over the whole document: repeated, or not the one after the greatest so far.  The widest
    group is one document.
    """
    rows = _marked(bounded, key, text).where("ordinal > 0 AND NOT group_line")
    option = F.max(F.when(F.col("is_option"), F.struct("line", "label", "marker", "style", "found", "own_warnings"))).alias("o")
    more = F.array_sort(F.collect_list(F.when(F.col("marker").isNull(), F.struct("line", "found")))).alias("more")
    g = rows.groupBy(key, "ordinal").agg(option, more).select(key, "ordinal", "o.*", "more")
    by = Window.partitionBy(key).orderBy("ordinal")
    top = F.max(F.ascii("label")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    seen = F.row_number().over(Window.partitionBy(key, "label").orderBy("ordinal")) > 1
    g = g.withColumns({"seen": seen, "gap": ~seen & (F.ascii("label") != F.coalesce(top + 1, F.lit(65)))})
    place = F.when(F.col("seen"), F.lit("DUPLICATE_OPTION_LABEL")).when(F.col("gap"), F.lit("OPTION_SEQUENCE_GAP"))
    return g.select(
        key, "line", "ordinal", "label", "marker", "style", F.array_join(F.concat(F.array("found"), F.col("more.found")), "\n").alias("option_text"), F.col("more.line").alias("continuation_lines"),
        F.array_compact(F.concat("own_warnings", F.array(place))).alias("warnings"),
    )


def option_report(bounded: DataFrame, key: str, text: str = "normalized_text") -> DataFrame:
    """Per document with any line under a boundary: n_options, confidence (none, medium with a warning, else high), warnings in order of name."""
    rows = _marked(bounded, key, text)
    group = F.when(F.col("group_line"), F.array(F.lit("LETTER_GROUP_NOT_OPTION")))
    of_lines = rows.select(key, F.col("is_option").cast("int").alias("n"), F.coalesce(group, F.array_intersect("own_warnings", F.array(F.lit("INCOMPLETE_OPTION_MARKER"))), F.array().cast("array<string>")).alias("ws"))
    of_options = option_markers(bounded, key, text).select(key, F.lit(0).alias("n"), F.array_except("warnings", F.array(F.lit("LOWERCASE_LABEL_NORMALIZED"))).alias("ws"))
    both = of_lines.unionByName(of_options).groupBy(key).agg(F.sum("n").alias("n_options"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ws")))).alias("warnings"))
    return both.select(key, "n_options", F.when(F.col("n_options") == 0, "none").when(F.size("warnings") > 0, "medium").otherwise("high").alias("confidence"), "warnings")
