"""Answer lines to evidence rows, and evidence associated with numbered questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemloom.functions.answers import JUDGMENTS, answer_labels
from stemloom.functions.text import WHITE, evidence_fingerprint, logical_lines, strip

# Patterns of answer lines.
STRICT_LINE = r"^[ \t]*([1-9][0-9]*)[ \t]*:[ \t]*([A-Z])[ \t]*\z"
NUMBERED = r"([1-9][0-9]*)[ \t]*([:.、）)])[ \t]*([A-Za-z]+(?:[、,，;；/][A-Za-z]+)*)"
ANSWER = rf"([^{WHITE}](?:(?d:.*)[^{WHITE}])?)[ \t]*\z"
INLINE = rf"(?i)^[ \t]*(?:答案|正确答案|参考答案|Ans)[ \t]*[:：]?[ \t]*{ANSWER}"
BRACKETED = rf"^[ \t]*【答案】[ \t]*{ANSWER}"


def _lines(df: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), *more, F.posexplode(logical_lines(F.col(text))).alias("p", "t"))
    names = [n for n in rows.columns if n not in ("k", "p", "t")]
    return rows.where(F.col("t").rlike(f"[^{WHITE}]")).select(F.col("k").alias(key), *names, (F.col("p") + 1).alias("line"), F.col("t").alias("text"))


def strict_answers(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(evidence, rejected): key, line, question_number, label, fingerprint of the sources all of whose non-blank lines
    are `number : LABEL`; and the keys of the others with their number of bad lines.  Null texts have no lines."""
    d = _lines(df, key, text).withColumn("label", F.nullif(F.regexp_extract("text", STRICT_LINE, 2), F.lit("")))
    d = d.withColumn("bad", F.count_if(F.col("label").isNull()).over(Window.partitionBy(key)))
    number = F.regexp_extract("text", STRICT_LINE, 1).cast("bigint")
    good = d.where("bad = 0").select(key, "line", number.alias("question_number"), "label", evidence_fingerprint(number, F.col("label")).alias("fingerprint"))
    return good, d.where("bad > 0").select(key, "bad").distinct()


def rich_answers(df: DataFrame, key: str, text: str, number: str | None = None, unique: str | None = None, adjacent: str | None = None, unresolved: str | None = None) -> DataFrame:
    """key, line, entry, kind, question_number, raw_answer, labels, confidence of every non-blank line; first rule wins.

    Two or more numbered entries and nothing else but separators: ANSWER_KEY_BLOCK, a row each; one: NUMBERED_ANSWER.
    Without an answer prefix: UNRESOLVED_ANSWER.  A judgment word: JUDGMENT_ANSWER; no labels: TEXT_ANSWER.  Labels
    belong to the current question (INLINE_CURRENT, medium) where the context says so: `number` names the column of its
    number, `unique` and `adjacent` those of two flags that must be true, `unresolved` that of one that must not be.  Else,
    and where no context is given, they wait for a question (UNRESOLVED_ANSWER, low).
    """
    flag = lambda c, absent: F.coalesce(F.col(c), F.lit(absent)) if c else F.lit(absent)
    here = F.when(flag(unique, False) & flag(adjacent, False) & ~flag(unresolved, False), F.col(number).cast("bigint")) if number else F.lit(None).cast("bigint")
    d = _lines(df, key, text, here.alias("_here"))
    rest = F.regexp_replace("text", NUMBERED, "")
    numbers, answers = (F.regexp_extract_all("text", F.lit(NUMBERED), F.lit(i)) for i in (1, 3))
    entries = F.when(rest.rlike(r"^[ \t;；,，]*\z"), F.arrays_zip(numbers.alias("number"), answers.alias("answer"))).otherwise(F.array().cast("array<struct<number:string,answer:string>>"))
    prefixed = F.coalesce(F.nullif(F.regexp_extract("text", INLINE, 1), F.lit("")), F.nullif(F.regexp_extract("text", BRACKETED, 1), F.lit("")))
    d = d.withColumns({"entries": entries, "inline": prefixed})
    none = F.array(F.struct(F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("answer")))
    d = d.select("*", F.posexplode(F.when(F.size("entries") > 0, F.col("entries")).otherwise(none)).alias("e", "x"))
    n = F.size("entries")
    raw = F.coalesce("x.answer", "inline", strip(F.col("text")))
    labels = F.when((n > 0) | F.col("inline").isNotNull(), answer_labels(raw)).otherwise(F.array().cast("array<string>"))
    d = d.withColumns({"raw_answer": raw, "labels": labels})
    kind = (
        F.when(n >= 2, "ANSWER_KEY_BLOCK").when(n == 1, "NUMBERED_ANSWER").when(F.col("inline").isNull(), "UNRESOLVED_ANSWER")
        .when(F.col("raw_answer").isin(*JUDGMENTS), "JUDGMENT_ANSWER").when(F.size("labels") == 0, "TEXT_ANSWER")
        .when(F.col("_here").isNotNull(), "INLINE_CURRENT").otherwise("UNRESOLVED_ANSWER")
    )
    d = d.withColumn("kind", kind)
    found = F.coalesce(F.col("x.number").cast("bigint"), F.when(F.col("kind") == "INLINE_CURRENT", F.col("_here")))
    confidence = F.when(n > 0, "high").when(F.col("kind") == "INLINE_CURRENT", "medium").when(F.col("kind").isin("JUDGMENT_ANSWER", "TEXT_ANSWER"), "runtime_only").otherwise("low")
    return d.select(key, "line", (F.col("e") + 1).alias("entry"), "kind", found.alias("question_number"), "raw_answer", F.when(F.col("kind") == "JUDGMENT_ANSWER", F.array().cast("array<string>")).otherwise(F.col("labels")).alias("labels"), confidence.alias("confidence"))


def _with_number(rows: DataFrame, per_number: DataFrame) -> DataFrame:
    """Rows with what is known of their (source_id, question_number); those without a number stay out of the join, which
    would bring a source's all to one task, and get nulls."""
    has = F.col("question_number").isNotNull()
    return rows.where(has).join(per_number, ["source_id", "question_number"], "left").unionByName(rows.where(~has), allowMissingColumns=True)


def associate(questions: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conclusions, leftover) of answers for numbered questions.

    questions: source_id, question_number, question_id, labels array<string>.  evidence: source_id, question_number,
    label, locator.  conclusions: one row a question, in this order: number null or not unique in its source ->
    low_confidence; no evidence -> missing; a label the question lacks, or two different ones -> conflict; else
    confirmable, with the label.  leftover: evidence numbers that no question of the source has, with their evidence
    count.  No vote, no recency.  Evidence is aggregated to one row a number before the join.
    """
    e = evidence.where(F.col("question_number").isNotNull()).groupBy("source_id", "question_number").agg(F.array_sort(F.collect_set("label")).alias("found"), F.count(F.lit(1)).alias("n_evidence"))
    # numbers are counted, not windowed: a source's questions without a number are never brought together
    numbered = questions.where(F.col("question_number").isNotNull()).groupBy("source_id", "question_number").agg(F.count(F.lit(1)).alias("same"))
    per_number = numbered.join(e, ["source_id", "question_number"], "left")
    j = _with_number(questions, per_number)
    unknown = F.size(F.array_except("found", "labels"))
    conclusion = (
        F.when(F.col("same").isNull() | (F.col("same") > 1), "low_confidence").when(F.col("found").isNull(), "missing")
        .when((unknown > 0) | (F.size("found") > 1), "conflict").otherwise("confirmable")
    )
    j = j.withColumn("conclusion", conclusion)
    conclusions = j.select("source_id", "question_id", "question_number", "conclusion", F.when(F.col("conclusion") == "confirmable", F.col("found")[0]).alias("label"), F.coalesce("n_evidence", F.lit(0)).cast("bigint").alias("n_evidence"))
    leftover = e.join(questions.select("source_id", "question_number").where("question_number IS NOT NULL").distinct(), ["source_id", "question_number"], "left_anti")
    return conclusions, leftover.select("source_id", "question_number", "n_evidence")


def alternatives(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Of conflicting questions: each label found, whether the question has it, and its evidence count."""
    c, _ = associate(questions, evidence)
    c = c.where("conclusion = 'conflict'").select("source_id", "question_id", "question_number")
    per = evidence.groupBy("source_id", "question_number", "label").agg(F.count(F.lit(1)).alias("n_evidence"))
    j = c.join(per, ["source_id", "question_number"]).join(questions.select("question_id", "labels"), "question_id")
    return j.select("question_id", "label", F.array_contains("labels", F.col("label")).alias("known"), "n_evidence")


def attachability(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rich evidence (source_id, question_number, labels, locator) with its status and reason; first rule wins."""
    n = questions.where("question_number IS NOT NULL").groupBy("source_id", "question_number").agg(F.count(F.lit(1)).alias("same"), F.first("labels").alias("known"))
    tuples = evidence.where("question_number IS NOT NULL").groupBy("source_id", "question_number").agg(F.min("labels").alias("lo"), F.max("labels").alias("hi"))
    j = _with_number(evidence, tuples.join(n, ["source_id", "question_number"], "left"))
    reason = (
        F.when(F.col("question_number").isNull(), "ANSWER_ATTACHMENT_UNCERTAIN").when(F.col("same").isNull(), "QUESTION_NUMBER_UNRESOLVED").when(F.col("same") > 1, "DUPLICATE_QUESTION_NUMBER")
        .when(F.col("lo") != F.col("hi"), "ANSWER_CONFLICT").when(F.size("labels") == 0, "RUNTIME_ONLY_ANSWER_KIND")
        .when(F.size(F.array_except("labels", "known")) > 0, "OPTION_LABEL_UNRESOLVED").when(F.size("labels") > 1, "MULTISELECT_NOT_ATTACHABLE")
    )
    j = j.withColumn("reason", reason)
    status = F.when(F.col("reason").isNull(), "ATTACHABLE").when(F.col("reason") == "ANSWER_CONFLICT", "CONFLICT").otherwise("UNRESOLVED")
    return j.select("source_id", "question_number", "locator", status.alias("status"), "reason", F.array_join("labels", "").alias("labels"))


def issue_keys(df: DataFrame, *columns: str) -> DataFrame:
    """A stable key: SHA-256 of the compact JSON of the columns in alphabetical order, nulls written."""
    ordered = F.struct(*[F.col(c).alias(c) for c in sorted(columns)])
    return df.withColumn("issue_key", F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256))
