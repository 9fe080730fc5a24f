"""Projection of questions to the 11-column row, and grading of responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemloom.functions.answers import LABELS, choice_label, multiple_choice, multiple_choice_list, true_false, type_name
from stemloom.functions.text import strip
from stemloom.session import materialize

# The external header, in order.
HEADER = ("全局序号", "试卷/章节", "题型", "题干", "A", "B", "C", "D", "E", "正确答案", "解析")
FALLBACK_EXPLANATION = "暂无解析"


def option_columns(options: Column) -> list[Column]:
    """Option texts by label A-E, '' where absent (labels are trimmed and upper-cased; of a repeated label the first counts)."""
    pick = lambda x: F.filter(options, lambda o: F.upper(strip(o["label"])) == x)
    return [F.coalesce(F.get(pick(x), F.lit(0))["text"], F.lit("")).alias(f"option_{x.lower()}") for x in LABELS]


def bad_options(options: Column) -> Column:
    """True where a label is repeated or outside A-E."""
    labels = F.transform(options, lambda o: F.coalesce(F.upper(strip(o["label"])), F.lit("")))
    return F.exists(labels, lambda x: ~x.isin(*LABELS)) | (F.size(F.array_distinct(labels)) != F.size(labels))


def answer_text(kind: Column, label: Column, labels: Column, flag: Column) -> Column:
    """The external answer by question type; '' without an answer, null where it is not allowed for the type."""
    none = label.isNull() & labels.isNull() & flag.isNull()
    return (
        F.when(none, "").when(kind == "single_choice", choice_label(label))
        .when(kind == "multiple_choice", F.coalesce(multiple_choice_list(labels), multiple_choice(label)))
        .when(kind == "true_false", F.coalesce(F.when(flag, "正确").when(~flag, "错误"), true_false(label)))
    )


def csv_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """question_id, the ten text columns, and sequence_number (from 1, in the given order).

    Input: question_id, question_type, stem, options, chapter, explanation, answer_label, answer_labels, answer_bool.
    Rows whose type, labels or answer are not allowed are left out; `rejected_rows` lists them.  The sequence is made
    from counts per range partition and row numbers inside it, not by one task over all rows.
    """
    good = df.where(_allowed(df))
    rows = good.select(
        *dict.fromkeys([*order, "question_id"]), F.coalesce("chapter", F.lit("")).alias("paper_or_chapter"), type_name(F.col("question_type")).alias("question_type"), "stem",
        *option_columns(F.col("options")), answer_text(F.col("question_type"), F.col("answer_label"), F.col("answer_labels"), F.col("answer_bool")).alias("correct_answer"), F.coalesce("explanation", F.lit("")).alias("explanation"),
    )
    return number_rows(rows, order, "sequence_number")


def _allowed(df: DataFrame) -> Column:
    answer = answer_text(F.col("question_type"), F.col("answer_label"), F.col("answer_labels"), F.col("answer_bool"))
    return type_name(F.col("question_type")).isNotNull() & ~F.coalesce(bad_options(F.col("options")) | F.exists("options", lambda o: o["text"].isNull()), F.lit(False)) & answer.isNotNull()


def rejected_rows(df: DataFrame) -> DataFrame:
    """question_id, question_type and the first reason why a row has no place in the file: question_type, option_label,
    duplicate_option_label, option_text or answer."""
    labels = F.transform("options", lambda o: F.upper(strip(o["label"])))
    answer = answer_text(F.col("question_type"), F.col("answer_label"), F.col("answer_labels"), F.col("answer_bool"))
    reason = (
        F.when(type_name(F.col("question_type")).isNull(), "question_type").when(F.exists(labels, lambda x: ~F.coalesce(x.isin(*LABELS), F.lit(False))), "option_label")
        .when(F.size(F.array_distinct(labels)) != F.size(labels), "duplicate_option_label").when(F.exists("options", lambda o: o["text"].isNull()), "option_text").when(answer.isNull(), "answer")
    )
    return df.select("question_id", "question_type", reason.alias("reason")).where("reason IS NOT NULL")


def _ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows range-partitioned by `order`, written with the number of their partition in `_part`; partitions follow the order."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Global row numbers (bigint) in the given order without a single-task window.

    Rows are range-partitioned by `order`; the counts of the partitions (one small row each) give each its offset.
    """
    parts = _ranges(df, order)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    w = Window.partitionBy("_part").orderBy(*order)
    out = parts.withColumn("_row", F.row_number().over(w)).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_n", "_before", "_row")


def nearest(df: DataFrame, order: list[str], value: str, before: str, after: str) -> DataFrame:
    """The nearest non-null `value` before and after each row in a global order, again without a single-task window.

    Inside a range partition by windows; across partitions the last and first values of each (one small row a partition)
    are carried over.  `order` must not have ties.
    """
    parts = _ranges(df, order)
    w = Window.partitionBy("_part").orderBy(*order)
    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = parts.groupBy("_part").agg(F.max_by(value, place).alias("_last"), F.min_by(value, place).alias("_first"))
    every = Window.orderBy("_part")
    carried = ends.select(
        "_part", F.last("_last", True).over(every.rowsBetween(Window.unboundedPreceding, -1)).alias("_from"), F.first("_first", True).over(every.rowsBetween(1, Window.unboundedFollowing)).alias("_to")
    )
    out = parts.withColumns({"_b": F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_a": F.first(value, True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    out = out.join(F.broadcast(carried), "_part").withColumns({before: F.coalesce("_b", "_from"), after: F.coalesce("_a", "_to")})
    return out.drop("_part", "_b", "_a", "_from", "_to")


def grade(df: DataFrame, key_answer: str, response: str, kind: str) -> DataFrame:
    """Add is_correct: null without a key; multiple-choice answers compare as sets of labels."""
    as_set = lambda c: F.array_sort(F.array_distinct(F.split(F.upper(F.regexp_replace(c, r"[\s,;|/]", "")), "")))
    key, given = strip(F.coalesce(key_answer, F.lit(""))), strip(F.coalesce(response, F.lit("")))
    same = F.when(F.col(kind) == "多选题", as_set(key) == as_set(given)).otherwise(key == given)
    return df.withColumn("is_correct", F.when(key != "", same))


def score(graded: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """Graded, correct and wrong counts and the share of correct ones in percent (null where nothing was graded).

    With `weight`, a row counts as so many."""
    n = F.col(weight) if weight else F.lit(1)
    counted = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("bigint")
    g = graded.groupBy(*by).agg(counted(F.col("is_correct").isNotNull()).alias("graded"), counted(F.col("is_correct")).alias("correct"))
    return g.withColumn("wrong", F.col("graded") - F.col("correct")).withColumn("accuracy", F.round(F.try_divide(F.lit(100.0) * F.col("correct"), F.col("graded")), 4))


def with_fallback(df: DataFrame, explanation: str) -> DataFrame:
    return df.withColumn(explanation, F.when(strip(F.coalesce(explanation, F.lit(""))) == "", F.lit(FALLBACK_EXPLANATION)).otherwise(F.col(explanation)))
