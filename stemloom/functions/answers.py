"""Answer values: labels, true/false words, answer lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemloom.functions.text import strip

# The answer vocabulary.
LABELS = ("A", "B", "C", "D", "E")
TRUE_WORDS = ("true", "t", "正确", "对")
FALSE_WORDS = ("false", "f", "错误", "错")
JUDGMENTS = ("正确", "错误", "√", "×")
TYPE_NAMES = {"single_choice": "单选题", "multiple_choice": "多选题", "true_false": "判断题"}
MULTI_SEPARATORS = r"[ \t\r\n,;|/]"


def choice_label(c: Column) -> Column:
    """One label A-E, else null."""
    u = F.upper(strip(c))
    return F.when(u.isin(*LABELS), u)


def multiple_choice(c: Column) -> Column:
    """A label string with its labels once each, in order A-E; null where anything else stands in it."""
    s = F.upper(F.regexp_replace(c, MULTI_SEPARATORS, ""))
    ordered = F.concat(*[F.when(F.contains(s, F.lit(x)), F.lit(x)).otherwise(F.lit("")) for x in LABELS])
    return F.when(s.rlike(r"^[A-E]+\z"), ordered)


def multiple_choice_list(labels: Column) -> Column:
    """The same of an array of labels."""
    u = F.transform(labels, choice_label)
    ok = (F.size(u) > 0) & ~F.exists(u, lambda x: x.isNull())
    return F.when(ok, F.array_join(F.array_intersect(F.array(*map(F.lit, LABELS)), u), ""))


def true_false(c: Column) -> Column:
    """The word for right or wrong, else null."""
    s = F.lower(strip(c))
    return F.when(s.isin(*TRUE_WORDS), F.lit("正确")).when(s.isin(*FALSE_WORDS), F.lit("错误"))


def type_name(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in TYPE_NAMES.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def answer_labels(c: Column) -> Column:
    """The labels of an answer string: separators dropped, ASCII letters only, upper case; else an empty array."""
    s = F.regexp_replace(c, "[ \\t、,，;；/]", "")
    return F.when(s.rlike(r"^[A-Za-z]+\z"), F.split(F.upper(s), "")).otherwise(F.array().cast("array<string>"))
