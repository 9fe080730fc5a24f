"""Extracted questions checked and compiled to bank questions; records matched one to one and across rescans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemloom.functions.answers import LABELS
from stemloom.functions.text import stable_id, strip
from stemloom.operators.export import nearest, number_rows

TYPES = ("single_choice", "multiple_choice", "true_false")


def typed_answer(kind: Column, answer: Column) -> tuple[Column, Column, Column]:
    """A JSON answer as (label, labels, flag), each null unless the answer has its shape."""
    text = F.when(answer.rlike(r'^\s*"'), F.from_json(F.concat(F.lit('{"v":'), answer, F.lit("}")), "v string")["v"])
    many = F.when(answer.rlike(r"^\s*\["), F.from_json(answer, "array<string>"))
    flag = F.when(F.trim(answer) == "true", F.lit(True)).when(F.trim(answer) == "false", F.lit(False))
    return text, many, flag


def extraction_violations(df: DataFrame, key: str) -> DataFrame:
    """(record_id, rule) of extracted questions: unknown type, blank stem, option count or labels, answer shape, source."""
    label, labels, flag = typed_answer(F.col("question_type"), F.col("answer"))
    kind, opts = F.col("question_type"), F.coalesce("options", F.array().cast(df.schema["options"].dataType))
    names = F.transform(opts, lambda o: F.coalesce(o["label"], F.lit("")))
    blank = lambda c: F.coalesce(strip(c) == "", F.lit(True))
    answered = F.col("answer").isNotNull() & (F.trim("answer") != "null")
    rules = {
        "type": ~F.coalesce(kind.isin(*TYPES), F.lit(False)),
        "stem": blank(F.col("stem")),
        "option_count": F.when(kind == "true_false", F.size(opts) != 0).otherwise((F.size(opts) < 2) | (F.size(opts) > 5)),
        "option_labels": names != F.slice(F.array(*map(F.lit, LABELS)), F.lit(1), F.least(F.size(opts), F.lit(5))),
        "option_text": F.exists(opts, lambda o: blank(o["text"])),
        "answer": answered & ~F.coalesce(
            F.when(kind == "single_choice", F.array_contains(names, label)).when(kind == "true_false", flag.isNotNull())
            .when(kind == "multiple_choice", (F.size(labels) >= 2) & (F.size(F.array_distinct(labels)) == F.size(labels)) & (F.size(F.array_except(labels, names)) == 0)), F.lit(False)),
        "source": F.col("source_reference").isNull() | blank(F.col("source_reference.source_id")) | blank(F.col("source_reference.locator")),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return df.select(F.col(key).alias("record_id"), F.explode(found).alias("rule"))


def compile_questions(df: DataFrame, bank: str, position: str) -> DataFrame:
    """Bank questions of extracted ones: an id from (bank, position), revision 1, status candidate, notes in metadata."""
    label, labels, flag = typed_answer(F.col("question_type"), F.col("answer"))
    notes = F.when(F.col("extraction_notes").isNotNull(), F.create_map(F.lit("qbc_extraction_notes"), F.col("extraction_notes"))).otherwise(F.create_map().cast("map<string,string>"))
    qid = stable_id(F.col(bank), F.col(position).cast("string"), version="4")
    opts = F.transform("options", lambda o, i: F.struct(o["label"].alias("label"), o["text"].alias("text"), stable_id(F.col(bank), F.col(position).cast("string"), i.cast("string"), version="4").alias("source_option_id")))
    return df.select(
        qid.alias("question_id"), F.col(bank).alias("bank_id"), F.lit(1).alias("question_revision"), "question_type", "stem", opts.alias("options"), "source_reference", F.lit("candidate").alias("status"),
        "chapter", notes.alias("metadata"), label.alias("answer_label"), labels.alias("answer_labels"), flag.alias("answer_bool"), "explanation",
    )


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(matched keys, problems): keys that stand once on both sides; problems have keys and kind.

    kinds: left_repeated, right_repeated, left_only, right_only.  Sides are counted before they are joined, so a
    repeated key is one row of the join.
    """
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("na"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("nb"))
    j = a.join(b, keys, "full_outer")
    kinds = F.array_compact(F.array(F.when(F.col("na") > 1, F.lit("left_repeated")), F.when(F.col("nb") > 1, F.lit("right_repeated")), F.when(F.col("nb").isNull(), F.lit("left_only")), F.when(F.col("na").isNull(), F.lit("right_only"))))
    return j.where("na = 1 AND nb = 1").select(*keys), j.select(*keys, F.explode(kinds).alias("kind"))


def match_rescan(old: DataFrame, new: DataFrame, passes: list[list[str]], old_id: str, new_id: str) -> DataFrame:
    """Records of an earlier scan matched with a later one: (old_id, new_id, pass).

    In each pass the records still unmatched are joined on its columns, but only where their values are unique on both
    sides; passes go from the strictest evidence to the weakest.  Nothing is matched twice.
    """
    a, b, out = old, new, []
    for n, keys in enumerate(passes, 1):
        one_a = a.dropna(subset=keys).groupBy(*keys).agg(F.min(old_id).alias("_o"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
        one_b = b.dropna(subset=keys).groupBy(*keys).agg(F.min(new_id).alias("_w"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
        hit = one_a.join(one_b, keys).select(F.col("_o").alias("old_id"), F.col("_w").alias("new_id"), F.lit(n).alias("pass"))
        out.append(hit)
        a = a.join(hit.select(F.col("old_id").alias(old_id)), old_id, "left_anti")
        b = b.join(hit.select(F.col("new_id").alias(new_id)), new_id, "left_anti")
    return reduce(DataFrame.unionByName, out)


def match_by_order(old: DataFrame, new: DataFrame, matched: DataFrame, source: str, order: str, old_id: str, new_id: str) -> DataFrame:
    """Records that equal keys could not match, by their place between matched neighbours: (old_id, new_id, size).

    matched: (old_id, new_id) found so far.  The unmatched records between two neighbouring matched ones of a source (or
    its start or end) are a gap; where the gap between the same two has as many records on both sides, they are matched in
    order: size 1 by their neighbours alone, more by local order.  Order is by `order`, then id, nulls first.

    Neighbours and places come from range partitions of the whole tables, so a source of any size is spread over tasks.
    """
    ends = lambda d: d.select(F.col(source).alias("s")).distinct().select("s", F.explode(F.array(F.lit(0), F.lit(2))).alias("e"))

    def placed(d: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
        rows = d.select(F.col(source).alias("s"), F.lit(1).alias("e"), F.col(order).alias("o"), F.col(key).alias("id")).join(pairs, "id", "left")
        # the start and the end of a source match those of the same source
        mark = F.concat_ws("\u001f", F.lit("end"), "s", F.col("e").cast("string"))
        rows = rows.unionByName(ends(d).select("s", "e", F.lit(None).cast(d.schema[order].dataType).alias("o"), F.lit(None).cast("string").alias("id"), mark.alias("mate")))
        keys = ["s", "e", "o", "id"]
        rows = number_rows(rows.withColumns({"s": F.coalesce("s", F.lit(""))}), keys, "n").withColumn("anchor", F.when(F.col("mate").isNotNull(), F.struct("mate", "n")))
        rows = nearest(rows, ["n"], "anchor", "before", "after").where("mate IS NULL")
        return rows.select("id", F.col("before.mate").alias("b"), F.col("after.mate").alias("a"), (F.col("n") - F.col("before.n")).alias("place"), (F.col("after.n") - F.col("before.n") - 1).alias("size"))

    x = placed(old, old_id, matched.select(F.col("old_id").alias("id"), F.col("new_id").alias("mate")))
    y = placed(new, new_id, matched.select(F.col("new_id").alias("id"), F.col("new_id").alias("mate")))
    return x.withColumnRenamed("id", "old_id").join(y.withColumnRenamed("id", "new_id"), ["b", "a", "place", "size"]).select("old_id", "new_id", "size")


def option_order_violations(candidates: DataFrame) -> DataFrame:
    """Candidates whose options are not at positions 1, 2, 3... with labels A, B, C... in place."""
    o = F.col("options")
    wrong = F.exists(F.transform(o, lambda x, i: (x["current_position"] != i + 1) | (F.ascii(x["source_label"]) != i + 65)), lambda b: F.coalesce(b, F.lit(True)))
    return candidates.select("candidate_id", F.size(o).alias("n_options"), wrong.alias("out_of_order")).where("out_of_order").select("candidate_id", "n_options").distinct()


def latest(df: DataFrame, by: list[str], order: list[str], take: list[str]) -> DataFrame:
    """The row of each group that is greatest in `order`: one aggregation, no window."""
    best = F.max_by(F.struct(*take), F.struct(*order)).alias("x")
    return df.groupBy(*by).agg(best).select(*by, *[F.col("x")[c].alias(c) for c in take])


def extends(old: Column, new: Column) -> Column:
    """Whether an array only adds to the end of another."""
    return F.slice(new, F.lit(1), F.size(old)) == old


def lineage_closed(df: DataFrame, key: str, order: str, chain: str) -> DataFrame:
    """Rows whose `chain` array does not extend that of the row before with the same key."""
    before = F.lag(chain).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_b", before).where(F.col("_b").isNotNull() & ~extends(F.col("_b"), F.col(chain))).drop("_b")
