"""Shapes of documents as rules on columns; records matched by option, merged by source, found or created by key."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemloom.functions.text import is_sha256, is_uuid

# The enumerations of the documents, and the codes of their faults.
QUESTION_TYPES = ("single_choice", "multiple_choice", "true_false", "unsupported", "ambiguous")
CANDIDATE_STATES = ("candidate", "validated", "unsupported", "ambiguous", "archived")
DECISION_STATES = ("valid", "needs_revalidation", "archived")
DECISION_TYPES = ("answer_resolution", "duplicate_relation", "association")
SOURCE_KINDS = ("question_document", "answer_document", "unrelated", "duplicate_version")
BLOCKING_LEVELS = ("blocking", "review_required", "informational")
REVIEW_STATES = ("open", "resolved", "archived")
ISSUE_CODES = (
    "QB-SOURCE-UNSUPPORTED", "QB-SOURCE-READ-FAILED", "QB-ROLE-AMBIGUOUS", "QB-TYPE-UNSUPPORTED", "QB-STRUCTURE-AMBIGUOUS", "QB-ANSWER-MISSING", "QB-ANSWER-CONFLICT", "QB-ASSOCIATION-LOW-CONFIDENCE", "QB-DUPLICATE-CANDIDATE",
    "QB-IDENTITY-AMBIGUOUS", "QB-OPTION-IDENTITY-AMBIGUOUS", "QB-DECISION-STALE", "QB-FORMAT-LOSS", "QB-SECURITY-INSTRUCTION-DATA", "QB-REMOTE-CAPABILITY-NOT-AUTHORIZED",
)
PATTERN, TYPE, CARDINALITY, ENUM = (f"QB-CONTRACT-{x}" for x in ("PATTERN", "TYPE", "CARDINALITY", "ENUM"))

#: A rule gives the code of a value's fault, null for a good value.
Rule = Callable[[Column], Column]


def uuid(c: Column) -> Column:
    return F.when(~F.coalesce(is_uuid(c), F.lit(False)), PATTERN)


def digest(c: Column) -> Column:
    return F.when(~F.coalesce(is_sha256(c), F.lit(False)), PATTERN)


def positive(c: Column) -> Column:
    return F.when(c.isNull(), TYPE).when(c < 1, CARDINALITY)


def filled(c: Column) -> Column:
    return F.when(c.isNull(), TYPE).when(c == "", CARDINALITY)


def present(c: Column) -> Column:
    return F.when(c.isNull(), TYPE)


def some(c: Column) -> Column:
    """An array that is there and not empty."""
    return F.when(F.coalesce(F.size(c), F.lit(-1)) <= 0, CARDINALITY)


def one_of(*values: str) -> Rule:
    return lambda c: F.when(~F.coalesce(c.isin(*values), F.lit(False)), ENUM)


def optional(rule: Rule) -> Rule:
    return lambda c: F.when(c.isNotNull(), rule(c))


CANDIDATE = {
    "candidate_id": uuid, "candidate_revision": positive, "source_id": uuid, "locator": filled, "stem": filled, "question_type": one_of(*QUESTION_TYPES), "status": one_of(*CANDIDATE_STATES), "fingerprints.stem_fingerprint": digest,
    "fingerprints.option_set_fingerprint": digest, "fingerprints.content_revision_fingerprint": digest, "duplicate_group": optional(filled), "options": present,
}
OPTION = {"option_id": uuid, "candidate_id": uuid, "option_revision": positive, "normalized_text_fingerprint": digest, "current_position": positive, "source_label": filled, "source_ref.source_id": uuid, "source_ref.locator": filled, "previous_labels": present}
SOURCE = {"source_id": uuid, "kind": one_of(*SOURCE_KINDS), "current_relative_path": filled, "current_content_hash": digest, "revision": positive, "path_history": some}
REVIEW = {"review_id": uuid, "issue_code": one_of(*ISSUE_CODES), "blocking_level": one_of(*BLOCKING_LEVELS), "status": one_of(*REVIEW_STATES), "allowed_user_actions": some, "candidate_id": optional(uuid)}
DECISION = {"decision_id": uuid, "candidate_id": uuid, "candidate_revision": positive, "decision_type": one_of(*DECISION_TYPES), "value": present, "evidence": some, "status": one_of(*DECISION_STATES)}
BINDING = {"source_id": uuid, "source_revision": positive, "locator": filled, "evidence_fingerprint": digest}


def _faults(of: Callable[[str], Column], rules: dict[str, Rule], path: Callable[[str], Column]) -> Column:
    one = [F.struct(rule(of(f)).alias("code"), path(f).alias("path")) for f, rule in rules.items()]
    return F.filter(F.array(*one), lambda x: x["code"].isNotNull())


def contract_violations(df: DataFrame, key: str, rules: dict[str, Rule], nested: dict[str, dict[str, Rule]] | None = None) -> DataFrame:
    """(code, record_id, path) of the fields that break a rule, those of the elements of nested arrays too; one pass, no shuffle.

    A null is a fault unless the rule is optional.  Repeated rows give repeated faults; an empty table gives none.
    """
    found = [_faults(lambda f: F.col(f), rules, lambda f: F.lit(f))]

    def below(array: str, inner: dict[str, Rule]) -> Column:
        def of_element(x: Column, i: Column) -> Column:
            get = lambda f: reduce(lambda c, part: c[part], f.split("."), x)
            return _faults(get, inner, lambda f: F.concat(F.lit(f"{array}["), i.cast("string"), F.lit(f"].{f}")))

        return F.coalesce(F.flatten(F.transform(F.col(array), of_element)), F.array().cast("array<struct<code:string,path:string>>"))

    found += [below(a, inner) for a, inner in (nested or {}).items()]
    return df.select(F.col(key).alias("record_id"), F.explode(F.concat(*found)).alias("x")).select("x.code", "record_id", "x.path")


def option_pairing(candidates: DataFrame, bank: DataFrame) -> DataFrame:
    """Options of candidates and of their bank questions that do not agree: question_id, label, position, fault.

    Options pair by question, label and position.  Faults: 'candidate_only', 'bank_only', 'option_id' (the bank's
    source_option_id is another).  Only questions that stand on both sides are compared.  One join, on three columns.
    """
    a = candidates.select(F.col("candidate_id").alias("question_id"), F.explode("options").alias("o")).select("question_id", F.col("o.source_label").alias("label"), F.col("o.current_position").alias("position"), F.col("o.option_id").alias("a_id"), F.lit(True).alias("a"))
    b = bank.select("question_id", F.posexplode("options").alias("p", "o")).select("question_id", F.col("o.label").alias("label"), (F.col("p") + 1).alias("position"), F.col("o.source_option_id").alias("b_id"), F.lit(True).alias("b"))
    both = candidates.select(F.col("candidate_id").alias("question_id")).distinct().join(bank.select("question_id").distinct(), "question_id")
    j = a.distinct().join(b.distinct(), ["question_id", "label", "position"], "full_outer")
    fault = F.when(F.col("b").isNull(), "candidate_only").when(F.col("a").isNull(), "bank_only").when(~F.col("a_id").eqNullSafe(F.col("b_id")), "option_id")
    return j.withColumn("fault", fault).where("fault IS NOT NULL").join(both, "question_id", "left_semi").select("question_id", "label", "position", "fault")


def answer_options(conclusions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Confirmable conclusions (question_id, label) with the id of the option of that label, null where there is none."""
    o = candidates.select(F.col("candidate_id").alias("question_id"), F.explode("options").alias("o")).select("question_id", F.col("o.source_label").alias("label"), F.col("o.option_id").alias("option_id")).distinct()
    return conclusions.where("conclusion = 'confirmable'").select("question_id", "label").distinct().join(o, ["question_id", "label"], "left").select("question_id", "label", "option_id")


def merge_manifest(parent: DataFrame, explicit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifest, faults): the parent's sources overlaid by explicit ones.

    Both have source_id, kind, path, history, hash, revision.  Faults (source_id, fault) of explicit rows: 'kind' (another than
    the parent's), 'revision' (lower), 'history' (does not extend the parent's), 'path' (not the last of its history).
    Rows with a fault leave the parent's row as it was.
    """
    fields = ["kind", "path", "history", "hash", "revision"]
    a = parent.select("source_id", F.struct(*fields).alias("p"))
    b = explicit.select("source_id", F.struct(*fields).alias("e"))
    j = a.join(b, "source_id", "full_outer")
    both = F.col("p").isNotNull() & F.col("e").isNotNull()
    old, new = F.col("p.history"), F.col("e.history")
    fault = (
        F.when(both & (F.col("p.kind") != F.col("e.kind")), "kind").when(both & (F.col("e.revision") < F.col("p.revision")), "revision")
        .when(both & ~F.slice(new, F.lit(1), F.size(old)).eqNullSafe(old), "history").when(F.col("e").isNotNull() & ~F.try_element_at(new, F.lit(-1)).eqNullSafe(F.col("e.path")), "path")
    )
    j = j.withColumn("fault", fault)
    kept = F.when(F.col("fault").isNull(), F.coalesce("e", "p")).otherwise(F.col("p"))
    return j.select("source_id", kept.alias("x")).where("x IS NOT NULL").select("source_id", "x.*"), j.where("fault IS NOT NULL").select("source_id", "fault")


def find_or_create(reviews: DataFrame, wanted: DataFrame, key: list[str], order: list[str], review: str = "review_id") -> DataFrame:
    """For each wanted issue key what is to be done: key columns, action, review_id, supersedes.

    'reuse' the one open review of the key; 'ambiguous' where several are open; else 'create' one that supersedes the
    latest closed review, if there is any.  Reviews are aggregated to one row a key before the join.
    """
    place = F.struct(*order, review)
    open_, closed = F.col("status") == "open", F.col("status").isin("resolved", "archived")
    per = reviews.groupBy(*key).agg(F.count_if(open_).alias("n_open"), F.max(F.when(open_, F.col(review))).alias("one"), F.max_by(review, F.when(closed, place)).alias("last"))
    j = wanted.select(*key).distinct().join(per, key, "left")
    n = F.coalesce("n_open", F.lit(0))
    action = F.when(n == 1, "reuse").when(n > 1, "ambiguous").otherwise("create")
    return j.select(*key, action.alias("action"), F.when(n == 1, F.col("one")).alias(review), F.when(n == 0, F.col("last")).alias("supersedes"))


def current_valid(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Valid answer decisions of the revision that their candidate has now."""
    now = candidates.select("candidate_id", "candidate_revision").distinct()
    return decisions.where("decision_type = 'answer_resolution' AND status = 'valid'").join(now, ["candidate_id", "candidate_revision"], "left_semi")
