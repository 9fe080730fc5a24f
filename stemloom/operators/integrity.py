"""Constraint checks: every broken rule becomes a row (code, record_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemloom.functions.text import is_sha256, is_uuid
from stemloom.session import materialize


def _broken(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(code, record_id) of every rule that a row breaks: one pass, no shuffle."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules.items()]))
    return df.select(F.explode(found).alias("code"), F.col(key).alias("record_id"))


def bundle_violations(sources: DataFrame, candidates: DataFrame, reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """(code, record_id) of the cross-object rules of candidates, options, reviews, decisions and their evidence.

    The candidates are made distinct once; rules of one table, or of one join, are checked together in one pass.  Repeated
    rows are one record; null references break no existence rule.
    """
    here = F.lit(True)
    src = sources.select("source_id", "revision").distinct()
    known = src.select("source_id").distinct().withColumn("known", here)
    cand = materialize(candidates.select("candidate_id", "candidate_revision", "source_id", "question_type", "status").distinct())
    opts = materialize(candidates.select("candidate_id", F.explode("options").alias("o")).select("candidate_id", F.col("o.option_id").alias("option_id"), F.col("o.candidate_id").alias("owner"), F.col("o.source_ref.source_id").alias("source_id")).distinct())
    dec = decisions.select("decision_id", "candidate_id", "candidate_revision", "decision_type", "value", "evidence", "status").distinct()
    rev = reviews.select("review_id", "candidate_id").distinct()
    # the candidates of one id: their number and, for the references, that there are any
    ids = cand.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"))
    owners = opts.groupBy("option_id").agg(F.max("candidate_id").alias("owner"), (F.min("candidate_id") != F.max("candidate_id")).alias("shared"))
    lost = F.col("known").isNull() & F.col("source_id").isNotNull()
    out = [
        _broken(ids, "candidate_id", {"QB-CANDIDATE-ID-DUPLICATE": F.col("n") > 1}),
        _broken(cand.join(known, "source_id", "left"), "candidate_id", {"QB-SOURCE-REFERENCE-MISSING": lost}),
        _broken(opts.join(known, "source_id", "left"), "option_id", {"QB-SOURCE-REFERENCE-MISSING": lost, "QB-OPTION-OWNERSHIP-INVALID": F.col("owner") != F.col("candidate_id")}),
        _broken(owners, "option_id", {"QB-OPTION-ID-DUPLICATE": F.col("shared")}),
        _broken(rev.join(ids, "candidate_id", "left"), "review_id", {"QB-CANDIDATE-REFERENCE-MISSING": F.col("n").isNull() & F.col("candidate_id").isNotNull()}),
    ]
    j = materialize(dec.join(cand.select("candidate_id", F.col("candidate_revision").alias("now"), "question_type", here.alias("there")), "candidate_id", "left"))
    resolved, judged, found = F.col("value.resolved_option_ids"), F.col("question_type") == "true_false", F.col("there").isNotNull()
    answer = found & (F.col("decision_type") == "answer_resolution")
    one, many = F.col("question_type") == "single_choice", F.col("question_type") == "multiple_choice"
    out.append(_broken(j, "decision_id", {
        "QB-CANDIDATE-REFERENCE-MISSING": ~found & F.col("candidate_id").isNotNull(), "QB-DECISION-REVISION-STALE": found & (F.col("candidate_revision") != F.col("now")),
        "QB-TRUE-FALSE-VALUE-INVALID": answer & judged & (F.col("value.boolean_value").isNull() | F.col("value.source_lexeme").isNull()), "QB-ANSWER-SHAPE-INVALID": answer & ~judged & resolved.isNull(),
        "QB-ANSWER-CARDINALITY-INVALID": answer & resolved.isNotNull() & ((one & (F.size(resolved) != 1)) | (many & ((F.size(resolved) < 2) | (F.size(F.array_distinct(resolved)) != F.size(resolved))))),
    }))
    ev = j.where(found).select("decision_id", F.explode("evidence").alias("e")).select("decision_id", "e.source_id", "e.source_revision").distinct().join(src, "source_id", "left")
    out.append(_broken(ev, "decision_id", {"QB-EVIDENCE-REFERENCE-MISSING": F.col("revision").isNull(), "QB-EVIDENCE-REVISION-INVALID": F.col("source_revision") > F.col("revision")}).distinct())
    picks = j.where(answer & ~judged).select("decision_id", "candidate_id", F.explode(resolved).alias("option_id")).distinct().join(owners, "option_id", "left")
    out.append(_broken(picks, "decision_id", {"QB-OPTION-REFERENCE-MISSING": F.col("owner").isNull(), "QB-OPTION-OWNERSHIP-INVALID": F.col("owner") != F.col("candidate_id")}).distinct())
    valid = j.where(answer & (F.col("status") == "valid") & (F.col("candidate_revision") == F.col("now"))).select("candidate_id").distinct().withColumn("valid", here)
    out.append(_broken(cand.where("status = 'validated'").join(valid, "candidate_id", "left"), "candidate_id", {"QB-VALIDATED-GATE-FAILED": F.col("valid").isNull()}))
    return reduce(DataFrame.unionByName, out)


def shape_violations(df: DataFrame, key: str, uuids: list[str] = (), hashes: list[str] = (), filled: list[str] = ()) -> DataFrame:
    """(code, record_id, field) of id, hash and non-empty fields that are malformed; one scan, no shuffle."""
    checks = [F.when(F.col(c).isNotNull() & ~is_uuid(F.col(c)), F.struct(F.lit("QB-CONTRACT-UUID").alias("code"), F.lit(c).alias("field"))) for c in uuids]
    checks += [F.when(F.col(c).isNotNull() & ~is_sha256(F.col(c)), F.struct(F.lit("QB-CONTRACT-HASH").alias("code"), F.lit(c).alias("field"))) for c in hashes]
    checks += [F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.struct(F.lit("QB-CONTRACT-STRING").alias("code"), F.lit(c).alias("field"))) for c in filled]
    return df.select(F.col(key).alias("record_id"), F.explode(F.array_compact(F.array(*checks))).alias("x")).select("x.code", "record_id", "x.field")


def unknown_fields(df: DataFrame, key: str, body: str, allowed: list[str]) -> DataFrame:
    """(record_id, field) of top-level JSON members outside the allowed set; invalid JSON gives no row."""
    extra = F.array_except(F.json_object_keys(body), F.array(*map(F.lit, allowed)))
    return df.select(F.col(key).alias("record_id"), F.explode(extra).alias("field"))


def assert_none(violations: DataFrame) -> None:
    """Fail closed: raise with a few rows if there is any violation."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"violations, for example {[tuple(r) for r in found]}")
