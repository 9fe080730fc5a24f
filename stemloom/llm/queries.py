"""Queries of the text operators (problems 1 and 5 to 9) over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemloom.llm.bpe import count_tokens, decode_ids, encode_texts
from stemloom.llm.canonical import collapsed, hidden_copies
from stemloom.llm.icws import candidate_texts, near_duplicate_pairs, near_duplicates
from stemloom.llm.packing import pack_documents
from stemloom.llm.plain import lookalike_members, lookalike_pairs
from stemloom.llm.spans import shared_spans
from stemloom.llm.sql import ORACLE  # noqa: F401
from stemloom.session import join_groups, load, materialize


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return candidate_texts(load(spark, sf, "candidates"), load(spark, sf, "question_bank"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicate_pairs(_texts(spark, sf), "candidate_id", "texts").select(F.col("a").alias("candidate_a"), F.col("b").alias("candidate_b"))


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Each candidate with its class, named by its smallest candidate, and the number of similar other classes."""
    members, links = near_duplicates(_texts(spark, sf), "candidate_id", "texts")
    ends = links.select(F.col("a1").alias("c1"), F.col("a2").alias("c2")).unionAll(links.select("b1", "b2"))
    n = ends.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n_links"))
    classes = members.groupBy("c1", "c2").agg(F.min("candidate_id").alias("class_first"), F.count(F.lit(1)).alias("n_members"))
    classes = classes.join(n, ["c1", "c2"], "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return join_groups(members, classes, ["c1", "c2"], "n_members", members.count()).select("candidate_id", "class_first", "n_links")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike_pairs(load(spark, sf, "extracted_questions"))


def p5_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The extractions of looks with more than one spelling, each with its class."""
    return lookalike_members(load(spark, sf, "extracted_questions")).drop("class_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    copies, _ = hidden_copies(load(spark, sf, "extracted_questions"))
    return copies.where("first <> extract_no").select(F.col("first").alias("first_extract_no"), "extract_no")


def p6_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct record with its number of copies."""
    return collapsed(load(spark, sf, "extracted_questions"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(load(spark, sf, "documents"), "doc_id", "text")


def p7_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(load(spark, sf, "documents"), "doc_id", "text")


def p7_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of each text as its ids give it back."""
    ids = encode_texts(load(spark, sf, "documents"), "doc_id", "text")
    return decode_ids(ids, "doc_id", "ids").select("doc_id", F.sha2("text", 256).alias("digest"))


def p8_bins(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(load(spark, sf, "documents"))


def p8_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Each packed document, and whether its pieces follow each other without a gap, only the last one short of the
    capacity, in bins that are not over it."""
    bins = materialize(pack_documents(load(spark, sf, "documents")))
    full = bins.groupBy("bin_id").agg(F.sum("n_tokens").alias("load"))
    b = bins.join(full, "bin_id")
    good = (F.col("start") == (F.col("piece") - 1) * 4096) & (F.col("load") <= 4096) & (F.col("n_tokens") > 0)
    short = F.count_if(F.col("n_tokens") < 4096)
    return b.groupBy("doc_id").agg((F.bool_and(good) & (F.max("piece") == F.count(F.lit(1))) & (short <= 1)).alias("fits"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans(load(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p5_found, p5_classes, p6_found, p6_collapsed, p7_ids, p7_counts, p7_roundtrip, p8_bins, p8_cover, p9_found)}
