"""Queries that go through sinks, sources, versions and streams and must come back whole; orders, chains, rejections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemloom.functions import order
from stemloom.operators import evidence, export, registry
from stemloom.plans import curation
from stemloom.plans.curation import _KEYS, _entries, _strip
from stemloom.session import load, materialize, new_folder
from stemloom.sources import files, sinks, versions
from stemloom.streaming import intake as streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"SELECT CAST(sequence_number AS VARCHAR) AS sequence_number, paper_or_chapter, question_type, {_strip('stem')} AS stem, option_a, option_b, option_c, option_d, option_e, correct_answer, explanation FROM ({curation.ORACLE['csv_projection']})")
def csv_round_trip(spark, sf):
    """The CSV rows written with the external header and read back."""
    path = new_folder(spark)
    rows = curation.csv_projection(spark, sf).select(*files.CSV_COLUMNS)
    sinks.write_csv(rows, path, export.HEADER)
    return materialize(files.read_standard_csv(spark, path, export.HEADER).na.fill("")).withColumn("stem", curation.T.strip(F.col("stem")))


_ALLOWED = curation.ORACLE["csv_projection"]


@query(_ALLOWED[: _ALLOWED.index("g AS (SELECT * FROM a")] + """x AS (SELECT question_id, question_type, CASE WHEN NOT coalesce(question_type IN ('single_choice', 'multiple_choice', 'true_false'), false) THEN 'question_type' WHEN len(list_filter(ls, lambda x: x NOT IN ('A', 'B', 'C', 'D', 'E'))) > 0 THEN 'option_label'
WHEN len(list_distinct(ls)) <> len(ls) THEN 'duplicate_option_label' WHEN len(list_filter(options, lambda o: o.text IS NULL)) > 0 THEN 'option_text' WHEN correct_answer IS NULL THEN 'answer' END AS reason FROM a)
SELECT question_id, question_type, reason FROM x WHERE reason IS NOT NULL""")
def csv_rejects(spark, sf):
    """Bank questions that have no place in the CSV, with the first reason."""
    return export.rejected_rows(curation._bank_rows(spark, sf))


@query("SELECT DISTINCT source_id, kind, current_relative_path, array_to_string(path_history, '|') AS history, current_content_hash, revision + 1 AS revision, presence FROM sources")
def versioned_sources(spark, sf):
    """The sources published twice, the second time at the next revision, and read back as the current version; a third
    publication that builds on the first version is refused."""
    base = new_folder(spark)
    s = load(spark, sf, "sources").select("source_id", "kind", "current_relative_path", F.array_join("path_history", "|").alias("history"), "current_content_hash", "revision", "presence").distinct()
    versions.publish(s, base)
    versions.publish(s.withColumn("revision", F.col("revision") + 1), base, expect=1)
    try:
        versions.publish(s, base, expect=1)
        raise AssertionError("a version built on an old one was published")
    except ValueError:
        pass
    return versions.current(spark, base)


@query("SELECT DISTINCT entry_id, source_id, question_number, raw_answer, raw_entry FROM answer_key_entries")
def json_round_trip(spark, sf):
    """Answer entries written as JSON lines and read back."""
    path = new_folder(spark)
    d = _entries(spark, sf)
    sinks.write_json_lines(d, path)
    return materialize(spark.read.schema(d.schema).json(path))


def _arriving(spark: SparkSession, sf: str) -> DataFrame:
    """extracted_questions as a stream of the files of a folder."""
    x = materialize(load(spark, sf, "extracted_questions").select("extract_no", "batch_id", "ingested_at"))
    folder = x.inputFiles()[0].rsplit("/", 1)[0]
    return streams.stream_table(spark, folder, x)


def _drain(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives until its source is read, as a table (the last batch in complete mode)."""
    spark = stream.sparkSession
    out = new_folder(spark)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(spark)).outputMode(mode).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", new_folder(spark)).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT strftime(date_trunc('day', ingested_at), '%Y-%m-%d') AS day, count(*) AS n FROM extracted_questions WHERE ingested_at IS NOT NULL GROUP BY 1")
def stream_arrivals(spark, sf):
    """Extractions that arrive per day, counted by a stream."""
    d = _drain(streams.arrivals(_arriving(spark, sf), "ingested_at", delay="10000 days"), "complete")
    return d.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n")


@query("SELECT extract_no, count(DISTINCT extract_no) AS n FROM extracted_questions WHERE ingested_at IS NOT NULL GROUP BY 1")
def stream_once(spark, sf):
    """Each extraction as often as a stream lets it through that drops redelivered rows: once."""
    d = _drain(streams.once_each(_arriving(spark, sf), "extract_no", "ingested_at", "10000 days"), "append")
    return d.groupBy("extract_no").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_number() OVER (ORDER BY lower(path), source_id) AS place, path, source_id FROM (SELECT DISTINCT source_id, current_relative_path AS path FROM sources)")
def registry_order(spark, sf):
    """Registry rows numbered in their order: by folded path, then by id."""
    s = load(spark, sf, "sources").select("source_id", F.col("current_relative_path").alias("path")).distinct()
    return export.number_rows(s.withColumn("folded", order.casefold(F.col("path"))), ["folded", "source_id"], "place").select("place", "path", "source_id")


@query("""SELECT row_number() OVER (ORDER BY source_id, locator, evidence_fingerprint, decision_id) AS place, source_id, locator, evidence_fingerprint, decision_id
FROM (SELECT DISTINCT decision_id, e.source_id AS source_id, e.locator AS locator, e.evidence_fingerprint AS evidence_fingerprint FROM (SELECT decision_id, unnest(evidence) AS e FROM decisions))""")
def evidence_order(spark, sf):
    """Evidence rows numbered in their order, in which locators compare as text."""
    e = load(spark, sf, "decisions").select("decision_id", F.explode("evidence").alias("e")).select("decision_id", "e.source_id", "e.locator", "e.evidence_fingerprint").distinct()
    return export.number_rows(e, ["source_id", "locator", "evidence_fingerprint", "decision_id"], "place").select("place", "source_id", "locator", "evidence_fingerprint", "decision_id")


@query("""SELECT candidate_id, e.source_id AS source_id, count(DISTINCT decision_id) AS n_decisions FROM (SELECT decision_id, candidate_id, unnest(evidence) AS e FROM decisions WHERE candidate_id IS NOT NULL) GROUP BY 1, 2""")
def answer_sources(spark, sf):
    """The sources on which the answers of a candidate rest, one row each, so that no array grows with a hot candidate."""
    d = load(spark, sf, "decisions").where("candidate_id IS NOT NULL").select("decision_id", "candidate_id", F.explode("evidence.source_id").alias("source_id")).distinct()
    return d.groupBy("candidate_id", "source_id").agg(F.count(F.lit(1)).alias("n_decisions"))


_CHAIN = """h AS (SELECT DISTINCT source_id, path_history AS p FROM sources WHERE len(path_history) > 0), c AS (SELECT source_id, unnest(range(1, len(p) + 1)) AS i, p FROM h),
n AS (SELECT source_id || '#' || i AS key, CASE WHEN i > 1 THEN source_id || '#' || (i - 1) END AS parent, i + CASE WHEN source_id[1] = '0' AND i = 2 THEN 1 ELSE 0 END AS generation, sha256(p[i]) AS digest, CASE WHEN i > 1 THEN sha256(p[i - 1] || CASE WHEN source_id[1] = '1' THEN 'x' ELSE '' END) END AS parent_digest FROM c WHERE NOT (source_id[1] = '2' AND i = 1))"""


@query(f"""WITH {_CHAIN}, j AS (SELECT n.*, u.key IS NOT NULL AS there, u.generation AS g, u.digest AS d FROM n LEFT JOIN n u ON u.key = n.parent)
SELECT key, 'parent' AS fault FROM j WHERE parent IS NOT NULL AND NOT there UNION ALL SELECT key, 'generation' FROM j WHERE generation <> CASE WHEN parent IS NULL THEN 1 ELSE g + 1 END UNION ALL SELECT key, 'digest' FROM j WHERE there AND parent_digest IS DISTINCT FROM d""")
def chain_faults(spark, sf):
    """The places of a source as a chain of snapshots, some of them broken by the first digit of their id."""
    s = load(spark, sf, "sources").select("source_id", F.col("path_history").alias("p")).distinct().where("size(p) > 0")
    c = s.select("source_id", "p", F.posexplode("p").alias("k", "path")).withColumn("i", F.col("k") + 1)
    first = F.substring("source_id", 1, 1)
    c = c.where(~((first == "2") & (F.col("i") == 1)))
    before = F.concat(F.get("p", F.col("k") - 1), F.when(first == "1", "x").otherwise(""))
    n = c.select(
        F.concat_ws("#", "source_id", "i").alias("key"), F.when(F.col("i") > 1, F.concat_ws("#", "source_id", F.col("i") - 1)).alias("parent"), (F.col("i") + F.when((first == "0") & (F.col("i") == 2), 1).otherwise(0)).alias("generation"),
        F.sha2("path", 256).alias("digest"), F.when(F.col("i") > 1, F.sha2(before, 256)).alias("parent_digest"),
    )
    return registry.chain_faults(n, "key", "parent", "generation", "digest", "parent_digest")


@query(f"""WITH {_KEYS}, n AS (SELECT *, count(*) OVER (PARTITION BY source_id, question_number) = 1 AS one FROM k WHERE {_strip("raw_answer")} <> '' AND NOT contains(raw_answer, chr(10)) AND NOT contains(raw_answer, chr(13)) AND NOT regexp_matches(raw_answer, '[0-9]')),
r AS (SELECT *, regexp_extract('答案：' || raw_answer, '{curation._IN}', 1) AS given FROM n), z AS (SELECT *, regexp_replace(given, '[ \\t、,，;；/]', '', 'g') AS compact FROM r WHERE given <> '')
SELECT entry_id, CASE WHEN given IN ('正确', '错误', '√', '×') THEN 'JUDGMENT_ANSWER' WHEN NOT regexp_full_match(compact, '[A-Za-z]+') THEN 'TEXT_ANSWER' WHEN question_number IS NOT NULL AND one THEN 'INLINE_CURRENT' ELSE 'UNRESOLVED_ANSWER' END AS kind,
CASE WHEN given NOT IN ('正确', '错误', '√', '×') AND regexp_full_match(compact, '[A-Za-z]+') AND question_number IS NOT NULL AND one THEN CAST(question_number AS BIGINT) END AS question_number, given AS raw_answer FROM z""")
def answer_lines_in_context(spark, sf):
    """Single answers without a number, each in the context of its entry's number: unique in its source or not."""
    k = _entries(spark, sf).where(~F.col("raw_answer").rlike("[\\r\\n0-9]") & (curation.T.strip(F.col("raw_answer")) != ""))
    same = k.groupBy("source_id", "question_number").agg((F.count(F.lit(1)) == 1).alias("one"))
    k = k.join(same, ["source_id", "question_number"], "left").withColumns({"text": F.concat(F.lit("答案："), "raw_answer"), "near": F.lit(True)})
    d = evidence.rich_answers(k, "entry_id", "text", "question_number", "one", "near")
    return d.select("entry_id", "kind", "question_number", "raw_answer")
