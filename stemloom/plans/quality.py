"""Queries of the general data-quality operators (problems 2, 3 and 4) over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemloom.operators.dewey import dewey_nodes, question_children
from stemloom.operators.orphans import QUESTION_BANK_KEYS, orphan_cascade, orphan_report
from stemloom.operators.packed import delimiter_profile, split_packed
from stemloom.session import load


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return question_children(load(spark, sf, "raw_banks"))


def p2_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The flat tables that the bank documents hold: nodes and documents for each schema path."""
    nodes = dewey_nodes(load(spark, sf, "raw_banks"), "file_no", "body")
    return nodes.groupBy("schema_path", "kind").agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("file_no").alias("n_files"))


def _answers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    keys = load(spark, sf, "answer_key_entries").select("source_id", "entry_id", "raw_answer").distinct()
    rows = load(spark, sf, "standard_bank_rows").select("csv_row_id", "correct_answer").distinct().select(F.lit("standard_bank_rows").alias("source"), "csv_row_id", "correct_answer")
    return keys, rows


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    keys, rows = _answers(spark, sf)
    # both tables in one pass; the table is part of the name of a source
    a = keys.select(F.concat_ws("\u001f", F.lit("answer_key_entries"), "source_id").alias("source"), F.col("entry_id").alias("id"), F.col("raw_answer").alias("raw"))
    b = rows.select("source", F.col("csv_row_id").alias("id"), F.col("correct_answer").alias("raw"))
    return split_packed(a.unionByName(b), "source", "id", "raw").select(F.substring_index("source", "\u001f", 1).alias("origin"), F.col("key").alias("record_id"), "pos", "val")


def p3_delimiters(spark: SparkSession, sf: str) -> DataFrame:
    """The delimiters inferred for each answer source, of both tables (origin); all standard_bank_rows are one source."""
    keys, rows = _answers(spark, sf)
    a = delimiter_profile(keys, "source_id", "raw_answer").withColumn("origin", F.lit("answer_key_entries"))
    b = delimiter_profile(rows, "source", "correct_answer").withColumn("origin", F.lit("standard_bank_rows"))
    return a.unionByName(b).select("origin", "source", "delimiter", "n_fields", *[F.round(c, 6).alias(c) for c in ("consistency", "regularity", "score")])


def _cascade(spark: SparkSession, sf: str) -> DataFrame:
    tables = {t: load(spark, sf, t) for t in ("sources", "candidates", "decisions", "review_queue")}
    return orphan_cascade(tables, QUESTION_BANK_KEYS)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _cascade(spark, sf).where("origin = 'direct'").select("child_table", "period", "child_key", "parent_key", "kind")


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Direct and inherited orphans per table and month."""
    return orphan_report(_cascade(spark, sf))


QUERIES = {f.__name__: f for f in (p2_found, p2_tables, p3_found, p3_delimiters, p4_found, p4_report)}

_P4 = """
WITH s AS (SELECT lower(trim(source_id)) AS pk, min(registered_at) AS born, CASE WHEN count(removed_at) = count(*) THEN max(removed_at) END AS died FROM sources GROUP BY 1),
c AS (SELECT lower(trim(candidate_id)) AS pk, min(created_at) AS born, CASE WHEN count(archived_at) = count(*) THEN max(archived_at) END AS died FROM candidates GROUP BY 1),
refs AS (
  SELECT DISTINCT 'candidates' AS child_table, candidate_id AS child_key, lower(trim(source_id)) AS parent_key, created_at AS t FROM candidates WHERE source_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'decisions', decision_id, lower(trim(candidate_id)), recorded_at FROM decisions WHERE candidate_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'review_queue', review_id, lower(trim(candidate_id)), recorded_at FROM review_queue WHERE candidate_id IS NOT NULL),
j AS (
  SELECT r.*, p.pk, p.born, p.died FROM refs r LEFT JOIN (SELECT 'candidates' AS tbl, * FROM s UNION ALL SELECT 'decisions', * FROM c UNION ALL SELECT 'review_queue', * FROM c) p
  ON p.tbl = r.child_table AND p.pk = r.parent_key),
direct AS (
  SELECT child_table, strftime(t, '%Y-%m') AS period, child_key, parent_key, 'missing' AS kind FROM j WHERE pk IS NULL
  UNION ALL SELECT child_table, strftime(t, '%Y-%m'), child_key, parent_key, 'late' FROM j WHERE born > t
  UNION ALL SELECT child_table, strftime(t, '%Y-%m'), child_key, parent_key, 'deleted' FROM j WHERE died <= t)
"""

def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


# The rules of packed fields, stated for RE2: no look-around, so a joining word takes the blanks beside it along, and a straight
# single quote after a letter or digit belongs to that.
_B = r"[\x{09}-\x{0d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_QUOTE = r"""(?:"[^"]*(?:""[^"]*)*"|＂[^＂]*(?:＂＂[^＂]*)*＂|'[^']*(?:''[^']*)*'|“[^”]*”|‘[^’]*’|「[^」]*」|『[^』]*』)"""
_CLASSES = {
    "comma": "[,，﹐]", "semicolon": "[;；﹔]", "enumeration": "[、､﹑]", "slash": "[/／]", "bar": "[|｜]", "ampersand": "[&＆﹠]", "line": r"[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]", "tab": r"\t",
    "word_and": rf"[ \x{{a0}}\x{{3000}}](?:[aA][nN][dD]|[ａＡ][ｎＮ][ｄＤ])[ \x{{a0}}\x{{3000}}]", "word_he": "和", "word_yu": "与", "word_ji": "以?及",
}
_SEP = "(?:" + "|".join(_CLASSES.values()) + ")"
_trim = lambda c: f"regexp_replace(regexp_replace({c}, '^{_B}+', ''), '(?:{_B}|[。｡])+$', '')"
_WRAPS = [rf"{a}((?:{_QUOTE}|{a}(?:{a}[^{a}{b}]*{b}|[^{a}{b}])*{b}|[^{a}{b}])*){b}" for a, b in zip([r"\(", "（", r"\[", "［", "【", "〔", r"\{", "｛", "〈", "《", "<"], [r"\)", "）", r"\]", "］", "】", "〕", r"\}", "｝", "〉", "》", ">"])]
_INNER = "CASE " + " ".join(f"WHEN regexp_full_match(f, '{_re2(w)}') THEN regexp_extract(f, '{_re2(w)}', 1)" for w in _WRAPS) + " END"
_FIELDS = f"""raw AS (SELECT DISTINCT 'answer_key_entries' AS origin, source_id AS source, entry_id AS record_id, raw_answer AS f FROM answer_key_entries WHERE raw_answer IS NOT NULL
  UNION ALL SELECT DISTINCT 'standard_bank_rows', 'standard_bank_rows', csv_row_id, correct_answer FROM standard_bank_rows WHERE correct_answer IS NOT NULL),
u AS (SELECT origin, source, record_id, {_trim("f")} AS f FROM raw
  UNION ALL SELECT origin, source, record_id, {_trim("i")} FROM (SELECT *, {_INNER} AS i FROM u) WHERE i IS NOT NULL),
fields AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin, record_id, source ORDER BY length(f)) AS step FROM u) WHERE step = 1 AND f <> '')"""
_P3 = f"""WITH RECURSIVE {_FIELDS},
k AS (SELECT origin, record_id, i, k, regexp_full_match(k, '(?s){_re2(_QUOTE)}') AS quoted, regexp_full_match(k, '{_SEP}') AS sep FROM (SELECT origin, record_id, unnest(x) AS k, generate_subscripts(x, 1) AS i FROM
  (SELECT origin, record_id, regexp_extract_all(f, '(?s){_re2(_QUOTE)}|{_SEP}|(?:[^\\P{{L}}和与及以]|\\p{{N}})''?|.') AS x FROM fields))),
g AS (SELECT *, sum(CASE WHEN quoted OR sep THEN 1 ELSE 0 END) OVER (PARTITION BY origin, record_id ORDER BY i) AS piece FROM k),
v AS (SELECT origin, record_id, i, false AS quoted, '' AS q, '' AS v FROM g WHERE false
  UNION ALL SELECT origin, record_id, i, true, k[1], k[2:-2] FROM g WHERE quoted
  UNION ALL SELECT origin, record_id, max(i), false, '', string_agg(k, '' ORDER BY i) FROM g WHERE NOT quoted AND NOT sep GROUP BY origin, record_id, piece),
c AS (SELECT origin, record_id, i, quoted, CASE WHEN quoted THEN CASE WHEN q IN ('"', '''', '＂') THEN replace(v, q || q, q) ELSE v END ELSE regexp_replace(v, '^{_B}+|{_B}+$', '', 'g') END AS v FROM v),
w AS (SELECT origin, record_id, i, CASE WHEN quoted AND regexp_full_match(v, '[A-Ea-eＡ-Ｅａ-ｅ]+') THEN [translate(upper(v), 'ＡＢＣＤＥ', 'ABCDE')] WHEN NOT quoted AND regexp_full_match(v, '(?:[A-Ea-eＡ-Ｅａ-ｅ]|{_B})+') THEN string_split(translate(upper(regexp_replace(v, '{_B}', '', 'g')), 'ＡＢＣＤＥ', 'ABCDE'), '') ELSE [v] END AS vs FROM c WHERE v <> ''),
o AS (SELECT origin, record_id, i, generate_subscripts(vs, 1) AS j, unnest(vs) AS val FROM w)
SELECT origin, record_id, CAST(row_number() OVER (PARTITION BY origin, record_id ORDER BY i, j) AS INTEGER) AS pos, val FROM o WHERE val <> ''"""
_PROFILE = f"""WITH RECURSIVE {_FIELDS}, b AS (SELECT origin, source, regexp_replace(f, '{_re2(_QUOTE)}', chr(1), 'g') AS f FROM fields),
h AS ({" UNION ALL ".join(f"SELECT origin, source, '{name}' AS delimiter, string_split_regex(f, '{p}') AS ps FROM b WHERE regexp_matches(f, '{p}')" for name, p in _CLASSES.items())}),
r AS (SELECT origin, source, delimiter, len(ps) AS n, len(list_filter(ps, lambda p: regexp_full_match(regexp_replace(p, '^{_B}+|{_B}+$', '', 'g'), '\\x01|[A-Ea-eＡ-Ｅａ-ｅ]|[√×]|\\p{{L}}*[-\\p{{N}}.]+\\p{{L}}*'))) AS regular FROM h),
c AS (SELECT origin, source, delimiter, n, count(*) AS fields, sum(regular) AS regular FROM r GROUP BY 1, 2, 3, 4),
p AS (SELECT origin, source, delimiter, CAST(sum(fields) AS BIGINT) AS n_fields, max(fields) / sum(fields) AS consistency, sum(regular) / sum(n * fields) AS regularity FROM c GROUP BY 1, 2, 3)
SELECT origin, source, delimiter, n_fields, round(consistency, 6) AS consistency, round(regularity, 6) AS regularity, round(n_fields / sum(n_fields) OVER (PARTITION BY origin, source) * (consistency + regularity) / 2, 6) AS score FROM p"""

_TREE = """v AS MATERIALIZED (SELECT file_no, body FROM raw_banks WHERE body IS NOT NULL AND json_valid(body)),
t AS MATERIALIZED (SELECT v.file_no, t.key, t.value ->> '$' AS value, t.type, t.id, t.parent, t.fullkey FROM v, json_tree(v.body) t)"""
_P2 = f"""WITH {_TREE},
k AS (SELECT *, regexp_extract(fullkey, '^([$](?:\\.sections\\[\\d+\\])?\\.questions\\[\\d+\\])(.*)$', 1) AS qkey, regexp_extract(fullkey, '^([$](?:\\.sections\\[\\d+\\])?\\.questions\\[\\d+\\])(.*)$', 2) AS rest FROM t),
q AS (SELECT file_no, qkey, id, row_number() OVER (PARTITION BY file_no ORDER BY id) AS question_pos FROM k WHERE qkey <> '' AND rest = '' AND type = 'OBJECT'),
c AS (
  SELECT e.file_no, e.qkey, 'option' AS child_kind, coalesce((SELECT any_value(l.value) FROM k l WHERE l.file_no = e.file_no AND l.parent = e.id AND l.key = 'label' AND l.type NOT IN ('OBJECT', 'ARRAY', 'NULL')), '') AS child_key, lpad(CAST(e.id AS VARCHAR), 12, '0') AS place FROM k e WHERE regexp_full_match(e.rest, '\\.options\\[\\d+\\]')
  UNION ALL SELECT m.file_no, m.qkey, 'option', m.key, lpad(CAST(m.id AS VARCHAR), 12, '0') FROM k m JOIN k o ON o.file_no = m.file_no AND o.id = m.parent WHERE o.rest = '.options' AND o.type = 'OBJECT'
  UNION ALL SELECT file_no, qkey, 'locator', value, lpad(CAST(id AS VARCHAR), 12, '0') FROM k WHERE regexp_full_match(rest, '\\.source_reference(\\[\\d+\\])*\\.locator(\\[\\d+\\])*') AND type NOT IN ('OBJECT', 'ARRAY', 'NULL')
  UNION ALL SELECT file_no, qkey, 'note', value, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(rest, '.items', '.zitems'), '\\[(\\d)\\]', '[0\\1]', 'g'), '\\[(\\d\\d)\\]', '[0\\1]', 'g'), '\\[(\\d\\d\\d)\\]', '[0\\1]', 'g'), '\\[(\\d\\d\\d\\d)\\]', '[0\\1]', 'g') FROM k
    WHERE regexp_full_match(rest, '\\.metadata\\.qbc_extraction_notes(\\[\\d+\\]|\\.text|\\.items)*') AND type = 'VARCHAR' AND regexp_matches(value, '[^\\x{{09}}-\\x{{0D}}\\x{{1C}}-\\x{{20}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]'))
SELECT c.file_no, child_kind, CAST(question_pos AS INTEGER) AS question_pos, CAST(row_number() OVER (PARTITION BY c.file_no, question_pos, child_kind ORDER BY place) AS INTEGER) AS child_pos, child_key FROM c JOIN q ON q.file_no = c.file_no AND q.qkey = c.qkey"""

ORACLE = {
    "p3_found": _P3,
    "p3_delimiters": _PROFILE,
    "p2_found": _P2,
    "p2_tables": f"""WITH RECURSIVE {_TREE},
p AS (SELECT file_no, id, type, '$' AS path FROM t WHERE parent IS NULL
  UNION ALL SELECT t.file_no, t.id, t.type, p.path || CASE WHEN p.type = 'ARRAY' THEN '/[]' ELSE '/' || replace(replace(replace(t.key, '~', '~0'), '/', '~1'), '[', '~2') END FROM p JOIN t ON t.file_no = p.file_no AND t.parent = p.id)
SELECT path AS schema_path, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, count(*) AS n_nodes, count(DISTINCT file_no) AS n_files FROM p GROUP BY 1, 2""",
    "p4_found": _P4 + "SELECT * FROM direct",
    "p4_report": _P4 + """,
cascade_rows AS (
  SELECT child_table, period, child_key, parent_key, kind, 'direct' AS origin FROM direct
  UNION ALL SELECT r.child_table, strftime(r.t, '%Y-%m'), r.child_key, r.parent_key, 'inherited', 'inherited' FROM refs r
  WHERE r.child_table <> 'candidates' AND r.parent_key IN (SELECT lower(trim(child_key)) FROM direct WHERE child_table = 'candidates'))
SELECT child_table, period, origin, kind, count(*) AS n_refs, count(DISTINCT child_key) AS n_children FROM cascade_rows GROUP BY 1, 2, 3, 4
""",
}
