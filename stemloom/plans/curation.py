"""Queries of the curation operators over the test tables, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemloom.functions import text as T
from stemloom.functions.answers import choice_label, multiple_choice, true_false
from stemloom.operators import evidence as E
from stemloom.operators import export as X
from stemloom.operators import integrity, lines, registry, strict
from stemloom.session import load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _re2(pattern: str) -> str:
    """A pattern of this library as RE2 takes it, in an SQL literal (a dot there stops at LF only, as (?d) says)."""
    return pattern.replace("(?d:", "(?:").replace("'", "''")


W = f"[{T.WHITE}]"


def _norm(c: str) -> str:
    """The normal form of a text in SQL."""
    return f"nullif(trim(regexp_replace(nfc_normalize({c}), '{W}+', ' ', 'g')), '')"


def _stems(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "question_bank").select("question_id", "question_type", "stem", F.col("options.text").alias("texts")).distinct()


@query(f"SELECT question_id, {_norm('stem')} AS normal, sha256({_norm('stem')}) AS fingerprint FROM (SELECT DISTINCT question_id, stem FROM question_bank)")
def text_fingerprint(spark, sf):
    d = load(spark, sf, "question_bank").select("question_id", "stem").distinct().withColumn("normal", T.normalize_text(F.col("stem")))
    return d.select("question_id", "normal", T.text_fingerprint(F.col("normal")).alias("fingerprint"))


@query(f"SELECT question_type, count(*) AS n_rows, count_if(sha256({_norm('stem')}) = fingerprints.stem_fingerprint) AS n_equal FROM (SELECT DISTINCT candidate_id, question_type, stem, fingerprints FROM candidates) GROUP BY 1")
def fingerprint_audit(spark, sf):
    """Stored stem fingerprints against recomputed ones."""
    d = load(spark, sf, "candidates").select("candidate_id", "question_type", "stem", "fingerprints.stem_fingerprint").distinct()
    d = d.withColumn("own", T.text_fingerprint(T.normalize_text(F.col("stem"))))
    return d.groupBy("question_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("own") == F.col("stem_fingerprint")).alias("n_equal"))


_NORMALS = f"list_transform(options, lambda o: {_norm('o.text')})"


@query(f"""WITH q AS (SELECT DISTINCT question_id, question_type, stem, options FROM question_bank), n AS (SELECT question_id, question_type, {_norm('stem')} AS stem, {_NORMALS} AS texts FROM q)
SELECT question_id, CASE WHEN len(texts) > 0 AND len(list_filter(texts, lambda x: x IS NULL)) = 0 THEN sha256(CAST(to_json(list_sort(texts)) AS VARCHAR)) END AS option_set_fingerprint,
CASE WHEN question_type = 'single_choice' AND stem IS NOT NULL AND len(texts) > 0 AND len(list_filter(texts, lambda x: x IS NULL)) = 0 THEN sha256(CAST(to_json({{'options': texts, 'question_type': question_type, 'stem': stem}}) AS VARCHAR)) END AS revision_fingerprint FROM n""")
def content_fingerprints(spark, sf):
    d = T.normal_options(_stems(spark, sf), "normal", "texts").withColumn("norm_stem", T.normalize_text(F.col("stem")))
    return d.select("question_id", T.option_set_fingerprint(F.col("normal")).alias("option_set_fingerprint"), T.revision_fingerprint(F.col("norm_stem"), F.col("normal"), F.col("question_type")).alias("revision_fingerprint"))


@query("""WITH c AS (SELECT DISTINCT candidate_id, source_id, fingerprints.content_revision_fingerprint AS fp FROM candidates)
SELECT candidate_id, CASE WHEN fp IS NOT NULL AND count(*) OVER (PARTITION BY source_id, fp) > 1 AND source_id IS NOT NULL THEN 'content-sha256:' || fp END AS duplicate_group FROM c""")
def duplicate_groups(spark, sf):
    c = load(spark, sf, "candidates").select("candidate_id", "source_id", F.col("fingerprints.content_revision_fingerprint").alias("fp")).distinct()
    return registry.duplicate_groups(c, "source_id", "fp").select("candidate_id", "duplicate_group")


_LINES = f"""l AS (SELECT doc_id, generate_subscripts(x, 1) AS line, unnest(x) AS raw_text FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
n AS (SELECT doc_id, line, raw_text, regexp_replace(regexp_replace(raw_text, '[{T.ZERO_WIDTH}]', '', 'g'), '{W}', ' ', 'g') AS normalized_text FROM l)"""


@query(f"WITH {_LINES} SELECT doc_id, CAST(line AS INTEGER) AS line, normalized_text, length(raw_text) - length(regexp_replace(raw_text, '[{T.ZERO_WIDTH}]', '', 'g')) AS removed FROM n")
def document_lines(spark, sf):
    d = lines.document_lines(load(spark, sf, "documents"), "doc_id", "text")
    return d.select("doc_id", "line", "normalized_text", (F.col("bom_removed") + F.col("zero_width_removed")).cast("bigint").alias("removed"))


def _false(c: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, '{_re2(p)}')" for p in lines.FALSE_NUMBERS) + ")"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{W}+|{W}+$', '', 'g')"


_NUM = _re2(lines.NUMBER_MARKER)


def _document_lines_by_document(spark, sf) -> DataFrame:
    """Documents are shuffled before they are split: the windows over their lines then need no shuffle of the lines."""
    return lines.document_lines(load(spark, sf, "documents").select("doc_id", "text").repartition("doc_id"), "doc_id", "text")


_BOUNDS = f"""{_LINES},
m AS (SELECT *, {_strip('normalized_text')} AS s, regexp_matches(normalized_text, '{_NUM}') AS is_number, regexp_matches(normalized_text, '{_re2(lines.CHINESE_MARKER)}') AS is_chinese FROM n),
p AS (SELECT *, regexp_matches(s, '{lines.HEADING}') OR s IN ('单项选择题', '多项选择题', '课程名称') AS heading, {_false('s')} AS false_number, is_number OR is_chinese AS has_marker,
  CASE WHEN is_number THEN {_strip(f"regexp_extract(normalized_text, '{_NUM}', 6)")} WHEN is_chinese THEN {_strip(f"regexp_extract(normalized_text, '{_re2(lines.CHINESE_MARKER)}', 2)")} END AS stem0,
  CASE WHEN is_number THEN coalesce(nullif(regexp_extract(normalized_text, '{_NUM}', 1), ''), regexp_extract(normalized_text, '{_NUM}', 4) || regexp_extract(normalized_text, '{_NUM}', 5)) WHEN is_chinese THEN regexp_extract(normalized_text, '{_re2(lines.CHINESE_MARKER)}', 1) || '、' END AS marker,
  CASE WHEN is_number THEN TRY_CAST(coalesce(nullif(regexp_extract(normalized_text, '{_NUM}', 2), ''), nullif(regexp_extract(normalized_text, '{_NUM}', 3), ''), nullif(regexp_extract(normalized_text, '{_NUM}', 4), '')) AS BIGINT) END AS number FROM m),
t AS (SELECT *, starts_with(stem0, '[single_choice]') AS typed FROM p),
u AS (SELECT *, {_strip("CASE WHEN typed THEN substr(stem0, 16) ELSE stem0 END")} AS stem FROM t),
v AS (SELECT *, length(stem) >= 4 AND NOT {_false(_strip('stem'))} AND regexp_matches(stem, '[^\\p{{Nd}}]') AS plausible FROM u),
x AS (SELECT *, CASE WHEN heading OR false_number OR NOT has_marker THEN 'NONE' WHEN stem = '' THEN 'WEAK' WHEN plausible AND (typed OR starts_with(marker, '(')) THEN 'STRONG' WHEN plausible THEN 'MEDIUM' ELSE 'WEAK' END AS strength FROM v),
b AS (SELECT *, sum(CASE WHEN strength IN ('STRONG', 'MEDIUM') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS block, nullif(regexp_extract(normalized_text, '{_re2(lines.OPTION_LINE)}', 1), '') AS label FROM x)"""


@query(f"""WITH {_BOUNDS},
c AS (SELECT *, coalesce(CASE WHEN strength IN ('STRONG', 'MEDIUM') THEN block - 1 ELSE block END, 0) AS own FROM b),
k AS (SELECT a.doc_id, a.line, count(DISTINCT o.label) AS n FROM c a JOIN c o ON a.doc_id = o.doc_id AND o.block = a.own AND a.own > 0 AND o.line < a.line GROUP BY 1, 2)
SELECT c.doc_id, CAST(c.line AS INTEGER) AS line, strength, CASE WHEN has_marker AND NOT heading AND NOT false_number THEN number END AS question_number,
CASE WHEN has_marker AND NOT heading AND NOT false_number THEN marker END AS question_marker, CASE WHEN has_marker AND NOT heading AND NOT false_number THEN nullif(substr(stem, 1, 80), '') END AS stem_preview, coalesce(k.n, 0) >= 2 AS previous_complete, coalesce(k.n, 0) >= 1 AS option_state
FROM c LEFT JOIN k ON c.doc_id = k.doc_id AND c.line = k.line""")
def boundary_signals(spark, sf):
    d = lines.boundaries(_document_lines_by_document(spark, sf), "doc_id")
    return d.select("doc_id", "line", "strength", "question_number", "question_marker", "stem_preview", "previous_complete", "option_state")


_MARK = _re2(lines.MARKER)
_OPTIONS = f"""{_BOUNDS},
act AS (SELECT doc_id, line, raw_text, normalized_text AS t, strength IN ('STRONG', 'MEDIUM') AS bd, max(CASE WHEN strength IN ('STRONG', 'MEDIUM') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS active FROM b),
ol AS (SELECT doc_id, line, raw_text, t, regexp_matches(t, '^[ \\t]*[A-Za-z]、[A-Za-z](?:两组|组)') AS grp, ' ' || nullif(regexp_extract(t, '(?s)^[ \\t]*(?:[-*+][ \\t]*)?({_MARK}.*)$', 1), '') AS body FROM act WHERE active = 1 AND NOT bd),
om AS (SELECT doc_id, line, i AS spot, marks[i] AS marker, {_strip("texts[i + 1]")} AS found FROM (SELECT *, unnest(range(1, len(marks) + 1)) AS i FROM (SELECT *, regexp_extract_all(body, '{W}({_MARK})', 1) AS marks, string_split_regex(body, '{W}{_MARK}') AS texts FROM ol WHERE NOT grp AND body IS NOT NULL))
  UNION ALL SELECT doc_id, line, 1, NULL, {_strip("raw_text")} FROM ol WHERE NOT grp AND body IS NULL AND {_strip("t")} <> ''),
oo AS (SELECT *, sum(CASE WHEN marker IS NOT NULL AND found <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line, spot) AS ordinal FROM om),
og AS (SELECT doc_id, ordinal, min(line) FILTER (marker IS NOT NULL AND found <> '') AS line, any_value(marker) FILTER (found <> '' AND marker IS NOT NULL) AS marker, any_value(found) FILTER (found <> '' AND marker IS NOT NULL) AS own,
  string_agg(found, chr(10) ORDER BY line) FILTER (marker IS NULL) AS more, coalesce(string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (marker IS NULL), '') AS continuation_lines FROM oo WHERE ordinal > 0 GROUP BY 1, 2),
ob AS (SELECT *, upper(regexp_extract(marker, '[A-Za-z]')) AS label FROM og),
oz AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY ordinal) > 1 AS seen, coalesce(max(ascii(label)) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 65) AS expected FROM ob)"""


@query(f"""WITH {_OPTIONS} SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(ordinal AS BIGINT) AS ordinal, label, marker, CASE WHEN marker[1] = '(' THEN 'parenthesized' WHEN marker[1] = '（' THEN 'fullwidth_parenthesized'
  ELSE CASE marker[-1] WHEN '.' THEN 'dot' WHEN '、' THEN 'ideographic_comma' WHEN '．' THEN 'fullwidth_dot' WHEN ')' THEN 'close_parenthesis' WHEN '：' THEN 'fullwidth_colon' END END AS style,
  concat_ws(chr(10), own, more) AS option_text, continuation_lines, concat_ws(',', CASE WHEN regexp_matches(marker, '^[a-z]') THEN 'LOWERCASE_LABEL_NORMALIZED' END, CASE WHEN seen THEN 'DUPLICATE_OPTION_LABEL' WHEN ascii(label) <> expected THEN 'OPTION_SEQUENCE_GAP' END) AS warnings FROM oz""")
def option_markers(spark, sf):
    d = lines.option_markers(lines.boundaries(_document_lines_by_document(spark, sf), "doc_id"), "doc_id")
    return d.withColumns({"continuation_lines": F.array_join(F.transform("continuation_lines", lambda x: x.cast("string")), ","), "warnings": F.array_join("warnings", ",")})


@query(f"""WITH {_OPTIONS}, ws AS (SELECT doc_id, 'LETTER_GROUP_NOT_OPTION' AS w FROM ol WHERE grp UNION SELECT doc_id, 'INCOMPLETE_OPTION_MARKER' FROM om WHERE marker IS NOT NULL AND found = ''
  UNION SELECT doc_id, CASE WHEN seen THEN 'DUPLICATE_OPTION_LABEL' ELSE 'OPTION_SEQUENCE_GAP' END FROM oz WHERE seen OR ascii(label) <> expected),
ds AS (SELECT DISTINCT doc_id FROM ol WHERE grp OR body IS NOT NULL OR {_strip("t")} <> ''),
rs AS (SELECT doc_id, (SELECT count(*) FROM oz WHERE oz.doc_id = ds.doc_id) AS n_options, coalesce((SELECT string_agg(w, ',' ORDER BY w) FROM ws WHERE ws.doc_id = ds.doc_id), '') AS warnings FROM ds)
SELECT doc_id, n_options, CASE WHEN n_options = 0 THEN 'none' WHEN warnings <> '' THEN 'medium' ELSE 'high' END AS confidence, warnings FROM rs""")
def option_report(spark, sf):
    d = lines.option_report(lines.boundaries(_document_lines_by_document(spark, sf), "doc_id"), "doc_id")
    return d.withColumn("warnings", F.array_join("warnings", ","))


def strict_texts(spark, sf) -> DataFrame:
    """One strict text for each bank question; options keep their labels, so repeated or foreign ones make findings."""
    q = load(spark, sf, "question_bank").select("question_id", "question_type", "stem", "options").distinct()
    head = F.concat(F.lit("1. ["), F.coalesce("question_type", F.lit("")), F.lit("] "), F.regexp_replace(F.coalesce("stem", F.lit("")), r"[\r\n]+", " "))
    opts = F.transform(F.coalesce("options", F.array().cast(q.schema["options"].dataType)), lambda o: F.concat(F.lit("- "), F.coalesce(o["label"], F.lit("")), F.lit(". "), F.regexp_replace(F.coalesce(o["text"], F.lit("")), r"[\r\n]+", " ")))
    return q.select("question_id", F.array_join(F.concat(F.array(head), opts), "\n").alias("text"))


_STRICT_TEXTS = """src AS (SELECT question_id AS key, array_to_string(list_prepend('1. [' || coalesce(question_type, '') || '] ' || regexp_replace(coalesce(stem, ''), '[\\r\\n]+', ' ', 'g'),
  list_transform(coalesce(options, []), lambda o: '- ' || coalesce(o.label, '') || '. ' || regexp_replace(coalesce(o.text, ''), '[\\r\\n]+', ' ', 'g'))), chr(10)) AS text FROM (SELECT DISTINCT question_id, question_type, stem, options FROM question_bank))"""
_EDGE = f"[^{T.WHITE}](?:.*[^{T.WHITE}])?"


def _strict_sql(source: str) -> str:
    """Fences by a recursive walk over their lines, blocks by running counts, of each block its first fault."""
    header, option = rf"^[ \t]*([1-9][0-9]*)[.)][ \t]+\[single_choice\][ \t]+({_EDGE})[ \t]*$", rf"^[ \t]*[-*+][ \t]+([A-Z])[.)][ \t]+({_EDGE})[ \t]*$"
    like = r"^[ \t]*[0-9]+[.)](?:[ \t]+(.*)|(\[.*))?$"
    return f"""{source},
sl AS (SELECT key, generate_subscripts(x, 1) AS line, unnest(x) AS t FROM (SELECT key, string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10)) AS x FROM src WHERE text IS NOT NULL)),
fc AS (SELECT key, line, f, trim(t, ' ' || chr(9)) AS bare, row_number() OVER (PARTITION BY key ORDER BY line) AS i FROM (SELECT *, regexp_extract(t, '^[ \\t]*(`{{3,}}|~{{3,}}).*$', 1) AS f FROM sl) WHERE f <> ''),
st AS (SELECT key, i, line, f AS mark, line AS since FROM fc WHERE i = 1
  UNION ALL SELECT fc.key, fc.i, fc.line, CASE WHEN st.mark IS NULL THEN fc.f WHEN fc.f[1] = st.mark[1] AND length(fc.bare) >= length(st.mark) AND replace(fc.bare, st.mark[1], '') = '' THEN NULL ELSE st.mark END, CASE WHEN st.mark IS NULL THEN fc.line ELSE st.since END
  FROM st JOIN fc ON fc.key = st.key AND fc.i = st.i + 1),
open AS (SELECT key, arg_max(since, i) AS line FROM st GROUP BY key HAVING arg_max(CASE WHEN mark IS NULL THEN 'shut' ELSE 'open' END, i) = 'open'),
vis AS (SELECT sl.key, sl.line, sl.t FROM sl ASOF LEFT JOIN st ON sl.key = st.key AND sl.line > st.line WHERE st.mark IS NULL),
cl AS (SELECT *, CASE WHEN regexp_matches(t, '^[ \\t]*(`{{3,}}|~{{3,}})') THEN 'FENCE' WHEN regexp_matches(t, '{header}') THEN 'HEADER' WHEN regexp_matches(t, '{like}') THEN 'QLIKE' WHEN regexp_matches(t, '{option}') THEN 'OPTION'
  WHEN regexp_matches(t, '^[ \\t]*[-*+][ \\t]+[a-z][.)][ \\t]+{_EDGE}[ \\t]*$') THEN 'LOWER' WHEN regexp_matches(t, '^[ \\t]*[-*+][ \\t]+[A-Za-z][.)]') THEN 'OPTLIKE' WHEN regexp_full_match(t, '[ \\t]*') THEN 'BLANK' ELSE 'OTHER' END AS class FROM vis),
bl AS (SELECT *, sum(CASE WHEN class IN ('HEADER', 'QLIKE') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY line) AS block FROM cl),
hd AS (SELECT *, first_value(class) OVER (PARTITION BY key, block ORDER BY line) AS head, min(line) OVER (PARTITION BY key, block) AS head_line, sum(CASE WHEN class = 'OPTION' THEN 1 ELSE 0 END) OVER (PARTITION BY key, block ORDER BY line) AS nth, coalesce(nullif(regexp_extract(t, '{like}', 1), ''), regexp_extract(t, '{like}', 2)) AS rest FROM bl),
ft AS (SELECT *, CASE WHEN block = 0 AND class IN ('OPTION', 'LOWER', 'OPTLIKE') THEN 'outside' WHEN block > 0 AND head = 'QLIKE' AND line = head_line THEN CASE WHEN regexp_matches(rest, '^\\[[^\\]]*\\]') AND NOT starts_with(rest, '[single_choice]') THEN 'type' ELSE 'header' END
  WHEN head <> 'HEADER' OR block = 0 THEN NULL WHEN class = 'LOWER' OR (class = 'OPTION' AND ascii(regexp_extract(t, '{option}', 1)) - 64 <> nth) THEN 'options' WHEN class = 'OPTLIKE' THEN 'malformed' WHEN class IN ('OTHER', 'FENCE') THEN 'unknown' END AS fault FROM hd),
bs AS (SELECT key, block, min(head) AS head, min(head_line) AS head_line, arg_min(fault, line) FILTER (fault IS NOT NULL) AS fault, min(line) FILTER (fault IS NOT NULL) AS fault_line, count(*) FILTER (class = 'OPTION') AS n_options, any_value(t) FILTER (line = head_line) AS t FROM ft WHERE block > 0 GROUP BY 1, 2),
bq AS (SELECT *, coalesce(fault, CASE WHEN head = 'HEADER' AND n_options < 2 THEN 'options' END) AS why FROM bs),
fd AS (SELECT key, CASE WHEN why = 'options' THEN head_line ELSE fault_line END AS line, why FROM bq WHERE why IS NOT NULL UNION ALL SELECT key, line, fault FROM ft WHERE fault = 'outside' UNION ALL SELECT key, line, 'fence' FROM open),
qs AS (SELECT key, regexp_extract(t, '{header}', 1) AS display_number, regexp_extract(t, '{header}', 2) AS stem, head_line, n_options FROM bq WHERE why IS NULL)"""


_SUMMARY = "CASE why " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in strict.SUMMARIES.items()) + " END"
_CODE = "CASE WHEN why = 'type' THEN 'QB-TYPE-UNSUPPORTED' ELSE 'QB-STRUCTURE-AMBIGUOUS' END"
_BANK_STRICT, _DOC_STRICT = _strict_sql(_STRICT_TEXTS), _strict_sql("src AS (SELECT doc_id AS key, text FROM documents)")


@query(f"WITH RECURSIVE {_BANK_STRICT} SELECT key AS question_id, display_number, stem, CAST(head_line AS INTEGER) AS header_line, CAST(n_options AS INTEGER) AS n_options FROM qs")
def strict_questions(spark, sf):
    q, _, _ = strict.strict_parse(strict_texts(spark, sf), "question_id", "text")
    return q.select("question_id", "display_number", "stem", "header_line", F.size("options").alias("n_options"))


@query(f"WITH RECURSIVE {_BANK_STRICT} SELECT key AS question_id, CAST(line AS INTEGER) AS line, {_CODE} AS code, {_SUMMARY} AS summary FROM fd")
def strict_findings(spark, sf):
    _, f, _ = strict.strict_parse(strict_texts(spark, sf), "question_id", "text")
    return f


_REPORT = """rp AS (SELECT d.key, (SELECT count(*) FROM qs WHERE qs.key = d.key) AS accepted, (SELECT count(*) FROM bq WHERE bq.key = d.key AND why IS NOT NULL) AS rejected, (SELECT count(*) FROM bq WHERE bq.key = d.key) AS question_like, (SELECT count(*) FROM fd WHERE fd.key = d.key) AS n_findings FROM (SELECT DISTINCT key FROM sl) d)"""


@query(f"WITH RECURSIVE {_DOC_STRICT}, {_REPORT} SELECT key AS doc_id, accepted, rejected, question_like, n_findings, accepted > 0 AND n_findings = 0 AS publishable FROM rp")
def strict_report(spark, sf):
    """Documents as they stand: which would parse."""
    _, _, r = strict.strict_parse(load(spark, sf, "documents"), "doc_id", "text")
    return r


@query(f"""WITH RECURSIVE {_DOC_STRICT}, {_REPORT}, al AS (SELECT key, line, {_CODE} AS code, {_SUMMARY} AS summary FROM fd UNION ALL SELECT key, 1, 'QB-STRUCTURE-AMBIGUOUS', 'No supported single-choice questions were found.' FROM rp WHERE accepted = 0 AND n_findings = 0)
SELECT key AS doc_id, code, CASE code WHEN 'QB-TYPE-UNSUPPORTED' THEN 'blocking' ELSE 'review_required' END AS blocking_level, 'line:' || line AS locator, summary, CASE code WHEN 'QB-TYPE-UNSUPPORTED' THEN 'retain,mark unsupported' ELSE 'correct source,retain,exclude' END AS actions FROM al""")
def strict_issues(spark, sf):
    """The issues that the documents would open."""
    _, f, r = strict.strict_parse(load(spark, sf, "documents"), "doc_id", "text")
    return strict.parse_issues(f, r, "doc_id").select("doc_id", "code", "blocking_level", "locator", "summary", F.array_join("allowed_user_actions", ",").alias("actions"))


_KEYS = "k AS (SELECT DISTINCT entry_id, source_id, question_number, raw_answer, raw_entry FROM answer_key_entries)"
_STRICT = _re2(E.STRICT_LINE)


def _entries(spark, sf):
    return load(spark, sf, "answer_key_entries").select("entry_id", "source_id", "question_number", "raw_answer", "raw_entry").distinct()


@query(f"""WITH {_KEYS}, l AS (SELECT entry_id, generate_subscripts(x, 1) AS line, unnest(x) AS t FROM (SELECT entry_id, string_split(regexp_replace(raw_entry, '\\r\\n|\\r', chr(10), 'g'), chr(10)) AS x FROM k WHERE raw_entry IS NOT NULL)),
m AS (SELECT *, nullif(regexp_extract(t, '{_STRICT}', 2), '') AS label, TRY_CAST(nullif(regexp_extract(t, '{_STRICT}', 1), '') AS BIGINT) AS number FROM l WHERE regexp_matches(t, '[^{T.WHITE}]'))
SELECT entry_id, CAST(line AS INTEGER) AS line, number AS question_number, label, sha256('m3-answer-evidence-v1' || chr(0) || number || chr(0) || label) AS fingerprint FROM m QUALIFY count_if(label IS NULL) OVER (PARTITION BY entry_id) = 0""")
def answer_lines_strict(spark, sf):
    good, _ = E.strict_answers(_entries(spark, sf), "entry_id", "raw_entry")
    return good


_NE, _IN, _BR = _re2(E.NUMBERED), _re2(E.INLINE), _re2(E.BRACKETED)


@query(f"""WITH {_KEYS}, l AS (SELECT entry_id, generate_subscripts(x, 1) AS line, unnest(x) AS t FROM (SELECT entry_id, string_split(regexp_replace(raw_entry, '\\r\\n|\\r', chr(10), 'g'), chr(10)) AS x FROM k WHERE raw_entry IS NOT NULL)),
m AS (SELECT *, CASE WHEN regexp_full_match(regexp_replace(t, '{_NE}', '', 'g'), '[ \\t;；,，]*') THEN regexp_extract_all(t, '{_NE}', 3) ELSE [] END AS answers, CASE WHEN regexp_full_match(regexp_replace(t, '{_NE}', '', 'g'), '[ \\t;；,，]*') THEN regexp_extract_all(t, '{_NE}', 1) ELSE [] END AS numbers,
  coalesce(nullif(regexp_extract(t, '{_IN}', 1), ''), nullif(regexp_extract(t, '{_BR}', 1), '')) AS inl FROM l WHERE regexp_matches(t, '[^{T.WHITE}]')),
e AS (SELECT *, generate_subscripts(CASE WHEN len(answers) > 0 THEN answers ELSE [NULL] END, 1) AS entry, unnest(CASE WHEN len(answers) > 0 THEN answers ELSE [NULL] END) AS answer, unnest(CASE WHEN len(answers) > 0 THEN numbers ELSE [NULL] END) AS number FROM m),
r AS (SELECT *, coalesce(answer, inl, {_strip('t')}) AS raw_answer, regexp_replace(coalesce(answer, inl, {_strip('t')}), '[ \\t、,，;；/]', '', 'g') AS compact FROM e),
s AS (SELECT *, CASE WHEN (len(answers) > 0 OR inl IS NOT NULL) AND regexp_full_match(compact, '[A-Za-z]+') THEN upper(compact) ELSE '' END AS labels FROM r),
z AS (SELECT *, CASE WHEN len(answers) >= 2 THEN 'ANSWER_KEY_BLOCK' WHEN len(answers) = 1 THEN 'NUMBERED_ANSWER' WHEN inl IS NULL THEN 'UNRESOLVED_ANSWER' WHEN raw_answer IN ('正确', '错误', '√', '×') THEN 'JUDGMENT_ANSWER' WHEN labels = '' THEN 'TEXT_ANSWER' ELSE 'UNRESOLVED_ANSWER' END AS kind FROM s)
SELECT entry_id, CAST(line AS INTEGER) AS line, CAST(entry AS INTEGER) AS entry, kind, TRY_CAST(number AS BIGINT) AS question_number, raw_answer, labels, CASE WHEN len(answers) > 0 THEN 'high' WHEN kind IN ('JUDGMENT_ANSWER', 'TEXT_ANSWER') THEN 'runtime_only' ELSE 'low' END AS confidence FROM z""")
def answer_lines_rich(spark, sf):
    d = E.rich_answers(_entries(spark, sf), "entry_id", "raw_entry")
    return d.withColumn("labels", F.array_join("labels", ""))


def _questions(spark, sf) -> DataFrame:
    """Bank questions numbered by the number in their locator."""
    q = load(spark, sf, "question_bank").select("question_id", "source_reference.source_id", "source_reference.locator", F.array_sort(F.array_distinct(F.col("options.label"))).alias("labels")).distinct()
    return q.select("question_id", "source_id", F.nullif(F.regexp_extract("locator", r"([0-9]+)\z", 1), F.lit("")).cast("bigint").alias("question_number"), "labels")


def _single(spark, sf) -> DataFrame:
    e = _entries(spark, sf).select("source_id", F.col("question_number").cast("bigint").alias("question_number"), choice_label(F.col("raw_answer")).alias("label"), F.col("entry_id").alias("locator"))
    return e.where("label IS NOT NULL AND question_number IS NOT NULL")


_ASSOC = f"""{_KEYS}, q AS (SELECT DISTINCT question_id, source_reference.source_id AS source_id, TRY_CAST(nullif(regexp_extract(source_reference.locator, '([0-9]+)\\z', 1), '') AS BIGINT) AS question_number, list_sort(list_distinct(list_transform(options, lambda o: o.label))) AS labels FROM question_bank),
ev AS (SELECT source_id, CAST(question_number AS BIGINT) AS question_number, upper({_strip('raw_answer')}) AS label FROM k WHERE question_number IS NOT NULL AND upper({_strip('raw_answer')}) IN ('A', 'B', 'C', 'D', 'E')),
g AS (SELECT source_id, question_number, list_sort(list_distinct(list(label))) AS found, count(*) AS n_evidence FROM ev GROUP BY 1, 2),
j AS (SELECT q.*, g.found, g.n_evidence, count(*) OVER (PARTITION BY q.source_id, q.question_number) AS same FROM q LEFT JOIN g ON q.source_id = g.source_id AND q.question_number = g.question_number),
c AS (SELECT *, CASE WHEN question_number IS NULL OR same > 1 THEN 'low_confidence' WHEN found IS NULL THEN 'missing' WHEN len(found) > 1 OR len(list_filter(found, lambda x: NOT coalesce(list_contains(labels, x), false))) > 0 THEN 'conflict' ELSE 'confirmable' END AS conclusion FROM j)"""


@query(f"WITH {_ASSOC} SELECT source_id, question_id, question_number, conclusion, CASE WHEN conclusion = 'confirmable' THEN found[1] END AS label, coalesce(n_evidence, 0) AS n_evidence FROM c")
def answer_association(spark, sf):
    return E.associate(_questions(spark, sf), _single(spark, sf))[0]


@query(f"WITH {_ASSOC} SELECT source_id, question_number, n_evidence FROM g WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.source_id = g.source_id AND q.question_number = g.question_number)")
def source_low_confidence(spark, sf):
    return E.associate(_questions(spark, sf), _single(spark, sf))[1]


@query(f"WITH {_ASSOC} SELECT c.question_id, ev.label, coalesce(list_contains(c.labels, ev.label), false) AS known, count(*) AS n_evidence FROM c JOIN ev ON c.source_id = ev.source_id AND c.question_number = ev.question_number WHERE conclusion = 'conflict' GROUP BY 1, 2, 3")
def association_alternatives(spark, sf):
    return E.alternatives(_questions(spark, sf), _single(spark, sf)).withColumn("known", F.coalesce("known", F.lit(False)))


@query("""WITH r AS (SELECT DISTINCT review_id, candidate_id, issue_code FROM review_queue)
SELECT review_id, sha256('{"candidate_id":' || coalesce(CAST(to_json(candidate_id) AS VARCHAR), 'null') || ',"issue_code":' || coalesce(CAST(to_json(issue_code) AS VARCHAR), 'null') || '}') AS issue_key FROM r""")
def issue_keys(spark, sf):
    r = load(spark, sf, "review_queue").select("review_id", "candidate_id", "issue_code").distinct()
    return E.issue_keys(r, "candidate_id", "issue_code").select("review_id", "issue_key")


@query("""WITH r AS (SELECT DISTINCT review_id, candidate_id, issue_code, status, recorded_at FROM review_queue)
SELECT review_id, candidate_id, issue_code, lag(review_id) OVER w AS supersedes, lag(status) OVER w <> 'open' AS closed_before FROM r WHERE candidate_id IS NOT NULL WINDOW w AS (PARTITION BY candidate_id, issue_code ORDER BY recorded_at, review_id)""")
def review_supersession(spark, sf):
    r = load(spark, sf, "review_queue").where("candidate_id IS NOT NULL").select("review_id", "candidate_id", "issue_code", "status", "recorded_at").distinct()
    return registry.supersession(r, ["candidate_id", "issue_code"], ["recorded_at", "review_id"])


def _scans(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The registry, and a scan derived from it: removed sources are gone, some files are moved or changed by their hash."""
    s = load(spark, sf, "sources").select("source_id", F.col("current_relative_path").alias("path"), F.col("path_history").alias("history"), F.col("current_content_hash").alias("hash"), "revision", "removed_at").distinct()
    first = F.substring("hash", 1, 1)
    now = s.where("removed_at IS NULL").select(F.when(first.isin("0", "1", "2"), F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), F.when(first == "3", F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash"))
    return s.drop("removed_at"), now


_SCAN = """s AS (SELECT DISTINCT source_id, current_relative_path AS path, path_history AS history, current_content_hash AS hash, revision, removed_at FROM sources),
cur AS (SELECT CASE WHEN hash[1] IN ('0', '1', '2') THEN 'moved/' || path ELSE path END AS path, min(CASE WHEN hash[1] = '3' THEN sha256(hash) ELSE hash END) AS hash FROM s WHERE removed_at IS NULL AND hash IS NOT NULL GROUP BY 1),
kept AS (SELECT s.source_id, s.path, s.history, cur.hash, s.revision + CASE WHEN s.hash IS NOT DISTINCT FROM cur.hash THEN 0 ELSE 1 END AS revision, 'present' AS presence, CASE WHEN s.hash IS NOT DISTINCT FROM cur.hash THEN 'unchanged' ELSE 'changed' END AS change FROM s JOIN cur USING (path)),
lost AS (SELECT * FROM s WHERE path IS NULL OR path NOT IN (SELECT path FROM cur)), fresh AS (SELECT * FROM cur WHERE path NOT IN (SELECT path FROM s WHERE path IS NOT NULL)),
sh AS (SELECT hash, count(DISTINCT source_id) AS n_old, (SELECT count(*) FROM fresh f WHERE f.hash = lost.hash) AS n_new FROM lost WHERE hash IN (SELECT hash FROM fresh) GROUP BY hash),
mv AS (SELECT sh.hash, f.path AS to_path FROM sh JOIN fresh f USING (hash) WHERE n_old = 1 AND n_new = 1)"""


@query(f"""WITH {_SCAN},
allrows AS (SELECT source_id, path, history, hash, revision, presence, change FROM kept
UNION ALL SELECT source_id, to_path, CASE WHEN history[-1] IS NOT DISTINCT FROM to_path THEN history ELSE list_append(history, to_path) END, hash, revision, 'present', 'renamed' FROM lost JOIN mv USING (hash)
UNION ALL SELECT source_id, path, history, hash, revision, 'missing', 'missing' FROM lost WHERE hash IS NULL OR hash NOT IN (SELECT hash FROM mv)
UNION ALL SELECT NULL, path, [path], hash, 1, 'present', 'new' FROM fresh WHERE hash NOT IN (SELECT hash FROM mv))
SELECT CASE WHEN change <> 'new' THEN source_id END AS source_id, path, array_to_string(history, '|') AS history, hash, revision, presence, change FROM allrows""")
def registry_reconcile(spark, sf):
    new, _ = registry.reconcile(*_scans(spark, sf))
    return new.select(F.when(F.col("change") != "new", F.col("source_id")).alias("source_id"), "path", F.array_join("history", "|").alias("history"), "hash", "revision", "presence", "change")


@query(f"WITH {_SCAN} SELECT 'QB-IDENTITY-AMBIGUOUS' AS code, hash, n_old, n_new FROM sh WHERE n_old > 1 OR n_new > 1")
def registry_ambiguity(spark, sf):
    return registry.reconcile(*_scans(spark, sf))[1].select("code", "hash", "n_old", "n_new")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT source_id, path_history FROM sources), n AS (SELECT source_id || '#' || i AS key, source_id || '#' || (i - 1) AS parent FROM (SELECT source_id, unnest(generate_series(2, len(path_history))) AS i FROM e)),
p AS (SELECT key, parent AS ancestor, 1 AS distance FROM n UNION ALL SELECT p.key, n.parent, p.distance + 1 FROM p JOIN n ON p.ancestor = n.key) SELECT key, ancestor, distance FROM p""")
def path_ancestry(spark, sf):
    """The places of a source as a parent-linked chain, closed over its ancestors."""
    s = load(spark, sf, "sources").select("source_id", "path_history").distinct().where("size(path_history) > 1")
    n = s.select("source_id", F.explode(F.sequence(F.lit(2), F.size("path_history"))).alias("i"))
    chain = n.select(F.concat_ws("#", "source_id", "i").alias("key"), F.concat_ws("#", "source_id", F.col("i") - 1).alias("parent"))
    return registry.ancestry(chain, "key", "parent")


@query("""WITH d AS (SELECT DISTINCT decision_id, candidate_id, decision_type, status, recorded_at FROM decisions), a AS (SELECT *, CASE WHEN status = 'archived' THEN 'needs_revalidation' ELSE status END AS st FROM d WHERE recorded_at < TIMESTAMP '2024-07-01'),
b AS (SELECT * FROM d WHERE NOT (status = 'needs_revalidation' AND recorded_at < TIMESTAMP '2024-01-01'))
SELECT coalesce(a.decision_id, b.decision_id) AS decision_id, CASE WHEN a.decision_id IS NULL THEN 'added' WHEN b.decision_id IS NULL THEN 'removed' WHEN (a.candidate_id, a.decision_type) IS DISTINCT FROM (b.candidate_id, b.decision_type) THEN 'altered' WHEN a.st IS DISTINCT FROM b.status THEN 'moved' ELSE 'same' END AS change, a.st AS from_state, b.status AS to_state
FROM a FULL OUTER JOIN b ON a.decision_id = b.decision_id""")
def snapshot_diff(spark, sf):
    """An earlier state of the decisions against a later one."""
    d = load(spark, sf, "decisions").select("decision_id", "candidate_id", "decision_type", "status", "recorded_at").distinct()
    a = d.where("recorded_at < TIMESTAMP '2024-07-01'").withColumn("status", F.when(F.col("status") == "archived", "needs_revalidation").otherwise(F.col("status")))
    b = d.where("NOT (status = 'needs_revalidation' AND recorded_at < TIMESTAMP '2024-01-01')")
    return registry.snapshot_diff(a, b, "decision_id", ["candidate_id", "decision_type"], "status")


@query("""WITH s AS (SELECT DISTINCT source_id, revision FROM sources), c AS (SELECT DISTINCT candidate_id, candidate_revision, source_id, question_type, status FROM candidates), ids AS (SELECT DISTINCT candidate_id FROM c),
o AS (SELECT DISTINCT candidate_id, o.option_id AS option_id, o.candidate_id AS owner, o.source_ref.source_id AS source_id FROM (SELECT candidate_id, unnest(options) AS o FROM candidates)),
d AS (SELECT DISTINCT decision_id, candidate_id, candidate_revision, decision_type, value, evidence, status FROM decisions), r AS (SELECT DISTINCT review_id, candidate_id FROM review_queue),
j AS (SELECT d.*, c.candidate_revision AS now, c.question_type FROM d JOIN c USING (candidate_id)),
ev AS (SELECT DISTINCT x.decision_id, x.e.source_id AS source_id, x.e.source_revision AS source_revision, s.revision FROM (SELECT decision_id, unnest(evidence) AS e FROM j) x LEFT JOIN s ON s.source_id = x.e.source_id),
a AS (SELECT * FROM j WHERE decision_type = 'answer_resolution'), ow AS (SELECT option_id, max(candidate_id) AS owner FROM o GROUP BY 1),
p AS (SELECT DISTINCT x.decision_id, x.candidate_id, x.option_id, ow.owner FROM (SELECT decision_id, candidate_id, unnest(value.resolved_option_ids) AS option_id FROM a WHERE question_type <> 'true_false') x LEFT JOIN ow USING (option_id)),
v AS (
SELECT 'QB-CANDIDATE-ID-DUPLICATE' AS code, candidate_id AS record_id FROM c GROUP BY candidate_id HAVING count(*) > 1
UNION ALL SELECT 'QB-SOURCE-REFERENCE-MISSING', candidate_id FROM c WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM s)
UNION ALL SELECT 'QB-SOURCE-REFERENCE-MISSING', option_id FROM o WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM s)
UNION ALL SELECT 'QB-OPTION-OWNERSHIP-INVALID', option_id FROM o WHERE owner <> candidate_id
UNION ALL SELECT 'QB-OPTION-ID-DUPLICATE', option_id FROM o GROUP BY option_id HAVING count(DISTINCT candidate_id) > 1
UNION ALL SELECT 'QB-CANDIDATE-REFERENCE-MISSING', review_id FROM r WHERE candidate_id IS NOT NULL AND candidate_id NOT IN (SELECT candidate_id FROM ids)
UNION ALL SELECT 'QB-CANDIDATE-REFERENCE-MISSING', decision_id FROM d WHERE candidate_id IS NOT NULL AND candidate_id NOT IN (SELECT candidate_id FROM ids)
UNION ALL SELECT 'QB-DECISION-REVISION-STALE', decision_id FROM j WHERE candidate_revision <> now
UNION ALL SELECT DISTINCT 'QB-EVIDENCE-REFERENCE-MISSING', decision_id FROM ev WHERE revision IS NULL
UNION ALL SELECT DISTINCT 'QB-EVIDENCE-REVISION-INVALID', decision_id FROM ev WHERE source_revision > revision
UNION ALL SELECT 'QB-TRUE-FALSE-VALUE-INVALID', decision_id FROM a WHERE question_type = 'true_false' AND (value.boolean_value IS NULL OR value.source_lexeme IS NULL)
UNION ALL SELECT 'QB-ANSWER-SHAPE-INVALID', decision_id FROM a WHERE question_type <> 'true_false' AND value.resolved_option_ids IS NULL
UNION ALL SELECT 'QB-ANSWER-CARDINALITY-INVALID', decision_id FROM a WHERE (question_type = 'single_choice' AND len(value.resolved_option_ids) <> 1) OR (question_type = 'multiple_choice' AND (len(value.resolved_option_ids) < 2 OR len(list_distinct(value.resolved_option_ids)) <> len(value.resolved_option_ids)))
UNION ALL SELECT DISTINCT 'QB-OPTION-REFERENCE-MISSING', decision_id FROM p WHERE owner IS NULL
UNION ALL SELECT DISTINCT 'QB-OPTION-OWNERSHIP-INVALID', decision_id FROM p WHERE owner <> candidate_id
UNION ALL SELECT 'QB-VALIDATED-GATE-FAILED', candidate_id FROM c WHERE status = 'validated' AND candidate_id NOT IN (SELECT candidate_id FROM a WHERE status = 'valid' AND candidate_revision = now))
SELECT code, record_id FROM v""")
def bundle_integrity(spark, sf):
    return integrity.bundle_violations(*(load(spark, sf, t) for t in ("sources", "candidates", "review_queue", "decisions")))


def _bank_rows(spark, sf) -> DataFrame:
    return load(spark, sf, "question_bank").select("question_id", "question_type", "stem", "options", "chapter", "explanation", "answer_label", "answer_labels", "answer_bool").distinct()


_LABEL = "upper(" + _strip("o.label") + ")"
_OPTS = ", ".join(f"coalesce(list_filter(options, lambda o: {_LABEL} = '{x}')[1].text, '') AS option_{x.lower()}" for x in "ABCDE")


@query(f"""WITH q AS (SELECT DISTINCT question_id, question_type, stem, options, chapter, explanation, answer_label, answer_labels, answer_bool FROM question_bank),
a AS (SELECT *, list_transform(options, lambda o: coalesce({_LABEL}, '')) AS ls, CASE WHEN answer_label IS NULL AND answer_labels IS NULL AND answer_bool IS NULL THEN ''
  WHEN question_type = 'single_choice' THEN CASE WHEN upper({_strip('answer_label')}) IN ('A', 'B', 'C', 'D', 'E') THEN upper({_strip('answer_label')}) END
  WHEN question_type = 'multiple_choice' THEN CASE WHEN len(answer_labels) > 0 AND len(list_filter(answer_labels, lambda x: coalesce(upper({_strip('x')}) NOT IN ('A', 'B', 'C', 'D', 'E'), true))) = 0 THEN array_to_string(list_sort(list_distinct(list_transform(answer_labels, lambda x: upper({_strip('x')})))), '') END
  WHEN question_type = 'true_false' THEN CASE WHEN answer_bool THEN '正确' WHEN NOT answer_bool THEN '错误' END END AS correct_answer FROM q),
g AS (SELECT * FROM a WHERE question_type IN ('single_choice', 'multiple_choice', 'true_false') AND correct_answer IS NOT NULL AND (ls IS NULL OR (len(list_filter(ls, lambda x: x NOT IN ('A', 'B', 'C', 'D', 'E'))) = 0 AND len(list_distinct(ls)) = len(ls))))
SELECT row_number() OVER (ORDER BY question_id) AS sequence_number, coalesce(chapter, '') AS paper_or_chapter, CASE question_type WHEN 'single_choice' THEN '单选题' WHEN 'multiple_choice' THEN '多选题' ELSE '判断题' END AS question_type, stem, {_OPTS}, correct_answer, coalesce(explanation, '') AS explanation FROM g""")
def csv_projection(spark, sf):
    return X.csv_rows(_bank_rows(spark, sf), ["question_id"]).drop("question_id")


_CSV = "c AS (SELECT DISTINCT csv_row_id, sequence_number, question_type, correct_answer FROM standard_bank_rows)"


@query(f"""WITH {_CSV}, m AS (SELECT *, upper(regexp_replace(correct_answer, '[ \\t\\r\\n,;|/]', '', 'g')) AS s, lower({_strip('correct_answer')}) AS w FROM c)
SELECT csv_row_id, CASE WHEN upper({_strip('correct_answer')}) IN ('A', 'B', 'C', 'D', 'E') THEN upper({_strip('correct_answer')}) END AS single,
CASE WHEN regexp_full_match(s, '[A-E]+') THEN CASE WHEN contains(s, 'A') THEN 'A' ELSE '' END || CASE WHEN contains(s, 'B') THEN 'B' ELSE '' END || CASE WHEN contains(s, 'C') THEN 'C' ELSE '' END || CASE WHEN contains(s, 'D') THEN 'D' ELSE '' END || CASE WHEN contains(s, 'E') THEN 'E' ELSE '' END END AS multiple,
CASE WHEN w IN ('true', 't', '正确', '对') THEN '正确' WHEN w IN ('false', 'f', '错误', '错') THEN '错误' END AS judged FROM m""")
def answer_normalize(spark, sf):
    c = load(spark, sf, "standard_bank_rows").select("csv_row_id", "correct_answer").distinct()
    a = F.col("correct_answer")
    return c.select("csv_row_id", choice_label(a).alias("single"), multiple_choice(a).alias("multiple"), true_false(a).alias("judged"))


@query(f"""WITH {_CSV}, {_KEYS}, r AS (SELECT question_number, min(raw_answer) AS given FROM k WHERE question_number IS NOT NULL GROUP BY 1),
j AS (SELECT c.*, {_strip("coalesce(correct_answer, '')")} AS key, {_strip("coalesce(given, '')")} AS g FROM c JOIN r ON c.sequence_number = r.question_number),
x AS (SELECT question_type, CASE WHEN key <> '' THEN CASE WHEN question_type = '多选题' THEN list_sort(list_distinct(string_split(upper(regexp_replace(key, '[\\s,;|/]', '', 'g')), ''))) = list_sort(list_distinct(string_split(upper(regexp_replace(g, '[\\s,;|/]', '', 'g')), ''))) ELSE key = g END END AS ok FROM j)
SELECT question_type, count(ok) AS graded, count_if(ok) AS correct, count(ok) - count_if(ok) AS wrong, CASE WHEN count(ok) > 0 THEN round(100.0 * count_if(ok) / count(ok), 4) END AS accuracy FROM x GROUP BY 1""")
def grade_score(spark, sf):
    """Standard rows as the key, of the key entries of a number the least answer as the response (as its SQL says);
    grade_responses takes them all."""
    c = load(spark, sf, "standard_bank_rows").select("csv_row_id", "sequence_number", "question_type", "correct_answer").distinct()
    r = _entries(spark, sf).where("question_number IS NOT NULL").groupBy("question_number").agg(F.min("raw_answer").alias("given"))
    j = c.join(r, c["sequence_number"] == r["question_number"])
    return X.score(X.grade(j, "correct_answer", "given", "question_type"), "question_type")


@query(f"""WITH {_CSV}, {_KEYS}, j AS (SELECT c.*, {_strip("coalesce(correct_answer, '')")} AS key, {_strip("coalesce(raw_answer, '')")} AS g FROM c JOIN k ON c.sequence_number = k.question_number),
x AS (SELECT question_type, CASE WHEN key <> '' THEN CASE WHEN question_type = '多选题' THEN list_sort(list_distinct(string_split(upper(regexp_replace(key, '[\\s,;|/]', '', 'g')), ''))) = list_sort(list_distinct(string_split(upper(regexp_replace(g, '[\\s,;|/]', '', 'g')), ''))) ELSE key = g END END AS ok FROM j)
SELECT question_type, count(ok) AS graded, count_if(ok) AS correct, count(ok) - count_if(ok) AS wrong, CASE WHEN count(ok) > 0 THEN round(100.0 * count_if(ok) / count(ok), 4) END AS accuracy FROM x GROUP BY 1""")
def grade_responses(spark, sf):
    """Standard rows as the key, every key entry of the same number as a response.

    Equal keys and equal responses of a number are counted first, so a common number joins its different answers only.
    """
    c = load(spark, sf, "standard_bank_rows").select("csv_row_id", "sequence_number", "question_type", "correct_answer").distinct()
    c = c.groupBy("sequence_number", "question_type", "correct_answer").agg(F.count(F.lit(1)).alias("n_keys"))
    r = _entries(spark, sf).where("question_number IS NOT NULL").groupBy("question_number", F.col("raw_answer").alias("given")).agg(F.count(F.lit(1)).alias("n_given"))
    j = c.join(r, c["sequence_number"] == r["question_number"]).withColumn("n", F.col("n_keys") * F.col("n_given"))
    return X.score(X.grade(j, "correct_answer", "given", "question_type"), "question_type", weight="n")


@query(f"""WITH {_KEYS}, q AS (SELECT DISTINCT question_id, source_reference.source_id AS source_id, TRY_CAST(nullif(regexp_extract(source_reference.locator, '([0-9]+)\\z', 1), '') AS BIGINT) AS question_number, list_sort(list_distinct(list_transform(options, lambda o: o.label))) AS labels FROM question_bank),
e AS (SELECT entry_id AS locator, source_id, CAST(question_number AS BIGINT) AS question_number, CASE WHEN regexp_full_match(regexp_replace(raw_answer, '[ \\t、,，;；/]', '', 'g'), '[A-Za-z]+') THEN upper(regexp_replace(raw_answer, '[ \\t、,，;；/]', '', 'g')) ELSE '' END AS labels FROM k),
n AS (SELECT source_id, question_number, count(*) AS same, min(labels) AS known FROM q WHERE question_number IS NOT NULL GROUP BY 1, 2), t AS (SELECT source_id, question_number, count(DISTINCT labels) AS n FROM e WHERE question_number IS NOT NULL GROUP BY 1, 2),
r AS (SELECT e.*, CASE WHEN e.question_number IS NULL THEN 'ANSWER_ATTACHMENT_UNCERTAIN' WHEN same IS NULL THEN 'QUESTION_NUMBER_UNRESOLVED' WHEN same > 1 THEN 'DUPLICATE_QUESTION_NUMBER' WHEN t.n > 1 THEN 'ANSWER_CONFLICT' WHEN e.labels = '' THEN 'RUNTIME_ONLY_ANSWER_KIND'
  WHEN len(list_filter(string_split(e.labels, ''), lambda x: NOT coalesce(list_contains(known, x), false))) > 0 THEN 'OPTION_LABEL_UNRESOLVED' WHEN length(e.labels) > 1 THEN 'MULTISELECT_NOT_ATTACHABLE' END AS reason
  FROM e LEFT JOIN n ON e.source_id = n.source_id AND e.question_number = n.question_number LEFT JOIN t ON e.source_id = t.source_id AND e.question_number = t.question_number)
SELECT source_id, question_number, locator, CASE WHEN reason IS NULL THEN 'ATTACHABLE' WHEN reason = 'ANSWER_CONFLICT' THEN 'CONFLICT' ELSE 'UNRESOLVED' END AS status, reason, labels FROM r""")
def rich_attachability(spark, sf):
    from stemloom.functions.answers import answer_labels

    e = _entries(spark, sf).select("source_id", F.col("question_number").cast("bigint").alias("question_number"), F.coalesce(answer_labels(F.col("raw_answer")), F.array().cast("array<string>")).alias("labels"), F.col("entry_id").alias("locator"))
    return E.attachability(_questions(spark, sf), e)
