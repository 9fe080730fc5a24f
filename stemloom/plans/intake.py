"""Queries of document checks, intake and matching over the test tables."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.functions import documents as D
from stemloom.operators import intake as I
from stemloom.plans.curation import _strip
from stemloom.session import load, materialize

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# The rules of a bank document.
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
_ID, _TEXT, _FILLED = {"type": "string", "pattern": UUID}, {"type": "string"}, {"type": "string", "minLength": 1}
BANK_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["schema_version", "bank_id", "title", "questions", "sources"],
    "properties": {
        "schema_version": {"const": "1.0"}, "bank_id": _ID, "title": _FILLED,
        "questions": {"type": "array", "minItems": 1, "items": {
            "type": "object", "additionalProperties": False, "required": ["question_id", "question_revision", "question_type", "stem", "options", "source_reference", "status"],
            "properties": {
                "question_id": _ID, "question_revision": {"type": "integer", "minimum": 1}, "question_type": {"enum": ["single_choice", "multiple_choice", "true_false"]}, "stem": _TEXT, "status": _TEXT,
                "options": {"type": "array", "items": {"type": "object", "additionalProperties": False, "required": ["label", "text", "source_option_id"], "properties": {"label": _FILLED, "text": _TEXT, "source_option_id": _ID}}},
                "source_reference": {"type": "object", "required": ["source_id", "locator"], "properties": {"source_id": _ID, "locator": _FILLED}},
                "chapter": _TEXT, "metadata": {"type": "object"}, "answer": {}, "explanation": _TEXT,
            }}},
        "sources": {"type": "array", "minItems": 1, "items": {
            "type": "object", "additionalProperties": False, "required": ["source_id", "source_file", "source_type"],
            "properties": {"source_id": _ID, "source_file": _FILLED, "source_type": {"enum": ["pdf", "docx", "image", "text", "markdown", "structured"]}}}},
    },
}


def bank_rules(bank) -> Iterator[tuple[str, str]]:
    """(path, rule) of what the schema cannot say: ids and labels once each, known sources, relative files, labels by type."""
    def items(x, name: str) -> list[tuple[int, dict]]:
        found = x.get(name) if isinstance(x, dict) else None
        return [(i, v) for i, v in enumerate(found) if isinstance(v, dict)] if isinstance(found, list) else []

    def repeated(rows: list[tuple[int, dict]], field: str, path: str) -> Iterator[tuple[str, str]]:
        values = [r.get(field) for _, r in rows if isinstance(r.get(field), str)]
        return ((path, f"unique {field}") for v, n in Counter(values).items() if n > 1)

    sources = items(bank, "sources")
    yield from repeated(sources, "source_id", "$.sources")
    for i, s in sources:
        if re.match(r"/|\\\\|[A-Za-z]:[\\/]", str(s.get("source_file"))):
            yield f"$.sources[{i}].source_file", "relative"
    known = {s.get("source_id") for _, s in sources if isinstance(s.get("source_id"), str)}
    questions = items(bank, "questions")
    yield from repeated(questions, "question_id", "$.questions")
    for i, q in questions:
        path, reference, options = f"$.questions[{i}]", q.get("source_reference"), items(q, "options")
        source = reference.get("source_id") if isinstance(reference, dict) else None
        if isinstance(source, str) and source not in known:
            yield f"{path}.source_reference.source_id", "known"
        yield from repeated(options, "source_option_id", f"{path}.options")
        if q.get("question_type") == "true_false":
            if q.get("options"):
                yield f"{path}.options", "empty"
            continue
        yield from repeated(options, "label", f"{path}.options")
        yield from ((f"{path}.options[{j}].label", "choice label") for j, o in options if o.get("label") not in ("A", "B", "C", "D", "E"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# path, kinds allowed, members required, members allowed (null: any), rule of the value and its argument
_Q, _O = "$.questions[]", "$.questions[].options[]"
_SPEC = [
    ("$", "o", "schema_version,bank_id,title,questions,sources", "schema_version,bank_id,title,questions,sources", ""), ("$.schema_version", "", "", None, "const"), ("$.bank_id", "s", "", None, "uuid"), ("$.title", "s", "", None, "filled"),
    ("$.questions", "a", "", None, "items"), (_Q, "o", "question_id,question_revision,question_type,stem,options,source_reference,status", "question_id,question_revision,question_type,stem,options,source_reference,status,chapter,metadata,answer,explanation", ""),
    (f"{_Q}.question_id", "s", "", None, "uuid"), (f"{_Q}.question_revision", "i", "", None, "positive"), (f"{_Q}.question_type", "", "", None, "single_choice,multiple_choice,true_false"), (f"{_Q}.stem", "s", "", None, ""), (f"{_Q}.status", "s", "", None, ""),
    (f"{_Q}.options", "a", "", None, ""), (_O, "o", "label,text,source_option_id", "label,text,source_option_id", ""), (f"{_O}.label", "s", "", None, "filled"), (f"{_O}.text", "s", "", None, ""), (f"{_O}.source_option_id", "s", "", None, "uuid"),
    (f"{_Q}.source_reference", "o", "source_id,locator", None, ""), (f"{_Q}.source_reference.source_id", "s", "", None, "uuid"), (f"{_Q}.source_reference.locator", "s", "", None, "filled"),
    (f"{_Q}.chapter", "s", "", None, ""), (f"{_Q}.metadata", "o", "", None, ""), (f"{_Q}.explanation", "s", "", None, ""), ("$.sources", "a", "", None, "items"), ("$.sources[]", "o", "source_id,source_file,source_type", "source_id,source_file,source_type", ""),
    ("$.sources[].source_id", "s", "", None, "uuid"), ("$.sources[].source_file", "s", "", None, "filled"), ("$.sources[].source_type", "", "", None, "pdf,docx,image,text,markdown,structured"),
]
_SPEC_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in _SPEC)
_BANK_SQL = f"""WITH v AS MATERIALIZED (SELECT file_no, body FROM raw_banks WHERE body IS NOT NULL AND json_valid(body)),
t AS MATERIALIZED (SELECT v.file_no, t.key, t.value ->> '$' AS value, t.id, t.parent, t.fullkey, regexp_replace(t.fullkey, '\\[\\d+\\]', '[]', 'g') AS path,
  CASE t.type WHEN 'OBJECT' THEN 'o' WHEN 'ARRAY' THEN 'a' WHEN 'VARCHAR' THEN 's' WHEN 'BIGINT' THEN 'i' WHEN 'UBIGINT' THEN 'i' WHEN 'HUGEINT' THEN 'i' WHEN 'UHUGEINT' THEN 'i' WHEN 'NULL' THEN 'n' ELSE 'x' END AS kind FROM v, json_tree(v.body) t),
sp AS (SELECT * FROM (VALUES {_SPEC_ROWS}) s(path, kinds, needs, knows, rule)),
m AS (SELECT t.*, sp.kinds, sp.needs, sp.knows, sp.rule FROM t JOIN sp ON sp.path = t.path),
good AS (SELECT * FROM m WHERE kinds = '' OR kind = kinds),
ob AS (SELECT file_no, id, fullkey, path, kind FROM t WHERE kind = 'o'),
ch AS (SELECT o.file_no, o.id AS owner, o.fullkey AS above, o.path AS kin, c.key, c.value, c.kind, c.fullkey FROM ob o JOIN t c ON c.file_no = o.file_no AND c.parent = o.id),
qs AS (SELECT o.file_no, o.id, o.fullkey, (SELECT any_value(value) FROM ch WHERE ch.file_no = o.file_no AND ch.owner = o.id AND ch.key = 'question_type' AND ch.kind = 's') AS type FROM ob o WHERE path = '{_Q}'),
r AS (
  SELECT file_no, '$' AS path, 'json' AS rule FROM raw_banks WHERE body IS NOT NULL AND NOT json_valid(body)
  UNION ALL SELECT file_no, fullkey, 'type' FROM m WHERE kinds <> '' AND kind <> kinds
  UNION ALL SELECT g.file_no, g.fullkey || '.' || n, 'required' FROM (SELECT *, unnest(string_split(needs, ',')) AS n FROM good WHERE needs <> '') g WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.file_no = g.file_no AND c.parent = g.id AND c.key = g.n)
  UNION ALL SELECT g.file_no, g.fullkey || '.' || c.key, 'additionalProperties' FROM good g JOIN t c ON c.file_no = g.file_no AND c.parent = g.id WHERE g.knows IS NOT NULL AND NOT list_contains(string_split(g.knows, ','), c.key)
  UNION ALL SELECT file_no, fullkey, 'const' FROM good WHERE rule = 'const' AND NOT (kind = 's' AND value = '1.0')
  UNION ALL SELECT file_no, fullkey, 'pattern' FROM good WHERE rule = 'uuid' AND NOT regexp_full_match(value, '{UUID}')
  UNION ALL SELECT file_no, fullkey, 'minLength' FROM good WHERE rule = 'filled' AND value = ''
  UNION ALL SELECT file_no, fullkey, 'minimum' FROM good WHERE rule = 'positive' AND CAST(value AS DOUBLE) < 1
  UNION ALL SELECT file_no, fullkey, 'enum' FROM good WHERE contains(rule, ',') AND NOT (kind = 's' AND list_contains(string_split(rule, ','), value))
  UNION ALL SELECT g.file_no, g.fullkey, 'minItems' FROM good g WHERE rule = 'items' AND NOT EXISTS (SELECT 1 FROM t c WHERE c.file_no = g.file_no AND c.parent = g.id)
  UNION ALL SELECT file_no, '$.sources', 'unique source_id' FROM ch WHERE kin = '$.sources[]' AND key = 'source_id' AND kind = 's' GROUP BY file_no, value HAVING count(*) > 1
  UNION ALL SELECT file_no, '$.questions', 'unique question_id' FROM ch WHERE kin = '{_Q}' AND key = 'question_id' AND kind = 's' GROUP BY file_no, value HAVING count(*) > 1
  UNION ALL SELECT file_no, fullkey, 'relative' FROM ch WHERE kin = '$.sources[]' AND key = 'source_file' AND regexp_matches(value, '^(?:/|\\\\\\\\|[A-Za-z]:[\\\\/])')
  UNION ALL SELECT file_no, fullkey, 'known' FROM ch WHERE kin = '{_Q}.source_reference' AND key = 'source_id' AND kind = 's' AND NOT EXISTS (SELECT 1 FROM ch s WHERE s.file_no = ch.file_no AND s.kin = '$.sources[]' AND s.key = 'source_id' AND s.kind = 's' AND s.value = ch.value)
  UNION ALL SELECT file_no, regexp_replace(above, '\\[\\d+\\]$', ''), 'unique source_option_id' FROM ch WHERE kin = '{_O}' AND key = 'source_option_id' AND kind = 's' GROUP BY 1, 2, value HAVING count(*) > 1
  UNION ALL SELECT c.file_no, c.fullkey, 'empty' FROM qs q JOIN ch c ON c.file_no = q.file_no AND c.owner = q.id AND c.key = 'options' WHERE q.type = 'true_false' AND c.kind <> 'n' AND NOT coalesce(c.value IN ('[]', '{{}}', '', 'false', '0'), false)
  UNION ALL SELECT c.file_no, q.fullkey || '.options', 'unique label' FROM qs q JOIN ch c ON c.file_no = q.file_no AND c.kin = '{_O}' AND starts_with(c.above, q.fullkey || '.options[') AND c.key = 'label' AND c.kind = 's' WHERE q.type IS DISTINCT FROM 'true_false' GROUP BY 1, 2, c.value HAVING count(*) > 1
  UNION ALL SELECT o.file_no, o.fullkey || '.label', 'choice label' FROM qs q JOIN ob o ON o.file_no = q.file_no AND o.path = '{_O}' AND starts_with(o.fullkey, q.fullkey || '.options[') WHERE q.type IS DISTINCT FROM 'true_false'
    AND NOT EXISTS (SELECT 1 FROM ch c WHERE c.file_no = o.file_no AND c.owner = o.id AND c.key = 'label' AND c.kind = 's' AND c.value IN ('A', 'B', 'C', 'D', 'E')))
SELECT file_no, path, rule FROM r"""


@query(_BANK_SQL)
def bank_schema_violations(spark, sf):
    return D.schema_violations(load(spark, sf, "raw_banks"), "file_no", "body", BANK_SCHEMA, also=bank_rules)


def _canonical_sql(levels: int = 24) -> str:
    """The canonical form built from the deepest level up; `levels` is more than any document of the tables nests."""
    leaf = "CASE kind WHEN 's' THEN CAST(to_json(value) AS VARCHAR) WHEN 'n' THEN 'null' ELSE value END"
    parts = [f"c{levels} AS (SELECT file_no, id, parent, key, {leaf} AS canon FROM d WHERE depth = {levels})"]
    for n in range(levels - 1, -1, -1):
        parts.append(f"""g{n} AS (SELECT file_no, parent, string_agg(canon, ',' ORDER BY id) AS listed, string_agg(CAST(to_json(key) AS VARCHAR) || ':' || canon, ',' ORDER BY key) AS named FROM c{n + 1} GROUP BY 1, 2),
c{n} AS (SELECT d.file_no, d.id, d.parent, d.key, CASE kind WHEN 'o' THEN '{{' || coalesce(named, '') || '}}' WHEN 'a' THEN '[' || coalesce(listed, '') || ']' ELSE {leaf} END AS canon FROM d LEFT JOIN g{n} g ON g.file_no = d.file_no AND g.parent = d.id WHERE depth = {n})""")
    tree = _BANK_SQL[: _BANK_SQL.index("sp AS (")].replace("WITH v", "WITH RECURSIVE v")
    return f"""{tree} d AS MATERIALIZED (SELECT file_no, id, parent, key, value, kind, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.file_no, t.id, t.parent, t.key, t.value, t.kind, d.depth + 1 FROM d JOIN t ON t.file_no = d.file_no AND t.parent = d.id),
{", ".join(parts)} SELECT b.file_no, sha256(c0.canon) AS digest FROM raw_banks b LEFT JOIN c0 ON c0.file_no = b.file_no"""


@query(_canonical_sql())
def bank_digests(spark, sf):
    return load(spark, sf, "raw_banks").select("file_no", D.json_digest(F.col("body")).alias("digest"))


@query("""SELECT source_id, current_relative_path AS path, NOT regexp_matches(current_relative_path, '[\\\\:<>"|?*\\x{00}-\\x{1f}\\x{7f}-\\x{9f}]') AND len(list_filter(string_split(current_relative_path, '/'), lambda p: p IN ('', '.', '..') OR regexp_matches(p, '[. ]\\z')
OR regexp_full_match(lower(rtrim(string_split(p, '.')[1])), 'con|prn|aux|nul|conin[$]|conout[$]|(com|lpt)[1-9¹²³]'))) = 0 AS safe,
CASE WHEN microsecond(registered_at) % 1000000 = 0 THEN strftime(registered_at, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(registered_at, '%Y-%m-%dT%H:%M:%S.%fZ') END AS registered FROM (SELECT DISTINCT source_id, current_relative_path, registered_at FROM sources)""")
def source_paths(spark, sf):
    s = load(spark, sf, "sources").select("source_id", "current_relative_path", "registered_at").distinct()
    return s.select("source_id", F.col("current_relative_path").alias("path"), D.safe_relative_path(F.col("current_relative_path")).alias("safe"), D.utc_z(F.col("registered_at")).alias("registered"))


_X = """x AS (SELECT DISTINCT extract_no, batch_id, batch_position, question_type, stem, options, answer, explanation, chapter, source_reference, extraction_notes FROM extracted_questions),
a AS (SELECT *, CASE WHEN answer LIKE '"%' THEN answer::JSON ->> '$' END AS label, CASE WHEN answer LIKE '[%' THEN CAST(answer::JSON AS VARCHAR[]) END AS labels, CASE answer WHEN 'true' THEN true WHEN 'false' THEN false END AS flag, list_transform(options, lambda o: coalesce(o.label, '')) AS names FROM x)"""


@query(f"""WITH {_X}, v AS (
SELECT extract_no AS record_id, 'type' AS rule FROM a WHERE NOT coalesce(question_type IN ('single_choice', 'multiple_choice', 'true_false'), false)
UNION ALL SELECT extract_no, 'stem' FROM a WHERE coalesce({_strip('stem')} = '', true)
UNION ALL SELECT extract_no, 'option_count' FROM a WHERE CASE WHEN question_type = 'true_false' THEN len(options) <> 0 ELSE len(options) < 2 OR len(options) > 5 END
UNION ALL SELECT extract_no, 'option_labels' FROM a WHERE names <> ['A', 'B', 'C', 'D', 'E'][1:least(len(options), 5)]
UNION ALL SELECT extract_no, 'option_text' FROM a WHERE len(list_filter(options, lambda o: coalesce({_strip('o.text')} = '', true))) > 0
UNION ALL SELECT extract_no, 'answer' FROM a WHERE answer IS NOT NULL AND answer <> 'null' AND NOT coalesce(CASE question_type WHEN 'single_choice' THEN list_contains(names, label) WHEN 'true_false' THEN flag IS NOT NULL
  WHEN 'multiple_choice' THEN len(labels) >= 2 AND len(list_distinct(labels)) = len(labels) AND len(list_filter(labels, lambda l: NOT list_contains(names, l))) = 0 END, false)
UNION ALL SELECT extract_no, 'source' FROM a WHERE source_reference IS NULL OR coalesce({_strip('source_reference.source_id')} = '', true) OR coalesce({_strip('source_reference.locator')} = '', true))
SELECT record_id, rule FROM v""")
def extraction_violations(spark, sf):
    x = load(spark, sf, "extracted_questions").drop("ingested_at").distinct()
    return I.extraction_violations(x, "extract_no")


@query(f"""WITH {_X}, h AS (SELECT *, sha256(batch_id || chr(31) || batch_position) AS h FROM a)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS question_id, batch_id AS bank_id, question_type, stem, len(options) AS n_options,
coalesce(extraction_notes, '') AS notes, label AS answer_label, array_to_string(labels, '|') AS answer_labels, flag AS answer_bool FROM h""")
def compiled_questions(spark, sf):
    x = load(spark, sf, "extracted_questions").drop("ingested_at").distinct()
    q = I.compile_questions(x, "batch_id", "batch_position")
    return q.select("question_id", "bank_id", "question_type", "stem", F.size("options").cast("bigint").alias("n_options"), F.coalesce(F.col("metadata")["qbc_extraction_notes"], F.lit("")).alias("notes"), "answer_label", F.array_join("answer_labels", "|").alias("answer_labels"), "answer_bool")


@query("""WITH a AS (SELECT candidate_id AS id, count(*) AS na FROM (SELECT DISTINCT candidate_id, candidate_revision FROM candidates) GROUP BY 1), b AS (SELECT question_id AS id, count(*) AS nb FROM (SELECT DISTINCT question_id, bank_id FROM question_bank) GROUP BY 1),
j AS (SELECT coalesce(a.id, b.id) AS id, na, nb FROM a FULL OUTER JOIN b ON a.id = b.id)
SELECT id, 'left_repeated' AS kind FROM j WHERE na > 1 UNION ALL SELECT id, 'right_repeated' FROM j WHERE nb > 1 UNION ALL SELECT id, 'left_only' FROM j WHERE nb IS NULL UNION ALL SELECT id, 'right_only' FROM j WHERE na IS NULL""")
def candidate_bank_pairing(spark, sf):
    """Candidates and bank questions that do not stand one to one."""
    a = load(spark, sf, "candidates").select(F.col("candidate_id").alias("id"), "candidate_revision").distinct()
    b = load(spark, sf, "question_bank").select(F.col("question_id").alias("id"), "bank_id").distinct()
    return I.one_to_one(a, b, ["id"])[1]


_RESCAN = """c AS (SELECT DISTINCT candidate_id, source_id, locator, fingerprints.content_revision_fingerprint AS rev, fingerprints.stem_fingerprint AS stem_fp, fingerprints.option_set_fingerprint AS set_fp, created_at, archived_at FROM candidates),
o AS (SELECT candidate_id, source_id, locator, rev, stem_fp, set_fp FROM c), w AS (SELECT 'n-' || candidate_id AS new_id, source_id, locator, CASE WHEN rev[1] IN ('0', '1', '2', '3') THEN NULL ELSE rev END AS rev, CASE WHEN stem_fp[1] IN ('0', '1', '2', '3') THEN NULL ELSE stem_fp END AS stem_fp, set_fp FROM c WHERE archived_at IS NULL),
p1 AS (SELECT min(o.candidate_id) AS old_id, rev FROM o WHERE rev IS NOT NULL GROUP BY rev HAVING count(*) = 1), q1 AS (SELECT min(new_id) AS new_id, rev FROM w WHERE rev IS NOT NULL GROUP BY rev HAVING count(*) = 1), m1 AS (SELECT old_id, new_id FROM p1 JOIN q1 USING (rev)),
o2 AS (SELECT * FROM o WHERE candidate_id NOT IN (SELECT old_id FROM m1)), w2 AS (SELECT * FROM w WHERE new_id NOT IN (SELECT new_id FROM m1)),
m2 AS (SELECT old_id, new_id FROM (SELECT min(candidate_id) AS old_id, stem_fp, set_fp FROM o2 WHERE stem_fp IS NOT NULL AND set_fp IS NOT NULL GROUP BY 2, 3 HAVING count(*) = 1) JOIN (SELECT min(new_id) AS new_id, stem_fp, set_fp FROM w2 WHERE stem_fp IS NOT NULL AND set_fp IS NOT NULL GROUP BY 2, 3 HAVING count(*) = 1) USING (stem_fp, set_fp)),
o3 AS (SELECT * FROM o2 WHERE candidate_id NOT IN (SELECT old_id FROM m2)), w3 AS (SELECT * FROM w2 WHERE new_id NOT IN (SELECT new_id FROM m2)),
m3 AS (SELECT old_id, new_id FROM (SELECT min(candidate_id) AS old_id, source_id, locator FROM o3 WHERE source_id IS NOT NULL AND locator IS NOT NULL GROUP BY 2, 3 HAVING count(*) = 1) JOIN (SELECT min(new_id) AS new_id, source_id, locator FROM w3 WHERE source_id IS NOT NULL AND locator IS NOT NULL GROUP BY 2, 3 HAVING count(*) = 1) USING (source_id, locator))"""


def _rescan(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Candidates and a derived later scan: archived ones gone, some fingerprints changed by their first digit."""
    c = load(spark, sf, "candidates").select("candidate_id", "source_id", "locator", "fingerprints", "archived_at").distinct()
    c = c.select("candidate_id", "source_id", "locator", F.col("fingerprints.content_revision_fingerprint").alias("rev"), F.col("fingerprints.stem_fingerprint").alias("stem_fp"), F.col("fingerprints.option_set_fingerprint").alias("set_fp"), "archived_at")
    kept = lambda x: F.when(~F.substring(x, 1, 1).isin("0", "1", "2", "3"), F.col(x)).alias(x)
    return c, c.where("archived_at IS NULL").select(F.concat(F.lit("n-"), "candidate_id").alias("new_id"), "source_id", "locator", kept("rev"), kept("stem_fp"), "set_fp")


@query(f"WITH {_RESCAN} SELECT old_id, new_id, 1 AS pass FROM m1 UNION ALL SELECT old_id, new_id, 2 FROM m2 UNION ALL SELECT old_id, new_id, 3 FROM m3")
def rescan_matches(spark, sf):
    return I.match_rescan(*_rescan(spark, sf), [["rev"], ["stem_fp", "set_fp"], ["source_id", "locator"]], "candidate_id", "new_id")


_PLACED = """SELECT id, lag_mate AS b, lead_mate AS a, n - lag_n AS place, lead_n - lag_n - 1 AS size FROM (SELECT *, last_value(CASE WHEN mate IS NOT NULL THEN n END IGNORE NULLS) OVER p AS lag_n, last_value(mate IGNORE NULLS) OVER p AS lag_mate, first_value(CASE WHEN mate IS NOT NULL THEN n END IGNORE NULLS) OVER f AS lead_n, first_value(mate IGNORE NULLS) OVER f AS lead_mate
FROM (SELECT *, row_number() OVER (ORDER BY s NULLS FIRST, e, o NULLS FIRST, id NULLS FIRST) AS n FROM {rows}) WINDOW p AS (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) WHERE mate IS NULL"""


@query(f"""WITH {_RESCAN}, mm AS (SELECT old_id, new_id FROM m1 WHERE old_id[-1] <> '0' UNION ALL SELECT old_id, new_id FROM m2 WHERE old_id[-1] <> '0'),
xo AS (SELECT coalesce(source_id, '') AS s, 1 AS e, locator AS o, candidate_id AS id, new_id AS mate FROM c LEFT JOIN mm ON old_id = candidate_id UNION ALL SELECT DISTINCT coalesce(source_id, ''), e, NULL, NULL, concat_ws(chr(31), 'end', source_id, e) FROM c, (VALUES (0), (2)) v(e)),
xn AS (SELECT coalesce(source_id, '') AS s, 1 AS e, locator AS o, w.new_id AS id, mm.new_id AS mate FROM w LEFT JOIN mm ON mm.new_id = w.new_id UNION ALL SELECT DISTINCT coalesce(source_id, ''), e, NULL, NULL, concat_ws(chr(31), 'end', source_id, e) FROM w, (VALUES (0), (2)) v(e)),
po AS ({_PLACED.format(rows="xo")}), pn AS ({_PLACED.format(rows="xn")})
SELECT po.id AS old_id, pn.id AS new_id, po.size FROM po JOIN pn ON po.b = pn.b AND po.a = pn.a AND po.place = pn.place AND po.size = pn.size""")
def rescan_by_order(spark, sf):
    """What equal fingerprints leave over (some matches held back by the last digit of the id), matched by place between neighbours."""
    old, new = _rescan(spark, sf)
    m = I.match_rescan(old, new, [["rev"], ["stem_fp", "set_fp"]], "candidate_id", "new_id").where("substring(old_id, -1, 1) <> '0'")
    return I.match_by_order(old, new, materialize(m), "source_id", "locator", "candidate_id", "new_id")


@query("""SELECT DISTINCT candidate_id, CAST(len(options) AS INTEGER) AS n_options FROM candidates WHERE len(list_filter(list_transform(options, lambda x, i: coalesce(x.current_position <> i OR ascii(x.source_label) <> i + 64, true)), lambda b: b)) > 0""")
def option_order(spark, sf):
    return I.option_order_violations(load(spark, sf, "candidates"))


@query("""WITH d AS (SELECT DISTINCT decision_id, candidate_id, decision_type, status, recorded_at FROM decisions)
SELECT candidate_id, decision_type, decision_id, status FROM d WHERE candidate_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY candidate_id, decision_type ORDER BY recorded_at DESC, decision_id DESC) = 1""")
def latest_decisions(spark, sf):
    d = load(spark, sf, "decisions").where("candidate_id IS NOT NULL")
    return I.latest(d, ["candidate_id", "decision_type"], ["recorded_at", "decision_id"], ["decision_id", "status"])


@query("""WITH d AS (SELECT DISTINCT decision_id, candidate_id, evidence, status FROM decisions), e AS (SELECT decision_id, status, unnest(evidence) AS e FROM d),
h AS (SELECT DISTINCT e.source_id AS source_id, e.evidence_fingerprint AS fp FROM e WHERE status = 'valid'), x AS (SELECT DISTINCT decision_id, e.source_id AS source_id, e.evidence_fingerprint AS fp FROM e WHERE status <> 'valid')
SELECT decision_id, x.source_id, x.fp AS evidence_fingerprint, h.fp IS NOT NULL AS current FROM x LEFT JOIN h ON x.source_id = h.source_id AND x.fp = h.fp""")
def evidence_mapping(spark, sf):
    """Evidence of decisions that are not valid any more, and whether a valid decision still rests on the same."""
    e = load(spark, sf, "decisions").select("decision_id", "status", F.explode("evidence").alias("e")).select("decision_id", "status", "e.source_id", "e.evidence_fingerprint").distinct()
    h = e.where("status = 'valid'").select("source_id", "evidence_fingerprint").distinct().withColumn("current", F.lit(True))
    x = e.where("status <> 'valid'").drop("status").distinct()
    return x.join(h, ["source_id", "evidence_fingerprint"], "left").select("decision_id", "source_id", "evidence_fingerprint", F.coalesce("current", F.lit(False)).alias("current"))
