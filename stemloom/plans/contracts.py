"""Queries of document shapes, option pairing, manifests and reviews, with the SQL that states the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.operators import contracts as C
from stemloom.operators import evidence as E
from stemloom.operators import export, intake, registry
from stemloom.plans import curation
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


_UUID, _HASH = "[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", "[0-9a-f]{64}"
# Fixed values, stated once more for the SQL.
_ENUMS = {
    "type": "'single_choice', 'multiple_choice', 'true_false', 'unsupported', 'ambiguous'", "state": "'candidate', 'validated', 'unsupported', 'ambiguous', 'archived'", "decided": "'valid', 'needs_revalidation', 'archived'", "decision": "'answer_resolution', 'duplicate_relation', 'association'",
    "kind": "'question_document', 'answer_document', 'unrelated', 'duplicate_version'", "level": "'blocking', 'review_required', 'informational'", "review": "'open', 'resolved', 'archived'",
    "issue": "'QB-SOURCE-UNSUPPORTED', 'QB-SOURCE-READ-FAILED', 'QB-ROLE-AMBIGUOUS', 'QB-TYPE-UNSUPPORTED', 'QB-STRUCTURE-AMBIGUOUS', 'QB-ANSWER-MISSING', 'QB-ANSWER-CONFLICT', 'QB-ASSOCIATION-LOW-CONFIDENCE', 'QB-DUPLICATE-CANDIDATE', 'QB-IDENTITY-AMBIGUOUS', 'QB-OPTION-IDENTITY-AMBIGUOUS', 'QB-DECISION-STALE', 'QB-FORMAT-LOSS', 'QB-SECURITY-INSTRUCTION-DATA', 'QB-REMOTE-CAPABILITY-NOT-AUTHORIZED'",
}


def _checks(table: str, key: str, fields: str, prefix: str = "", element: str = "") -> str:
    """One SELECT for each 'field rule' of a table (or of the elements of an array, given as a table)."""
    out = []
    for field, rule in (x.split() for x in fields.split(", ")):
        c = element + field
        path = f"{prefix} || '{field}'" if prefix else f"'{field}'"
        code = {
            "uuid": f"CASE WHEN NOT coalesce(regexp_full_match({c}, '{_UUID}'), false) THEN 'PATTERN' END", "hash": f"CASE WHEN NOT coalesce(regexp_full_match({c}, '{_HASH}'), false) THEN 'PATTERN' END", "int": f"CASE WHEN {c} IS NULL THEN 'TYPE' WHEN {c} < 1 THEN 'CARDINALITY' END",
            "text": f"CASE WHEN {c} IS NULL THEN 'TYPE' WHEN {c} = '' THEN 'CARDINALITY' END", "there": f"CASE WHEN {c} IS NULL THEN 'TYPE' END", "some": f"CASE WHEN coalesce(len({c}), 0) = 0 THEN 'CARDINALITY' END", "uuid?": f"CASE WHEN NOT regexp_full_match({c}, '{_UUID}') THEN 'PATTERN' END", "text?": f"CASE WHEN {c} = '' THEN 'CARDINALITY' END",
        }.get(rule) or f"CASE WHEN NOT coalesce({c} IN ({_ENUMS[rule]}), false) THEN 'ENUM' END"
        out.append(f"SELECT {key} AS record_id, {code} AS code, {path} AS path FROM {table}")
    return " UNION ALL ".join(out)


_SHAPES = " UNION ALL ".join([
    _checks("c", "'candidates/' || candidate_id", "candidate_id uuid, candidate_revision int, source_id uuid, locator text, stem text, question_type type, status state, fingerprints.stem_fingerprint hash, fingerprints.option_set_fingerprint hash, fingerprints.content_revision_fingerprint hash, duplicate_group text?, options there"),
    _checks("co", "'candidates/' || candidate_id", "option_id uuid, candidate_id uuid, option_revision int, normalized_text_fingerprint hash, current_position int, source_label text, source_ref.source_id uuid, source_ref.locator text, previous_labels there", "'options[' || (i - 1) || '].'", "o."),
    _checks("s", "'sources/' || source_id", "source_id uuid, kind kind, current_relative_path text, current_content_hash hash, revision int, path_history some"),
    _checks("r", "'review_queue/' || review_id", "review_id uuid, issue_code issue, blocking_level level, status review, allowed_user_actions some, candidate_id uuid?"),
    _checks("d", "'decisions/' || decision_id", "decision_id uuid, candidate_id uuid, candidate_revision int, decision_type decision, value there, evidence some, status decided"),
    _checks("de", "'decisions/' || decision_id", "source_id uuid, source_revision int, locator text, evidence_fingerprint hash", "'evidence[' || (i - 1) || '].'", "o."),
])


@query(f"""WITH c AS (SELECT DISTINCT candidate_id, candidate_revision, source_id, locator, question_type, status, stem, fingerprints, options, duplicate_group FROM candidates), co AS (SELECT candidate_id, unnest(options) AS o, generate_subscripts(options, 1) AS i FROM c),
s AS (SELECT DISTINCT source_id, kind, current_relative_path, path_history, current_content_hash, revision FROM sources), r AS (SELECT DISTINCT review_id, candidate_id, issue_code, blocking_level, status, allowed_user_actions FROM review_queue),
d AS (SELECT DISTINCT decision_id, candidate_id, candidate_revision, decision_type, value, evidence, status FROM decisions), de AS (SELECT decision_id, unnest(evidence) AS o, generate_subscripts(evidence, 1) AS i FROM d)
SELECT 'QB-CONTRACT-' || code AS code, record_id, path FROM ({_SHAPES}) WHERE code IS NOT NULL""")
def contract_shapes(spark, sf):
    """Malformed fields of candidates, sources, reviews and decisions."""

    def of(table: str, key: str, rules: dict, nested: dict | None = None) -> DataFrame:
        columns = list(dict.fromkeys(f.split(".")[0] for f in [*rules, *(nested or {})]))
        v = C.contract_violations(load(spark, sf, table).select(*columns).distinct(), key, rules, nested)
        return v.withColumn("record_id", F.concat(F.lit(f"{table}/"), "record_id"))

    parts = [of("candidates", "candidate_id", C.CANDIDATE, {"options": C.OPTION}), of("sources", "source_id", C.SOURCE), of("review_queue", "review_id", C.REVIEW), of("decisions", "decision_id", C.DECISION, {"evidence": C.BINDING})]
    return reduce(DataFrame.unionByName, parts)


@query("""WITH a AS (SELECT DISTINCT candidate_id AS question_id, o.source_label AS label, o.current_position AS position, o.option_id AS a_id, true AS a FROM (SELECT candidate_id, unnest(options) AS o FROM candidates)),
b AS (SELECT DISTINCT question_id, o.label AS label, i AS position, o.source_option_id AS b_id, true AS b FROM (SELECT question_id, unnest(options) AS o, generate_subscripts(options, 1) AS i FROM question_bank)),
j AS (SELECT coalesce(a.question_id, b.question_id) AS question_id, coalesce(a.label, b.label) AS label, CAST(coalesce(a.position, b.position) AS INTEGER) AS position, CASE WHEN b IS NULL THEN 'candidate_only' WHEN a IS NULL THEN 'bank_only' WHEN a_id IS DISTINCT FROM b_id THEN 'option_id' END AS fault
  FROM a FULL OUTER JOIN b ON a.question_id = b.question_id AND a.label = b.label AND a.position = b.position)
SELECT question_id, label, position, fault FROM j WHERE fault IS NOT NULL AND question_id IN (SELECT candidate_id FROM candidates) AND question_id IN (SELECT question_id FROM question_bank)""")
def option_pairing(spark, sf):
    return C.option_pairing(load(spark, sf, "candidates"), load(spark, sf, "question_bank"))


@query(f"""WITH {curation._ASSOC}, o AS (SELECT DISTINCT candidate_id, o.source_label AS label, o.option_id AS option_id FROM (SELECT candidate_id, unnest(options) AS o FROM candidates)),
w AS (SELECT DISTINCT question_id, found[1] AS label FROM c WHERE conclusion = 'confirmable') SELECT w.question_id, w.label, o.option_id FROM w LEFT JOIN o ON o.candidate_id = w.question_id AND o.label = w.label""")
def answer_options(spark, sf):
    """Confirmable answers with the id of their option."""
    return C.answer_options(E.associate(curation._questions(spark, sf), curation._single(spark, sf))[0], load(spark, sf, "candidates"))


_MANIFEST = """p AS (SELECT DISTINCT source_id, kind, current_relative_path AS path, path_history AS history, current_content_hash AS hash, revision FROM sources WHERE source_id[1] <> 'f'),
e AS (SELECT DISTINCT source_id, CASE WHEN source_id[2] = '0' THEN 'unrelated' ELSE kind END AS kind, CASE WHEN source_id[2] = '1' THEN 'x' ELSE 'new/' || current_relative_path END AS path, CASE WHEN source_id[2] = '2' THEN ['new/' || current_relative_path] ELSE list_append(path_history, 'new/' || current_relative_path) END AS history, current_content_hash AS hash,
  revision + CASE WHEN source_id[2] = '3' THEN -1 ELSE 1 END AS revision FROM sources WHERE presence = 'present'),
j AS (SELECT coalesce(p.source_id, e.source_id) AS source_id, p.source_id IS NOT NULL AS ip, e.source_id IS NOT NULL AS ie, p, e, CASE WHEN p.source_id IS NOT NULL AND e.source_id IS NOT NULL AND p.kind <> e.kind THEN 'kind' WHEN p.source_id IS NOT NULL AND e.source_id IS NOT NULL AND e.revision < p.revision THEN 'revision'
  WHEN p.source_id IS NOT NULL AND e.source_id IS NOT NULL AND e.history[1:len(p.history)] IS DISTINCT FROM p.history THEN 'history' WHEN e.source_id IS NOT NULL AND e.history[-1] IS DISTINCT FROM e.path THEN 'path' END AS fault FROM p FULL OUTER JOIN e ON p.source_id = e.source_id)"""


def _manifests(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A manifest without some sources, and the present sources at new places, some of them wrong by the second digit of their id."""
    s = load(spark, sf, "sources").select("source_id", "kind", F.col("current_relative_path").alias("path"), F.col("path_history").alias("history"), F.col("current_content_hash").alias("hash"), "revision", "presence").distinct()
    digit, place = F.substring("source_id", 2, 1), F.concat(F.lit("new/"), "path")
    e = s.where("presence = 'present'").select(
        "source_id", F.when(digit == "0", "unrelated").otherwise(F.col("kind")).alias("kind"), F.when(digit == "1", "x").otherwise(place).alias("path"), F.when(digit == "2", F.array(place)).otherwise(F.concat("history", F.array(place))).alias("history"),
        "hash", (F.col("revision") + F.when(digit == "3", -1).otherwise(1)).alias("revision"),
    )
    return s.where("substring(source_id, 1, 1) <> 'f'").drop("presence"), e


@query(f"WITH {_MANIFEST} SELECT source_id, CASE WHEN fault IS NULL AND ie THEN e.kind ELSE p.kind END AS kind, CASE WHEN fault IS NULL AND ie THEN e.path ELSE p.path END AS path, array_to_string(CASE WHEN fault IS NULL AND ie THEN e.history ELSE p.history END, '|') AS history, CASE WHEN fault IS NULL AND ie THEN e.revision ELSE p.revision END AS revision FROM j WHERE ip OR fault IS NULL")
def manifest_merge(spark, sf):
    return C.merge_manifest(*_manifests(spark, sf))[0].select("source_id", "kind", "path", F.array_join("history", "|").alias("history"), "revision")


@query(f"WITH {_MANIFEST} SELECT source_id, fault FROM j WHERE fault IS NOT NULL")
def manifest_faults(spark, sf):
    return C.merge_manifest(*_manifests(spark, sf))[1]


@query("""WITH r AS (SELECT DISTINCT review_id, candidate_id, issue_code, status, recorded_at FROM review_queue WHERE candidate_id IS NOT NULL), w AS (SELECT DISTINCT candidate_id, issue_code FROM r UNION SELECT candidate_id, 'QB-ANSWER-MISSING' FROM candidates WHERE status = 'ambiguous'),
p AS (SELECT candidate_id, issue_code, count_if(status = 'open') AS n, max(review_id) FILTER (status = 'open') AS one, arg_max(review_id, (recorded_at, review_id)) FILTER (status IN ('resolved', 'archived')) AS last FROM r GROUP BY 1, 2)
SELECT w.candidate_id, w.issue_code, CASE WHEN n = 1 THEN 'reuse' WHEN n > 1 THEN 'ambiguous' ELSE 'create' END AS action, CASE WHEN n = 1 THEN one END AS review_id, CASE WHEN coalesce(n, 0) = 0 THEN last END AS supersedes FROM w LEFT JOIN p ON p.candidate_id = w.candidate_id AND p.issue_code = w.issue_code""")
def review_actions(spark, sf):
    """What to do about every issue key that has a review, and about ambiguous candidates without an answer."""
    r = load(spark, sf, "review_queue").where("candidate_id IS NOT NULL").select("review_id", "candidate_id", "issue_code", "status", "recorded_at").distinct()
    more = load(spark, sf, "candidates").where("status = 'ambiguous'").select("candidate_id", F.lit("QB-ANSWER-MISSING").alias("issue_code"))
    return C.find_or_create(r, r.select("candidate_id", "issue_code").unionByName(more), ["candidate_id", "issue_code"], ["recorded_at"])


@query("""SELECT DISTINCT d.decision_id, d.candidate_id FROM decisions d JOIN candidates c ON c.candidate_id = d.candidate_id AND c.candidate_revision = d.candidate_revision WHERE d.decision_type = 'answer_resolution' AND d.status = 'valid'""")
def current_decisions(spark, sf):
    return C.current_valid(load(spark, sf, "decisions"), load(spark, sf, "candidates")).select("decision_id", "candidate_id").distinct()


@query(f"""WITH {curation._CSV}, {curation._KEYS}, r AS (SELECT DISTINCT question_number, raw_answer FROM k WHERE question_number IS NOT NULL), q AS (SELECT DISTINCT sequence_number, question_type, correct_answer FROM c),
j AS (SELECT q.*, r.raw_answer AS given, {curation._strip("coalesce(correct_answer, '')")} AS key, {curation._strip("coalesce(raw_answer, '')")} AS g FROM q JOIN r ON q.sequence_number = r.question_number)
SELECT sequence_number, question_type, correct_answer, given FROM j WHERE key <> '' AND NOT CASE WHEN question_type = '多选题' THEN list_sort(list_distinct(string_split(upper(regexp_replace(key, '[\\s,;|/]', '', 'g')), ''))) = list_sort(list_distinct(string_split(upper(regexp_replace(g, '[\\s,;|/]', '', 'g')), ''))) ELSE key = g END""")
def wrong_answers(spark, sf):
    """The different wrong answers of a number; what has no key is not graded and not wrong."""
    c = load(spark, sf, "standard_bank_rows").select("sequence_number", "question_type", "correct_answer").distinct()
    r = curation._entries(spark, sf).where("question_number IS NOT NULL").select("question_number", F.col("raw_answer").alias("given")).distinct()
    g = export.grade(c.join(r, c["sequence_number"] == r["question_number"]), "correct_answer", "given", "question_type")
    return g.where("is_correct = false").select("sequence_number", "question_type", "correct_answer", "given")


# The tables number few questions as the answer keys do, and hold few faults; the queries below derive both from ids, so that every
# branch of the operators has rows.

_NUMBERED = curation._ASSOC.replace("TRY_CAST(nullif(regexp_extract(source_reference.locator, '([0-9]+)\\z', 1), '') AS BIGINT)", "CAST('0x' || substr(question_id, 1, 2) AS BIGINT) % 40 + 1")
_NUMBERED = _NUMBERED.replace("CAST(question_number AS BIGINT) AS question_number", "CAST(question_number AS BIGINT) % 40 + 1 AS question_number")


def _numbered(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Bank questions numbered by the first two digits of their id, and single answers, both up to 40."""
    q = curation._questions(spark, sf).withColumn("question_number", F.conv(F.substring("question_id", 1, 2), 16, 10).cast("bigint") % 40 + 1)
    return q, curation._single(spark, sf).withColumn("question_number", F.col("question_number") % 40 + 1)


@query(f"WITH {_NUMBERED} SELECT source_id, question_id, question_number, conclusion, CASE WHEN conclusion = 'confirmable' THEN found[1] END AS label, coalesce(n_evidence, 0) AS n_evidence FROM c")
def numbered_association(spark, sf):
    return E.associate(*_numbered(spark, sf))[0]


@query(f"WITH {_NUMBERED} SELECT c.question_id, ev.label, coalesce(list_contains(c.labels, ev.label), false) AS known, count(*) AS n_evidence FROM c JOIN ev ON c.source_id = ev.source_id AND c.question_number = ev.question_number WHERE conclusion = 'conflict' GROUP BY 1, 2, 3")
def numbered_alternatives(spark, sf):
    return E.alternatives(*_numbered(spark, sf)).withColumn("known", F.coalesce("known", F.lit(False)))


@query(f"""WITH {_NUMBERED}, o AS (SELECT DISTINCT candidate_id, o.source_label AS label, o.option_id AS option_id FROM (SELECT candidate_id, unnest(options) AS o FROM candidates)),
w AS (SELECT DISTINCT question_id, found[1] AS label FROM c WHERE conclusion = 'confirmable') SELECT w.question_id, w.label, o.option_id FROM w LEFT JOIN o ON o.candidate_id = w.question_id AND o.label = w.label""")
def numbered_options(spark, sf):
    """Confirmable answers of numbered questions with the id of their option."""
    return C.answer_options(numbered_association(spark, sf), load(spark, sf, "candidates"))


_COPIED = """s AS (SELECT DISTINCT source_id, current_relative_path AS path, path_history AS history, current_content_hash AS hash, revision FROM sources),
cur AS (SELECT 'moved/' || path AS path, min(hash) AS hash FROM s WHERE hash IS NOT NULL AND hash[1] < '8' GROUP BY 1 UNION ALL SELECT 'copy/' || path, min(hash) FROM s WHERE hash IS NOT NULL AND hash[1] < '4' GROUP BY 1),
bad AS (SELECT hash, (SELECT count(DISTINCT source_id) FROM s WHERE s.hash = cur.hash) AS n_old, count(*) AS n_new FROM cur GROUP BY hash)"""


def _copied(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The registry, and a scan in which half of the files are moved and half of those copied as well, by their hash."""
    s = load(spark, sf, "sources").select("source_id", F.col("current_relative_path").alias("path"), F.col("path_history").alias("history"), F.col("current_content_hash").alias("hash"), "revision").distinct()
    at = lambda folder, below: s.where(F.substring("hash", 1, 1) < below).groupBy(F.concat(F.lit(folder), "path").alias("path")).agg(F.min("hash").alias("hash"))
    return s, at("moved/", "8").unionByName(at("copy/", "4"))


@query(f"WITH {_COPIED} SELECT 'QB-IDENTITY-AMBIGUOUS' AS code, hash, n_old, n_new FROM bad WHERE n_old > 1 OR n_new > 1")
def copied_sources(spark, sf):
    return registry.reconcile(*_copied(spark, sf))[1]


@query(f"""WITH {_COPIED} SELECT DISTINCT hash, 'old' AS side, path FROM s WHERE hash IN (SELECT hash FROM bad WHERE n_old > 1 OR n_new > 1)
UNION ALL SELECT DISTINCT hash, 'new', path FROM cur WHERE hash IN (SELECT hash FROM bad WHERE n_old > 1 OR n_new > 1)""")
def copied_paths(spark, sf):
    """The paths of the hashes that moved to two places."""
    old, new = _copied(spark, sf)
    return registry.ambiguous_paths(old, new, registry.reconcile(old, new)[1])


_FAULTY = """x AS (SELECT extract_no AS no, CASE extract_no % 8 WHEN 0 THEN 'essay' ELSE question_type END AS question_type, CASE extract_no % 8 WHEN 1 THEN ' ' ELSE stem END AS stem, CASE extract_no % 8 WHEN 2 THEN options[1:1] WHEN 3 THEN list_reverse(options) ELSE options END AS options,
CASE extract_no % 8 WHEN 4 THEN '"Z"' WHEN 5 THEN '["A","A"]' ELSE answer END AS answer, CASE extract_no % 8 WHEN 6 THEN NULL ELSE source_reference END AS source_reference FROM (SELECT DISTINCT extract_no, question_type, stem, options, answer, source_reference FROM extracted_questions)),
a AS (SELECT *, CASE WHEN answer LIKE '"%' THEN answer::JSON ->> '$' END AS label, CASE WHEN answer LIKE '[%' THEN CAST(answer::JSON AS VARCHAR[]) END AS labels, CASE answer WHEN 'true' THEN true WHEN 'false' THEN false END AS flag, list_transform(options, lambda o: coalesce(o.label, '')) AS names FROM x)"""


@query(f"""WITH {_FAULTY}, v AS (
SELECT no, 'type' AS rule FROM a WHERE NOT coalesce(question_type IN ('single_choice', 'multiple_choice', 'true_false'), false) UNION ALL SELECT no, 'stem' FROM a WHERE coalesce({curation._strip('stem')} = '', true)
UNION ALL SELECT no, 'option_count' FROM a WHERE CASE WHEN question_type = 'true_false' THEN len(options) <> 0 ELSE len(options) < 2 OR len(options) > 5 END UNION ALL SELECT no, 'option_labels' FROM a WHERE names <> ['A', 'B', 'C', 'D', 'E'][1:least(len(options), 5)]
UNION ALL SELECT no, 'answer' FROM a WHERE answer IS NOT NULL AND answer <> 'null' AND NOT coalesce(CASE question_type WHEN 'single_choice' THEN list_contains(names, label) WHEN 'true_false' THEN flag IS NOT NULL WHEN 'multiple_choice' THEN len(labels) >= 2 AND len(list_distinct(labels)) = len(labels) AND len(list_filter(labels, lambda l: NOT list_contains(names, l))) = 0 END, false)
UNION ALL SELECT no, 'source' FROM a WHERE source_reference IS NULL) SELECT no AS record_id, rule FROM v""")
def extraction_faults(spark, sf):
    """Extractions with faults by their number."""
    x = load(spark, sf, "extracted_questions").select("extract_no", "question_type", "stem", "options", "answer", "source_reference").distinct()
    n = F.col("extract_no") % 8
    x = x.withColumns({
        "question_type": F.when(n == 0, "essay").otherwise(F.col("question_type")), "stem": F.when(n == 1, " ").otherwise(F.col("stem")), "options": F.when(n == 2, F.slice("options", 1, 1)).when(n == 3, F.reverse("options")).otherwise(F.col("options")),
        "answer": F.when(n == 4, '"Z"').when(n == 5, '["A","A"]').otherwise(F.col("answer")), "source_reference": F.when(n != 6, F.col("source_reference")),
    })
    return intake.extraction_violations(x, "extract_no")


@query("""WITH c AS (SELECT DISTINCT candidate_id, CASE candidate_id[1] WHEN '0' THEN list_reverse(options) WHEN '1' THEN options[2:] ELSE options END AS o FROM candidates),
b AS (SELECT DISTINCT question_id, CASE question_id[2] WHEN '0' THEN options[1:2] ELSE options END AS o FROM question_bank),
a1 AS (SELECT DISTINCT candidate_id AS question_id, x.source_label AS label, x.current_position AS position, x.option_id AS a_id FROM (SELECT candidate_id, unnest(o) AS x FROM c)), b1 AS (SELECT DISTINCT question_id, x.label AS label, i AS position, x.source_option_id AS b_id FROM (SELECT question_id, unnest(o) AS x, generate_subscripts(o, 1) AS i FROM b)),
j AS (SELECT coalesce(a1.question_id, b1.question_id) AS question_id, coalesce(a1.label, b1.label) AS label, CAST(coalesce(a1.position, b1.position) AS INTEGER) AS position, CASE WHEN b1.question_id IS NULL THEN 'candidate_only' WHEN a1.question_id IS NULL THEN 'bank_only' WHEN a_id IS DISTINCT FROM b_id THEN 'option_id' END AS fault
  FROM a1 FULL OUTER JOIN b1 ON a1.question_id = b1.question_id AND a1.label = b1.label AND a1.position = b1.position)
SELECT question_id, label, position, fault FROM j WHERE fault IS NOT NULL AND question_id IN (SELECT candidate_id FROM candidates) AND question_id IN (SELECT question_id FROM question_bank)""")
def option_pairing_faults(spark, sf):
    """Options of candidates and bank questions some of which are cut off, by their ids."""
    first, second = F.substring("candidate_id", 1, 1), F.substring("question_id", 2, 1)
    c = load(spark, sf, "candidates").select("candidate_id", F.when(first == "0", F.reverse("options")).when(first == "1", F.slice("options", 2, 99)).otherwise(F.col("options")).alias("options")).distinct()
    b = load(spark, sf, "question_bank").select("question_id", F.when(second == "0", F.slice("options", 1, 2)).otherwise(F.col("options")).alias("options")).distinct()
    return C.option_pairing(c, b)


@query("""SELECT DISTINCT candidate_id, CAST(len(o) AS INTEGER) AS n_options FROM (SELECT candidate_id, CASE candidate_id[1] WHEN '0' THEN list_reverse(options) WHEN '1' THEN options[2:] ELSE options END AS o FROM candidates) WHERE len(list_filter(list_transform(o, lambda x, i: coalesce(x.current_position <> i OR ascii(x.source_label) <> i + 64, true)), lambda b: b)) > 0""")
def option_order_faults(spark, sf):
    """Candidates some of whose options are turned round or begin too late, by their ids."""
    first = F.substring("candidate_id", 1, 1)
    c = load(spark, sf, "candidates").select("candidate_id", F.when(first == "0", F.reverse("options")).when(first == "1", F.slice("options", 2, 99)).otherwise(F.col("options")).alias("options"))
    return intake.option_order_violations(c)


_BANK = curation.ORACLE["csv_projection"]


@query("""WITH q AS (SELECT question_id, CASE question_id[1] WHEN '0' THEN 'essay' ELSE question_type END AS question_type, CASE question_id[1] WHEN '1' THEN list_concat(options, options) WHEN '2' THEN list_transform(options, lambda o: {'label': o.label, 'text': NULL, 'source_option_id': o.source_option_id}) WHEN '3' THEN list_transform(options, lambda o: {'label': o.label || 'x', 'text': o.text, 'source_option_id': o.source_option_id}) ELSE options END AS options,
CASE WHEN question_id[1] = '4' THEN 'Z' ELSE answer_label END AS answer_label, answer_labels, answer_bool, stem, chapter, explanation FROM (SELECT DISTINCT question_id, question_type, stem, options, chapter, explanation, answer_label, answer_labels, answer_bool FROM question_bank)),
""" + _BANK[_BANK.index("a AS (SELECT *, list_transform") : _BANK.index("g AS (SELECT * FROM a")] + """x AS (SELECT question_id, question_type, CASE WHEN NOT coalesce(question_type IN ('single_choice', 'multiple_choice', 'true_false'), false) THEN 'question_type' WHEN len(list_filter(ls, lambda x: x NOT IN ('A', 'B', 'C', 'D', 'E'))) > 0 THEN 'option_label'
WHEN len(list_distinct(ls)) <> len(ls) THEN 'duplicate_option_label' WHEN len(list_filter(options, lambda o: o.text IS NULL)) > 0 THEN 'option_text' WHEN correct_answer IS NULL THEN 'answer' END AS reason FROM a)
SELECT question_id, question_type, reason FROM x WHERE reason IS NOT NULL""")
def csv_faults(spark, sf):
    """The reasons why bank questions with faults by their ids have no place in the CSV."""
    q, first = curation._bank_rows(spark, sf), F.substring("question_id", 1, 1)
    no_text = F.transform("options", lambda o: o.withField("text", F.lit(None).cast("string")))
    odd_label = F.transform("options", lambda o: o.withField("label", F.concat(o["label"], F.lit("x"))))
    options = F.when(first == "1", F.concat("options", "options")).when(first == "2", no_text).when(first == "3", odd_label).otherwise(F.col("options"))
    q = q.withColumns({"options": options, "question_type": F.when(first == "0", "essay").otherwise(F.col("question_type")), "answer_label": F.when(first == "4", "Z").otherwise(F.col("answer_label"))})
    return export.rejected_rows(q)
