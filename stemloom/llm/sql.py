"""SQL that states the same as the queries of the text operators, over whole tables."""

from __future__ import annotations

import unicodedata

from stemloom.llm.plain import _plain_char

_P1 = """t AS (SELECT DISTINCT candidate_id AS id, stem AS t FROM candidates
  UNION ALL SELECT q.question_id, q.o.text FROM (SELECT DISTINCT question_id, unnest(options) AS o FROM question_bank) q WHERE q.question_id IN (SELECT candidate_id FROM candidates)),
n AS (SELECT DISTINCT id, regexp_replace(lower(t), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM t WHERE t IS NOT NULL),
g AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS x FROM n WHERE length(t) > 2),
s AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT p.a, p.b FROM p JOIN s sa ON sa.id = p.a JOIN s sb ON sb.id = p.b WHERE p.c >= 0.6 * (sa.n + sb.n - p.c) - 1e-9)"""


def _fold() -> str:
    """The characters outside ASCII with another plain form, as a table; composition is left to nfc_normalize."""
    rows = []
    for n in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)):
        plain = "".join(map(_plain_char, unicodedata.normalize("NFKD", chr(n))))
        if plain != chr(n):
            rows.append("({}, '{}')".format(n, plain.replace("'", "''")))
    return f"fold AS (SELECT * FROM (VALUES {', '.join(rows)}) v(n, plain))"


_LOOKS = f"""{_fold()},
x AS (SELECT DISTINCT extract_no, coalesce(stem, '') AS stem, list_transform(coalesce(options, []), lambda o: coalesce(o.text, '')) AS texts FROM extracted_questions),
t AS (SELECT extract_no, unnest(list_prepend(stem, texts)) AS t, generate_subscripts(list_prepend(stem, texts), 1) AS i FROM x),
d AS (SELECT t, row_number() OVER () AS no FROM (SELECT DISTINCT t FROM t)),
c AS (SELECT no, j, substr(t, j, 1) AS c FROM (SELECT no, t, unnest(range(1, length(t) + 1)) AS j FROM d)),
f AS (SELECT no, nfc_normalize(coalesce(string_agg(coalesce(plain, c), '' ORDER BY j), '')) AS plain FROM c LEFT JOIN fold ON unicode(c.c) = fold.n GROUP BY no),
p AS (SELECT t.extract_no, t.i, t.t, coalesce(f.plain, '') AS plain FROM t JOIN d USING (t) LEFT JOIN f USING (no))"""

_SPELLED = f"""{_LOOKS}, r AS (SELECT extract_no, list(t ORDER BY i) AS raw, list(plain ORDER BY i) AS look FROM p GROUP BY 1)"""

_COPIES = f"""{_LOOKS}, k AS (SELECT extract_no, i, regexp_replace(lower(plain), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS t FROM p),
r AS (SELECT extract_no, list(t) FILTER (i = 1) AS stem, list_sort(coalesce(list(t) FILTER (i > 1), [])) AS texts FROM k GROUP BY 1),
g AS (SELECT extract_no, min(extract_no) OVER (PARTITION BY stem, texts) AS first FROM r)"""

ORACLE = {
    "p1_found": f"WITH {_P1} SELECT a AS candidate_a, b AS candidate_b FROM pairs",
    "p1_classes": f"""WITH {_P1}, k AS (SELECT id, md5(string_agg(x, chr(10) ORDER BY x)) AS k FROM g GROUP BY 1), f AS (SELECT k, min(id) AS first FROM k GROUP BY 1), m AS (SELECT id, k.k, first FROM k JOIN f USING (k)),
l AS (SELECT DISTINCT x.first AS f, y.first AS o FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) e JOIN m x ON x.id = e.a JOIN m y ON y.id = e.b WHERE x.first <> y.first)
SELECT id AS candidate_id, first AS class_first, (SELECT count(*) FROM l WHERE l.f = m.first) AS n_links FROM m""",
    "p5_found": f"WITH {_SPELLED} SELECT a.extract_no AS extract_a, b.extract_no AS extract_b FROM r a JOIN r b ON a.look = b.look AND a.extract_no < b.extract_no WHERE a.raw <> b.raw",
    "p5_classes": f"""WITH {_SPELLED}, w AS (SELECT extract_no, min(extract_no) OVER (PARTITION BY look) AS first, min(extract_no) OVER (PARTITION BY look, raw) AS spelling_first, count(*) OVER (PARTITION BY look) AS n_rows, look FROM r)
SELECT extract_no, first, spelling_first, n_spellings, n_rows FROM w JOIN (SELECT look, count(DISTINCT raw) AS n_spellings FROM r GROUP BY 1) USING (look) WHERE n_spellings > 1""",
    "p6_found": f"WITH {_COPIES} SELECT first AS first_extract_no, extract_no FROM g WHERE first <> extract_no",
    "p6_collapsed": f"WITH {_COPIES} SELECT first AS extract_no, count(*) AS n_copies FROM g GROUP BY 1",
    "p7_roundtrip": "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents",
    "p8_cover": "SELECT doc_id, true AS fits FROM documents WHERE text <> ''",
    "p9_found": """WITH r AS (SELECT doc_id, s, md5(substr(text, s, 100)) AS x FROM (SELECT doc_id, text, unnest(range(1, length(text) - 98)) AS s FROM documents WHERE length(text) >= 100)),
x AS (SELECT x FROM r GROUP BY x HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER w <= 100 THEN 0 ELSE 1 END AS fresh FROM r WHERE x IN (SELECT x FROM x) WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM m)
SELECT doc_id, CAST(min(s) AS INTEGER) AS span_start, CAST(max(s) + 100 - min(s) AS INTEGER) AS span_chars FROM i GROUP BY doc_id, island""",
}
