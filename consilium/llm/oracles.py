"""DuckDB equivalents of the operators that SQL can express, built from the same fixed values."""

from __future__ import annotations

from .license_scans import _SPELLING, COPYRIGHT_LINE, NOTICE, PUNCTUATION
from .license_texts import EQUIVALENT, KNOWN
from .secret_scans import RULES


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(expr: str) -> str:
    """SQL of ``license_scans.canonical`` over a column expression, as a scalar subquery."""
    spelled = "t"
    for old, new in EQUIVALENT.items():
        spelled = f"regexp_replace({spelled}, {_q(rf'\b{old}\b')}, {_q(new)}, 'g')"
    bare = f"regexp_replace(lower({expr}), {_q(COPYRIGHT_LINE)}, '', 'g')"
    return f"(SELECT CASE WHEN regexp_matches(t, {_q(_SPELLING)}) THEN {spelled} ELSE t END FROM (SELECT trim(regexp_replace({bare}, {_q(PUNCTUATION)}, ' ', 'g')) AS t))"


def _license_sql() -> str:
    texts = ", ".join(f"({_q(name)}, {_q(text)})" for name, many in KNOWN.items() for text in many)
    return f"""
WITH known AS (SELECT sha256({_canonical('k.body')}) AS digest, min(k.id) AS license_id FROM (VALUES {texts}) k(id, body) GROUP BY 1),
digested AS (SELECT d.doc_id, coalesce(d.text, '') AS t, sha256({_canonical("coalesce(d.text, '')")}) AS text_digest FROM documents d),
split AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM digested WHERE regexp_matches(t, {_q(NOTICE)})),
spoken AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], {_q(NOTICE)})) AS idx FROM split),
bodies AS (SELECT doc_id, unnest([0, 1]) AS i, unnest([array_to_string(list_slice(l, idx[1], len(l)), chr(10)), array_to_string(list_slice(l, idx[1], idx[len(idx)]), chr(10))]) AS body FROM spoken),
body AS (SELECT doc_id, license_id, i FROM (SELECT x.doc_id, x.i, sha256({_canonical('x.body')}) AS digest FROM bodies x) JOIN known USING (digest) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1),
lines AS (SELECT doc_id, unnest(l) AS line FROM split),
notices AS (SELECT l.doc_id, k.license_id FROM (SELECT doc_id, sha256({_canonical('x.line')}) AS digest FROM lines x WHERE regexp_matches(x.line, {_q(NOTICE)})) l JOIN known k USING (digest) GROUP BY ALL),
per_doc AS (SELECT doc_id, count(*) AS n_notices, string_agg(license_id, ',' ORDER BY license_id) AS notice_ids FROM notices GROUP BY 1)
SELECT g.doc_id, g.text_digest, k.license_id, coalesce(k.license_id, b.license_id) AS body_id, CASE WHEN k.license_id IS NOT NULL THEN 'whole' WHEN b.i = 0 THEN 'tail' WHEN b.i = 1 THEN 'span' END AS body, coalesce(p.n_notices, 0)::BIGINT AS n_notices, coalesce(p.notice_ids, '') AS notice_ids
FROM digested g LEFT JOIN known k ON k.digest = g.text_digest LEFT JOIN body b ON b.doc_id = g.doc_id LEFT JOIN per_doc p ON p.doc_id = g.doc_id
"""


def _secret_sql() -> str:
    per_rule = []
    for rank, r in enumerate(RULES):
        p = _q(r.pattern)
        start = "list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0)"
        per_rule.append(
            f"SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, x.s::BIGINT AS start, (x.s + x.n)::BIGINT AS stop FROM "
            f"(SELECT doc_id, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{'s': {start}, 'n': length(hits[i]), 'k': length(held[i])}})) AS x "
            f"FROM (SELECT doc_id, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS hits, regexp_extract_all(t, {p}, {r.group}) AS held FROM d WHERE regexp_matches(t, {p}))) WHERE x.k >= {r.least}"
        )
    count = lambda i: f"count(*) FILTER (rank = {i})::BIGINT"
    text = "kind || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(per_rule)}),
per_doc AS (SELECT doc_id, {count(0)} AS a, {count(1)} AS b, {count(2)} AS c, string_agg({text}, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg({text}, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY 1)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per_doc USING (doc_id)
"""


OP3_SQL = _secret_sql()
OP10_SQL = _license_sql()
