"""DuckDB equivalents of the queries that SQL can express."""

from __future__ import annotations

from corpusloom.llm import pii

MIX = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix:' || doc_id) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + r % 3] AS w, CAST([-0.5, 0.0, 0.5][1 + r % 3] AS DOUBLE) AS slope FROM s),
f AS (SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS BIGINT) - CAST(2.0 AS DOUBLE) * CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
  / CAST(sum(w) OVER (ORDER BY source_size / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM w),
g AS (SELECT *, first_value(CASE WHEN level * w <= CAST(2.0 AS DOUBLE) * source_size THEN level END IGNORE NULLS) OVER (ORDER BY source_size / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS settled FROM f),
t AS (SELECT source, source_size, slope, CASE WHEN settled * w <= CAST(2.0 AS DOUBLE) * source_size THEN settled * w ELSE CAST(2.0 AS DOUBLE) * source_size END AS target FROM g),
o AS (SELECT d.*, t.source_size, t.target, t.slope, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, size) AS BIGINT) - size AS start, CAST(floor(target) AS BIGINT) AS words FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes FROM o),
q AS (SELECT *, size * passes + least(size, greatest(words - passes * source_size - start, 0)) AS taken, least(start / target, 1.0) AS share FROM p)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN round(CASE WHEN slope = 0 THEN share ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END, 6) + 0.0 END AS position FROM q"""

TOP_K = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
o AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM o WHERE rank <= 20"""

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INTEGER) WHEN CAST(reverse({_DIGITS})[i] AS INTEGER) > 4 THEN 2 * CAST(reverse({_DIGITS})[i] AS INTEGER) - 9 ELSE 2 * CAST(reverse({_DIGITS})[i] AS INTEGER) END)) % 10 = 0"
_TURNED = "substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4)"
_MOD97 = f"list_reduce(list_transform(string_split({_TURNED}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, b: CASE WHEN b < 10 THEN (a * 10 + b) % 97 ELSE (a * 100 + b) % 97 END, 0) = 1"
_IBAN = pii.IBAN
_OTHER = pii.OTHER_NUMBERS
#: Rank, kind, the contract's plain pattern, what confirms a match, its score in hundredths and the words that speak for it.
_KINDS = (
    (0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 90, "e-?mail|contact|address"),
    (1, "ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(TRY_CAST(p AS BIGINT), 999) <= 255))", 80, "ip|host|server"),
    (2, "card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}", 80, "card|visa|credit|payment"),
    (3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15", 80, "phone|tel|call|mobile"),
    (4, "iban", _IBAN, _MOD97, 80, "iban|account|bank|konto"),
    (5, "national_id", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT starts_with(m, '000') AND NOT starts_with(m, '9')", 50, "ssn|social|security|identity"),
)


def _kind(rank: int, kind: str, pattern: str, confirmed: str, score: int, words: str) -> str:
    near = lambda p: f"(regexp_matches(before, '{p}') OR regexp_matches(after, '{p}'))"
    return rf"""k{rank} AS (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM documents),
r{rank} AS (SELECT doc_id, text, ms[i] AS m, CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM k{rank}, unnest(range(1, len(ms) + 1)) u(i)),
c{rank} AS (SELECT doc_id, m, s, s + length(m) AS e, substr(text, greatest(s - 40, 0) + 1, least(s, 40)) AS before, substr(text, s + length(m) + 1, 40) AS after FROM r{rank}),
f{rank} AS (SELECT doc_id, {rank} AS r, '{kind}' AS kind, s, e, least(100, {score} + CASE WHEN {near(rf"(?i)\b({words})\b")} THEN 25 ELSE 0 END - CASE WHEN {near(_OTHER)} THEN 20 ELSE 0 END) AS score FROM c{rank} WHERE {confirmed})"""


PERSONAL = f"""
WITH {", ".join(_kind(*k) for k in _KINDS)},
spans AS ({" UNION ALL ".join(f"SELECT * FROM f{k[0]}" for k in _KINDS)}),
a AS (SELECT doc_id, count(*) FILTER (r = 0) AS n_email, count(*) FILTER (r = 1) AS n_ip, count(*) FILTER (r = 2) AS n_card, count(*) FILTER (r = 3) AS n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) FILTER (r < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) AS spans, string_agg(score, ',' ORDER BY s, r) AS scores
  FROM spans WHERE r < 4 OR score >= 70 GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM documents d LEFT JOIN a USING (doc_id)"""
