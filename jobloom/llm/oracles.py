"""DuckDB SQL for the corpus queries that SQL expresses on whole small tables: plain comparisons of all
windows, lines, shingles and vectors."""

from __future__ import annotations

from jobloom.llm.licenses import BASE, TEMPLATES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, min(o.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN reach ON reach.a = d.r LEFT JOIN d o ON o.r = reach.b GROUP BY d.r, d.doc_id
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
p AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS p FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
o AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS p FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT o.r, o.i, o.n, p.item FROM o JOIN p ON o.p = p.p AND o.n = p.n),
x AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM h) GROUP BY r),
y AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN x ON x.r = d.r LEFT JOIN y ON y.r = d.r
"""

_DOT = lambda a, b: f"list_reduce(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]), lambda x, y: x + y)"  # noqa: E731  summed from the first component on

NEIGHBOURS = f"""
WITH v AS (SELECT vec_id, e, sqrt({_DOT('e', 'e')}) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, {_DOT('q.e', 'c.e')} / (q.n * c.n) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""


def _licenses() -> str:
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in BASE.items())
    templates = ", ".join(f"('{t.label}', {t.words}, {list(t.marks)}, {list(t.without) or '[]::VARCHAR[]'}, {t.need()}, {t.span})" for t in TEMPLATES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER} AS t, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
p(phrase, label, n) AS (VALUES {phrases}), t(label, words, marks, without, need, span) AS (VALUES {templates}),
b AS (SELECT r, i - 1 AS pos, label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) o JOIN p ON array_to_string(o.w[o.i : o.i + p.n - 1], ' ') = p.phrase),
f AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY r),
l AS (SELECT r, label, words, marks, without, need, list_distinct(w[i : i + span - 1]) AS own FROM (SELECT d.r, d.w, t.*, unnest(range(1, len(d.w) + 1)) AS i FROM d JOIN t ON list_has_all(d.w, t.marks))),
m AS (SELECT r, label, len(list_intersect(own, words)) / len(words) AS score FROM l WHERE list_has_all(own, marks) AND NOT list_has_any(own, without) AND len(list_intersect(own, words)) >= need),
g AS (SELECT r, max(score) AS best FROM m GROUP BY r),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b UNION SELECT r, label FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM d LEFT JOIN f ON f.r = d.r LEFT JOIN a ON a.r = d.r LEFT JOIN g ON g.r = d.r
"""


HARD_NEGATIVES = """
WITH v AS (SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])), 0) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_AT = lambda kind, pattern, test: rf"""SELECT r, {kind} AS kind, a - length(m) AS a, a AS e, m FROM (
  SELECT r, m, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS a FROM (SELECT r, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(gaps[1 : len(ms)]) AS gap FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM d WHERE regexp_matches(t, '{pattern}')))) WHERE {test}"""  # noqa: E731

SANITISATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  {_AT(0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', 'true')}
  UNION ALL {_AT(1, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+', "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INT), 0) > 255)) = 0")}
  UNION ALL {_AT(2, '[0-9]([ -]?[0-9])+', f"length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CAST(substr(reverse({_DIGITS}), CAST(i AS INT), 1) AS INT) * (2 - i % 2) - CASE WHEN i % 2 = 0 AND CAST(substr(reverse({_DIGITS}), CAST(i AS INT), 1) AS INT) > 4 THEN 9 ELSE 0 END)) % 10 = 0")}
  UNION ALL {_AT(3, '[+][0-9][ ().0-9-]+[0-9]', f"length({_DIGITS}) BETWEEN 10 AND 15")}),
named AS (SELECT r, a, e, kind, kind || ':' || CASE WHEN kind < 2 THEN lower(m) ELSE {_DIGITS} END AS entity FROM base),
tokens AS (SELECT r, a - length(m) AS a, a AS e, m AS w FROM (SELECT r, m, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS a FROM (
  SELECT r, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(gaps[1 : len(ms)]) AS gap FROM (SELECT r, regexp_extract_all({_LOWER.replace('text', 't')}, '{_ALNUM}') AS ms, string_split_regex({_LOWER.replace('text', 't')}, '{_ALNUM}') AS gaps FROM d)))),
clear AS (SELECT r, a, e, w, row_number() OVER (PARTITION BY r ORDER BY a) AS k FROM tokens x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = x.r AND b.a < x.e AND x.a < b.e)),
words AS (SELECT r, a, e, k, w, CASE WHEN length(w) > 3 THEN left(w, 3) || '*' END AS letters, coalesce(lag(w, 16) OVER o, '') || ' ' || coalesce(lead(w, 16) OVER o, '') AS around FROM clear WINDOW o AS (PARTITION BY r ORDER BY k)),
terms AS (SELECT r, k, w AS term, around FROM words UNION ALL SELECT r, k, letters, around FROM words WHERE letters IS NOT NULL),
place AS (SELECT DISTINCT n.r, n.entity, n.a, (SELECT count(*) FROM clear c WHERE c.r = n.r AND c.a < n.a) AS before FROM named n),
near AS (SELECT p.r, entity, term, arg_min(around, k) AS around FROM place p JOIN terms t ON t.r = p.r AND t.k > before - 8 AND t.k <= before + 8 GROUP BY ALL),
pairs AS (SELECT entity, term, sum(n) AS n_et FROM (SELECT entity, term, around, count(*) AS n FROM near GROUP BY ALL) GROUP BY ALL HAVING sum(n) >= 3 AND 2 * max(n) <= sum(n)),
n_e AS (SELECT entity, count(DISTINCT r) AS n_e FROM named GROUP BY entity), n_t AS (SELECT term, count(DISTINCT r) AS n_t FROM terms GROUP BY term), total AS (SELECT count(*) AS n FROM d),
told AS (SELECT DISTINCT term FROM pairs JOIN n_e USING (entity) JOIN n_t USING (term), total WHERE n_e < n AND log2(n * n_et / (n_e * n_t)) >= 0.9 * log2(n / n_e)),
spans AS (SELECT r, a, e, kind, ['email', 'ip', 'card', 'phone'][kind + 1] AS name FROM base UNION ALL SELECT r, a, e, 4, 'term' FROM words WHERE w IN (FROM told)),
by_row AS (SELECT r, string_agg(name || ':' || a || ':' || e, ',' ORDER BY a, kind) AS spans, coalesce(string_agg(name || ':' || a || ':' || e, ',' ORDER BY a, kind) FILTER (WHERE kind < 4), '') AS base, {', '.join(f"count(*) FILTER (WHERE kind = {i}) AS n_{x}" for i, x in enumerate(('email', 'ip', 'card', 'phone')))} FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN by_row USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": JACCARD, "op4_decontamination": DECONTAMINATION, "op8_licenses": _licenses(), "op9_neighbours": NEIGHBOURS, "op11_sanitisation": SANITISATION, "op12_hard_negatives": HARD_NEGATIVES}
