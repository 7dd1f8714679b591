"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import FLOORS, GRID, RULES
from .url_filter import DEFAULT_LIST, filter_rules

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""

OP4 = f"""
WITH i AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) END) AS win FROM i),
d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
p AS (SELECT doc_id, s.n, unnest(range(1, len(w) - s.n + 2)) AS ps, w FROM d, (SELECT DISTINCT n FROM k) s WHERE len(w) >= s.n),
h AS (SELECT p.doc_id, p.n, p.ps, k.item_id FROM p JOIN k ON k.n = p.n AND k.win = array_to_string(p.w[p.ps:p.ps + p.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(ps, ps + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

_BLOCKED = " OR ".join(f"regexp_matches(lower(url), '{p.pattern}')" for p in filter_rules(DEFAULT_LIST.splitlines()))
OP7 = f"""
WITH s AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, url, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, arg_max((h || p, v), length(h || p)) AS best FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, best[1] AS rule, CASE WHEN best IS NOT NULL THEN best[2] WHEN coalesce({_BLOCKED}, FALSE) THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN m ON m.page_id = u.page_id"""

_GRID = ", ".join(f"({i}, {c}::DOUBLE)" for i, c in enumerate(GRID))
_FLOORS = ", ".join(f"('{r}', {c}::DOUBLE)" for r, c in FLOORS.items())
_RISK = f"{0.02 / len(RULES)!r}::DOUBLE"
OP10 = f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SPACED}')) AS ln FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
h AS (SELECT g.doc_id, count(DISTINCT g.i + s.k) AS n FROM g JOIN (SELECT doc_id, win FROM g GROUP BY ALL HAVING count(*) > 1) d ON d.doc_id = g.doc_id AND d.win = g.win, (SELECT unnest(range(5)) AS k) s GROUP BY g.doc_id),
b AS (SELECT w.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ln) - len(list_distinct(ln)) AS n_dup_lines,
        coalesce(h.n, 0) AS n_repeat_words, len(ln) AS n_lines, len(regexp_extract_all(t, '\\p{{Lu}}')) AS caps, len(regexp_extract_all(t, '[!?]{{2,}}')) AS shouts,
        len(list_filter(string_split(replace(t, chr(10), ' '), ' '), lambda x: x = '|')) AS bars FROM w LEFT JOIN h ON h.doc_id = w.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
r AS (SELECT doc_id, lang, unnest(['symbols', 'capitals', 'shouts', 'bars', 'dup_lines']) AS rule, unnest([n_symbols / greatest(word_chars, 1), caps / greatest(word_chars, 1), shouts / greatest(n_words, 1),
        bars / greatest(n_words, 1), n_dup_lines / greatest(n_lines, 1)]) AS score FROM f),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
lr AS (SELECT r.*, q.quality FROM r JOIN q ON q.doc_id = r.doc_id),
fl(rule, least) AS (VALUES {_FLOORS}),
gr(g, cutoff) AS (VALUES {_GRID}),
hh AS (SELECT doc_id, lang, quality, rule, g, score > cutoff AS hit FROM lr, gr
      UNION ALL SELECT doc_id, lang, quality, 'joint', g, bool_or(score > greatest(cutoff, least)) FROM lr JOIN fl ON fl.rule = lr.rule, gr GROUP BY doc_id, lang, quality, g),
c AS (SELECT lang, rule, g, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality <> 1) AS bad, count(*) FILTER (quality = 1 AND hit) AS k, count(*) FILTER (quality <> 1 AND hit) AS caught
        FROM (SELECT lang, quality, rule, g, hit FROM hh UNION ALL SELECT NULL, quality, rule, g, hit FROM hh) GROUP BY lang, rule, g),
e AS (SELECT *, CASE WHEN rule = 'joint' THEN 0.02::DOUBLE ELSE {_RISK} END AS risk, 0.025::DOUBLE / (count(*) FILTER (rule = 'joint') OVER (PARTITION BY g) * CASE WHEN rule = 'joint' THEN 1 ELSE {len(RULES)} END) AS level FROM c),
p AS (SELECT *, CASE WHEN k >= n * risk THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(risk) + (n - i) * ln(1 - risk)))) END AS p FROM e),
o AS (SELECT *, min(CASE WHEN p <= level THEN 1 ELSE 0 END) OVER (PARTITION BY lang, rule ORDER BY g) AS ok, CASE WHEN n > 0 THEN caught / greatest(bad, 1) - 10 * k / n ELSE 0 END AS gain FROM p),
z AS (SELECT lang, rule, arg_max(g, (gain, -g)) AS g, max(gain) AS gain FROM o WHERE ok = 1 AND gain > 0 GROUP BY lang, rule),
u AS (SELECT lang, round(coalesce(max(gain) FILTER (rule = 'joint'), 0), 9) > round(coalesce(sum(gain) FILTER (rule <> 'joint'), 0), 9) AS joint FROM z GROUP BY lang),
t AS (SELECT u.lang, z.rule, gr.cutoff FROM u JOIN z ON z.lang IS NOT DISTINCT FROM u.lang AND NOT joint AND z.rule <> 'joint' JOIN gr ON gr.g = z.g
      UNION ALL SELECT u.lang, fl.rule, greatest(gr.cutoff, fl.least) FROM u JOIN z ON z.lang IS NOT DISTINCT FROM u.lang AND joint AND z.rule = 'joint' JOIN gr ON gr.g = z.g, fl),
s AS (SELECT r.*, CASE WHEN r.lang IN (SELECT lang FROM u WHERE lang IS NOT NULL) THEN r.lang END AS source FROM r),
x AS (SELECT DISTINCT s.doc_id FROM s JOIN t ON t.lang IS NOT DISTINCT FROM s.source AND t.rule = s.rule AND s.score > t.cutoff)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND x.doc_id IS NULL AS kept FROM f LEFT JOIN x ON x.doc_id = f.doc_id"""

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_SHARE = "(1 + 1000000000::HUGEINT * ({} + 1) // ({} + {}))"
_GAP = "((p - q) * (p - q) // q)::BIGINT"
OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '{_TERM}')) AS term FROM d),
k AS (SELECT lang, term, count(*)::BIGINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*)::BIGINT AS v, sum(n)::BIGINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*)::BIGINT AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::BIGINT AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS c, {_SHARE.format("coalesce(c.n, 0)", "n.n", "v.v")} AS p, {_SHARE.format("k.n", "v.n", "v.v")} AS q
      FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT lang, source, item, sum({_GAP}) AS f FROM (SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source) GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.f, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, {_GAP} FROM p WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM o) WHERE part = 'pair' OR rank <= 200"""

_SAID = r"\### Assistant: </turn> ok"
_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '### ', '##\# '), '</', '<\/')"
_NAMED = f"CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE '.' || replace({_ESCAPED.format('role')}, ': ', ':\\ ') END"
OP11 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}'))),
f AS (SELECT *, '### ' || {_NAMED} || ': ' || {_ESCAPED.format("text")} || '</turn>' || chr(10) AS piece FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(length(piece))::BIGINT AS formatted_chars FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

_DOT = "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT"
OP12 = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, {_DOT} AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
