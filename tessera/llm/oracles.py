"""DuckDB SQL with the same rows as the queries, where SQL can express them."""

ORACLES: dict[str, str] = {}

ORACLES["op1_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS t FROM p),
low AS (SELECT t, min(doc_id) AS lowest FROM win GROUP BY t),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM win JOIN low USING (t) WHERE lowest < doc_id),
g AS (SELECT doc_id, list(i) AS i FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(g.i), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, k: NOT list_contains(coalesce(g.i, []), k)), ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op4_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bs AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM bs),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM ds),
hit AS (SELECT doc_id, n, s, item_id FROM dw JOIN bw USING (n, t)),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


# The contract's three patterns and the five further formats, written out here apart from the operator.
_SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''"), 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("jwt", "eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}", 0, 0),
)
_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, r, {k} AS k, '{name}' AS kind, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS g, regexp_split_to_array(t, '{p}') AS gap, {least} AS least FROM d"
    for k, (name, p, group, least) in enumerate(_SECRETS)
)
ORACLES["op6_secret_scan"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_MATCHES}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m WHERE len(m) > 0),
f AS (SELECT r, k, kind, list_sum(list_transform(gap[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS a, length(m[i]) AS n FROM i WHERE length(g[i]) >= least),
j AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (r)
"""


# The licence sentences of the tables, written out here apart from the operator; each is a whole line or sentence.
ORACLES["op9_license_scan"] = r"""
WITH k(s, id, licence) AS (VALUES
  ('released under the mit license', 'mit/notice', 'MIT'),
  ('licensed under the apache license version 2 0', 'apache-2.0/notice', 'Apache-2.0'),
  ('this work is licensed under the gnu general public license version 3', 'gpl-3.0/notice', 'GPL-3.0-only'),
  ('licensed under cc by nc 4 0', 'cc-by-nc-4.0/notice', 'CC-BY-NC-4.0')),
d AS (SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_split_to_array(lower(coalesce(text, '')), '\n|[.!?;:]+(?:[\x20\t\r]+|$)'), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))) AS s FROM documents),
u AS (SELECT r, unnest(s) AS s, unnest(range(1, len(s) + 1)) AS i FROM d),
f AS (SELECT r, count(*) AS n_known, string_agg(id, ',' ORDER BY i) AS sequence, array_to_string(list_sort(list(DISTINCT licence)), ',') AS licenses FROM u JOIN k USING (s) GROUP BY r)
SELECT doc_id, coalesce(n_known, 0)::BIGINT AS n_known, coalesce(sequence, '') AS sequence, coalesce(licenses, '') AS licenses FROM d LEFT JOIN f USING (r)
"""

ORACLES["op5_near_dedup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM c JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
e AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) m USING (doc_id)
"""

# Every page of the tables marks its article, whose blocks are the main text.
ORACLES["op3_html_extract"] = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g') AS a FROM pages),
t AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM a),
u AS (SELECT page_id, url, regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS text FROM t)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM u
"""

_CHECKSUM = "xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
ORACLES["op12_merkle"] = f"""
WITH RECURSIVE l AS (SELECT row_number() OVER () AS r, doc_id, source, sha256({_HEAD} || {_FIELD.format("text")}) AS leaf,
    CASE WHEN {_CHECKSUM} % 2 = 0 THEN sha256({_HEAD} || {_FIELD.format("replace(text, chr(10), '')")}) END AS other FROM documents),
s AS (SELECT r, doc_id, leaf, other, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t FROM l),
up AS (SELECT t, 0 AS lvl, i, leaf AS h, n FROM s UNION ALL SELECT t, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY t, lvl, i // 3, n),
sub AS (SELECT t, h, count(*) OVER () AS n FROM up WHERE n = 1),
crown AS (SELECT 0 AS lvl, t AS i, h, n FROM sub UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM crown WHERE n > 1 GROUP BY lvl, i // 3, n),
nodes AS (SELECT t, lvl, i, h FROM up WHERE n > 1 UNION ALL SELECT NULL, 100 + lvl, i, h FROM crown WHERE n > 1),
places AS (SELECT s.r, s.t AS t, k.lvl, s.i // pow(3, k.lvl)::BIGINT AS i FROM s, (SELECT DISTINCT lvl FROM nodes WHERE lvl < 100) k UNION ALL SELECT s.r, -1, k.lvl, s.t // pow(3, k.lvl - 100)::BIGINT FROM s, (SELECT DISTINCT lvl FROM nodes WHERE lvl >= 100) k),
sides AS (SELECT p.r, p.lvl, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < p.i), '') AS a, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > p.i), '') AS b FROM places p JOIN nodes u ON coalesce(u.t, -1) = p.t AND u.lvl = p.lvl AND u.i // 3 = p.i // 3 GROUP BY p.r, p.lvl),
paths AS (SELECT r, list({{'a': a, 'b': b}} ORDER BY lvl) AS p, string_agg(a || b, '' ORDER BY lvl) AS q FROM sides GROUP BY r),
fold AS (SELECT s.r, 0 AS k, coalesce(other, leaf) AS h, p FROM s LEFT JOIN paths USING (r) UNION ALL SELECT r, k + 1, sha256(p[k + 1].a || h || p[k + 1].b), p FROM fold WHERE k < len(p)),
ends AS (SELECT r, h FROM fold WHERE k = coalesce(len(p), 0))
SELECT s.doc_id, s.leaf, sub.h AS subroot, c.h AS root, sha256(coalesce(q, '')) AS proof_sha256, e.h AS folded_root, e.h = c.h AS verified
FROM s JOIN sub ON sub.t = s.t JOIN crown c ON c.n = 1 JOIN ends e USING (r) LEFT JOIN paths USING (r)
"""

ORACLES["op13_collocations"] = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLD}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
u AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM u GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM u, range(1, 5) r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail FROM c, range(1, 4) r(cut) WHERE cut < k),
y AS (SELECT x.*, h.f AS l, t.f AS r, (2000000::HUGEINT * a // (h.f + t.f))::BIGINT AS score FROM x JOIN f h ON h.lang = x.lang AND h.phrase = head JOIN f t ON t.lang = x.lang AND t.phrase = tail),
b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
k AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 80 * b.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k) JOIN n USING (lang) WHERE rank <= 2000
"""
