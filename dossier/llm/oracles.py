"""SQL for DuckDB that gives the rows of the queries it can express."""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

LINES = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
s AS (SELECT row_number() OVER (ORDER BY doc_id, i) AS g, doc_id, i, line, ws, len(ws) AS n FROM (SELECT *, list_distinct(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS ws FROM l)),
t AS (SELECT g, n, unnest(ws) AS word FROM s WHERE n > 0), f AS (SELECT word, count(*) AS c FROM t GROUP BY 1),
p AS MATERIALIZED (SELECT g, n, word FROM (SELECT t.*, row_number() OVER (PARTITION BY g ORDER BY c, word) AS r FROM t JOIN f USING (word)) WHERE r <= n // 5 + 1),
pairs AS (SELECT DISTINCT a.g AS x, b.g AS y FROM p a JOIN p b ON a.word = b.word AND b.g < a.g AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
gone AS MATERIALIZED (SELECT DISTINCT x AS g FROM pairs JOIN s a ON a.g = x JOIN s b ON b.g = y WHERE 9 * len(list_intersect(a.ws, b.ws)) >= 4 * (a.n + b.n)),
kept AS (SELECT doc_id, count(*) AS n, count(gone.g) AS lost, string_agg(line, chr(10) ORDER BY i) FILTER (gone.g IS NULL) AS text FROM s LEFT JOIN gone USING (g) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM documents d LEFT JOIN kept USING (doc_id)
"""

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM late),
every AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w WHERE len(ws) > 0),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) FILTER (g.p IS NULL) AS kept, count(g.p) AS n_removed FROM every LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_REACH = """reach AS (SELECT id, id AS least FROM ids UNION SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.id AND r.least < l.b)"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS s FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
close AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
links AS (SELECT a, b FROM close UNION ALL SELECT b, a FROM close), ids AS (SELECT doc_id AS id FROM documents),
{_REACH}
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.least AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(least) AS least FROM reach GROUP BY 1) m ON m.id = w.doc_id
"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
close AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.u) = len(y.u) WHERE list_dot_product(x.u, y.u) >= 0.98),
links AS (SELECT a, b FROM close UNION ALL SELECT b, a FROM close), ids AS (SELECT vec_id AS id FROM v),
{_REACH}
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, m.least AS component_id, m.least = v.vec_id AS kept FROM v JOIN (SELECT id, min(least) AS least FROM reach GROUP BY 1) m ON m.id = v.vec_id
"""

_MARKS = r"^[ \t]*((?:>[ \t]?)+)"
_BLANK = r"\n[\x20\x09-\x0D]*\n"


def _said(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"


CONVERSATIONS = rf"""
WITH RECURSIVE m AS MATERIALIZED (SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
lv AS (SELECT id, i, length(regexp_replace(regexp_extract(x, '{_MARKS}', 1), '[^>]', '', 'g')) AS level, regexp_replace(x, '{_MARKS}', '') AS said FROM (SELECT id, unnest(string_split_regex(text, '\r?\n')) AS x, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS i FROM m)),
runs AS (SELECT *, sum(CASE WHEN level IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS run FROM (SELECT *, lag(level) OVER (PARTITION BY id ORDER BY i) AS prev FROM lv)),
seg AS MATERIALIZED (SELECT id, run, level, string_agg(said, chr(10) ORDER BY i) AS said FROM runs GROUP BY ALL),
whole AS MATERIALIZED (SELECT id, regexp_replace(regexp_replace(coalesce(string_agg(said, chr(10) ORDER BY run) FILTER (level = 0), ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body, max(level) AS quote_levels, count(*) FILTER (level > 0) AS n_passages FROM seg GROUP BY 1),
own AS (SELECT id, body AS said FROM whole UNION ALL SELECT id, said FROM seg JOIN whole USING (id) WHERE level = 0 AND n_passages > 0),
keys AS MATERIALIZED (SELECT DISTINCT conv_id, turn, k FROM (SELECT id, {_said('x')} AS k FROM (SELECT id, said AS x FROM own UNION ALL SELECT id, unnest(string_split_regex(said, '{_BLANK}')) FROM own UNION ALL SELECT id, unnest(string_split(said, chr(10))) FROM own)) JOIN m USING (id) WHERE k <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
quoted AS (SELECT id, level, said, row_number() OVER (PARTITION BY id ORDER BY run) AS p FROM seg WHERE level > 0),
parts AS (SELECT id, level, p, {_said('said')} AS a, unnest(string_split_regex(said, '{_BLANK}')) AS part, generate_subscripts(string_split_regex(said, '{_BLANK}'), 1) AS j FROM quoted),
ql AS MATERIALIZED (SELECT conv_id, turn, level, p, j, i, a, {_said('part')} AS b, {_said('x')} AS c FROM (SELECT *, unnest(string_split(part, chr(10))) AS x, generate_subscripts(string_split(part, chr(10)), 1) AS i FROM parts) JOIN m USING (id) WHERE {_said('x')} <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
votes AS (SELECT DISTINCT q.conv_id, q.turn, q.level, k.turn AS origin, p, j, i, length(c) AS n FROM (SELECT *, a AS k FROM ql UNION ALL SELECT *, b FROM ql UNION ALL SELECT *, c FROM ql) q JOIN keys k ON k.conv_id = q.conv_id AND k.k = q.k AND k.turn < q.turn),
links AS MATERIALIZED (SELECT conv_id, turn, arg_max(origin, {{'l': -level, 'n': n, 't': origin}}) AS parent_turn FROM (SELECT conv_id, turn, level, origin, sum(n) AS n FROM votes GROUP BY ALL) GROUP BY 1, 2),
up AS (SELECT conv_id, turn, parent_turn AS above, 1 AS depth FROM links UNION ALL SELECT u.conv_id, u.turn, l.parent_turn, u.depth + 1 FROM up u JOIN links l ON l.conv_id = u.conv_id AND l.turn = u.above),
roots AS (SELECT conv_id, turn, arg_max(above, depth) AS root_turn, max(depth) AS depth FROM up GROUP BY 1, 2),
o AS (SELECT m.conv_id, m.turn, role, parent_turn, coalesce(root_turn, m.turn) AS root_turn, CAST(coalesce(depth, 0) AS BIGINT) AS depth, CAST(quote_levels AS INT) AS quote_levels, CAST(n_passages AS INT) AS n_passages, body, '<|' || coalesce(role, '') || '|>' || chr(10) || body || chr(10) || '<|end|>' AS formatted
FROM m JOIN whole USING (id) LEFT JOIN links l ON l.conv_id = m.conv_id AND l.turn = m.turn LEFT JOIN roots r ON r.conv_id = m.conv_id AND r.turn = m.turn)
SELECT *, CASE WHEN conv_id IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id ORDER BY root_turn NULLS FIRST, turn NULLS FIRST, formatted) - 1 END AS position FROM o
"""
