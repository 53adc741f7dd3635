"""SQL for DuckDB that gives the queries' rows another way: windows and joins where the engine folds columns."""

from __future__ import annotations

from dossier.functions import fixed
from dossier.functions.textkit import any_of
from dossier.plans import resumes
from dossier.plans.render import FIELDS
from dossier.sources.ontology import Ontology

_NL = "chr(10)"
_WHITE = r"' \t\n\r\x0b\x0c'".replace(r"\t", "' || chr(9) || '").replace(r"\n", "' || chr(10) || '").replace(r"\r", "' || chr(13) || '").replace(r"\x0b", "' || chr(11) || '").replace(r"\x0c", "' || chr(12) || '")


def q(text: str) -> str:
    """An SQL literal."""
    return "'" + text.replace("'", "''").replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '") + "'"


def strip(x: str, chars: str | None = None) -> str:
    return f"trim({x}, {_WHITE if chars is None else q(chars)})"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w_: w_ <> '')"


def clean_literals(x: str) -> str:
    x = f"translate({x}, '‘’“”–—―' || chr(160) || chr(8203) || chr(65279) || chr(13), '''''\"\"--- ')"
    return f"replace(replace({x}, '…', '...'), chr(9), '    ')"


def clean_controls(x: str) -> str:
    return rf"regexp_replace(nfc_normalize({x}), '[\x00-\x09\x0b-\x1f\x7f-\x9f\p{{Cf}}\p{{Co}}]|[\x{{10000}}-\x{{10FFFF}}]', ' ', 'g')"


def clean_pages(x: str) -> str:
    for p in [*fixed.PAGE_LINES, fixed.DIVIDER_LINES]:
        x = f"regexp_replace({x}, {q(p)}, '', 'g')"
    return x


def clean_bullets(x: str) -> str:
    glyphs = f"[{fixed.BULLETS}]"
    line = strip("l_")
    one = rf"CASE WHEN NOT regexp_matches({line}, '^°\s*[A-Z\s]+\s*°$') AND regexp_matches({line}, '^{glyphs}') THEN '- ' || {strip(f"regexp_replace({line}, '^{glyphs}+" + r"\s*', '')")} ELSE {line} END"
    return f"array_to_string(list_transform(string_split({x}, {_NL}), lambda l_: {one}), {_NL})"


def clean_white(x: str) -> str:
    tidy = f"array_to_string(list_transform(string_split(regexp_replace({x}, '[ ' || chr(9) || ']+', ' ', 'g'), {_NL}), lambda m_: {strip('m_')}), {_NL})"
    return strip(rf"regexp_replace({tidy}, '\n{{3,}}', {_NL} || {_NL}, 'g')")


def clean(x: str) -> str:
    return clean_white(clean_bullets(clean_pages(clean_controls(clean_literals(f"coalesce({x}, '')")))))


def _values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + f") {names}"


#: raw(doc_id, text); ready: cleaned; lines; marked: with section; sec(doc_id, section, text)
READY = f"raw AS MATERIALIZED ({resumes.sql()}), ready AS MATERIALIZED (SELECT doc_id, {clean('text')} AS text FROM raw)"
_KEY = rf"lower(regexp_replace(regexp_replace({strip('line')}, '^[\s#*\-_~>|•·°º]+', ''), '[\s#*\-_~:|•·°º]+$', ''))"
SECTIONS = f"""{READY},
headings AS (SELECT * FROM {_values([(n, s) for s, names in fixed.SECTIONS.items() for n in names], "t(name, section)")}),
lines AS (SELECT doc_id, unnest(string_split(text, {_NL})) AS line, generate_subscripts(string_split(text, {_NL}), 1) AS line_no FROM ready),
opened AS (SELECT l.*, h.section AS opens FROM lines l LEFT JOIN headings h ON h.name = {_KEY} AND {strip('line')} <> '' AND length({strip('line')}) <= 60),
marked AS (SELECT *, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 'contact') AS section FROM opened),
sec AS MATERIALIZED (SELECT doc_id, section, {strip(f"coalesce(string_agg(line, {_NL} ORDER BY line_no) FILTER (opens IS NULL), '')")} AS text FROM marked GROUP BY ALL)"""


def part(section: str) -> str:
    return f"(SELECT r.doc_id, coalesce(s.text, '') AS text FROM ready r LEFT JOIN sec s ON s.doc_id = r.doc_id AND s.section = '{section}')"


def extract(x: str, pattern: str) -> str:
    return f"nullif(regexp_extract({x}, {q(pattern)}), '')"


def phone_format(x: str) -> str:
    d = rf"regexp_replace({x}, '\D', '', 'g')"
    us = lambda a: f"'+1 (' || substr({d}, {a}, 3) || ') ' || substr({d}, {a + 3}, 3) || '-' || substr({d}, {a + 6}, 4)"
    return f"CASE WHEN coalesce({x}, '') = '' THEN NULL WHEN length({d}) = 10 THEN {us(1)} WHEN length({d}) = 11 AND {d} LIKE '1%' THEN {us(2)} WHEN length({d}) = 12 AND {d} LIKE '91%' THEN '+91 ' || substr({d}, 3, 5) || ' ' || substr({d}, 8, 5) ELSE {strip(x)} END"


def phone(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace({x}, '\b(?:19|20)\d{{2}}\s*[-–—]\s*(?:19|20)\d{{2}}\b', ' ', 'g'), '\b(?:19|20)\d{{2}}\b', ' ', 'g')"
    first = rf"list_filter(regexp_extract_all({bare}, {q(fixed.PHONE)}), lambda n_: length(regexp_replace(n_, '\D', '', 'g')) BETWEEN 9 AND 15)[1]"
    return phone_format(first)


def _scheme(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} LIKE 'http%' THEN {x} ELSE 'https://' || {x} END"


def linkedin(x: str) -> str:
    return _scheme(extract(x, fixed.LINKEDIN))


def portfolio(x: str) -> str:
    other = f"list_filter(regexp_extract_all({x}, {q(fixed.URL)}), lambda u_: NOT contains(coalesce({linkedin(x)}, ''), u_) AND NOT regexp_matches(lower(u_), {q(any_of(fixed.MAIL_HOSTS))}))[1]"
    return f"coalesce({_scheme(extract(x, fixed.GITHUB))}, {other})"


def title(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '\p{{L}}+|\P{{L}}+'), lambda t_: upper(t_[1]) || lower(t_[2:])), '')"


#: names(doc_id, name) of heads(doc_id, text)
NAMES = rf"""
top AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, {_NL}), lambda l_: {strip('l_')}), lambda l_: l_ <> '')[1:10]) AS line, generate_subscripts(list_filter(list_transform(string_split(text, {_NL}), lambda l_: {strip('l_')}), lambda l_: l_ <> '')[1:10], 1) AS n FROM heads),
bare AS (SELECT *, {strip(r"regexp_replace(line, '[,|•·\-_°º]', ' ', 'g')")} AS bare FROM top),
split AS (SELECT *, {words('bare')} AS w FROM bare),
fit AS (SELECT *, len(list_filter(w, lambda x_: regexp_full_match(x_, '\p{{L}}+') AND x_ = upper(x_) AND x_ <> lower(x_))) = len(w) AS caps,
  NOT regexp_matches(line, {q(fixed.EMAIL)}) AND NOT regexp_matches(line, {q(fixed.PHONE)}) AND NOT contains(lower(line), 'http') AND NOT contains(line, '@') AND NOT regexp_matches(line, '\d')
  AND len(list_filter(w, lambda x_: regexp_full_match(replace(x_, '.', ''), '\p{{L}}+') AND x_ <> lower(x_) AND (x_ = upper(x_) OR x_ = {title('x_')}))) = len(w) AS titled
  FROM split WHERE len(w) BETWEEN 2 AND 4 AND NOT list_has_any(list_transform(w, lambda x_: lower(x_)), [{', '.join(map(q, fixed.NOT_NAMES))}])),
names AS (SELECT h.doc_id, {title("coalesce((SELECT arg_min(bare, n) FROM fit f WHERE f.doc_id = h.doc_id AND caps), (SELECT arg_min(array_to_string(w, ' '), n) FROM fit f WHERE f.doc_id = h.doc_id AND titled))")} AS name FROM heads h)"""
HEADS = f"heads AS (SELECT s.doc_id, CASE WHEN s.text <> '' THEN s.text ELSE substr(r.text, 1, 600) END AS text FROM {part('contact')} s JOIN ready r USING (doc_id))"

_RANGE, _DATE = "(?i)" + fixed.DATE_RANGE, "(?i)" + fixed.DATE


def full(x: str, pattern: str) -> str:
    return f"regexp_full_match({x}, {q(pattern)})"


def has(x: str, texts: list[str]) -> str:
    return f"regexp_matches(lower({x}), {q(any_of(texts))})"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def halves(source: str, key: str, x: str, kind: str) -> str:
    """SELECT of (key columns, a, b): title and company, or degree and institution, of text column ``x``."""
    separators = fixed.TITLE_SEPARATORS if kind == "title" else fixed.DEGREE_SEPARATORS
    seps = _values([(n, s) for n, s in enumerate(separators)], "s(n, sep)")
    cases = []
    for n, s in enumerate(separators):
        cases.append(f"WHEN {n} THEN string_split_regex(bare_, {q(s)})")
    edge = fixed.EDGE_COMMA
    rest = strip(f"array_to_string(list_transform(list_filter(p_[2:], lambda y_: {strip('y_')} <> ''), lambda y_: {strip('y_', edge)}), ' ')")
    if kind == "title":
        order = f"CASE WHEN {has('a_', fixed.JOBS)} THEN 1 WHEN {has('b_', fixed.JOBS)} THEN 2 END"
    else:
        da, db, ca, cb = has("a_", fixed.DEGREES), has("b_", fixed.DEGREES), has("a_", fixed.COLLEGES), has("b_", fixed.COLLEGES)
        order = f"CASE WHEN {full('a_', _DATE)} THEN NULL WHEN {da} AND {cb} THEN 1 WHEN {db} AND {ca} THEN 2 WHEN {da} AND {n_words('b_')} <= 8 THEN 1 END"
    cut = f"SELECT {key}, n, CASE n {' '.join(cases)} END AS p_ FROM (SELECT *, {strip(x, fixed.EDGE)} AS bare_ FROM {source}), {seps} WHERE bare_ <> ''"
    two = f"SELECT {key}, n, {strip('p_[1]', edge)} AS a_, {rest} AS b_ FROM ({cut}) WHERE len(p_) >= 2"
    order_ = f"SELECT {key}, n, a_, b_, {order} AS o_ FROM ({two}) WHERE a_ <> '' AND b_ <> '' AND NOT {full('a_', _RANGE)} AND NOT {full('b_', _RANGE)}"
    return f"SELECT {key}, arg_min(CASE o_ WHEN 1 THEN a_ ELSE b_ END, n) AS a, arg_min(CASE o_ WHEN 1 THEN b_ ELSE a_ END, n) AS b FROM ({order_}) WHERE o_ IS NOT NULL GROUP BY ALL"


def starts(x: str, chars: str) -> str:
    return f"contains({q(chars)}, left({x}, 1)) AND {x} <> ''"


def blocks(section: str) -> str:
    """CTEs that end in ``blk(doc_id, block_no, block)`` of a section."""
    return rf"""own AS (SELECT * FROM {part(section)}),
parted AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex({strip('text')}, '\n\s*\n+'), lambda b_: {strip('b_')}), lambda b_: b_ <> '') AS bs FROM own),
ln AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(list_filter(string_split(text, {_NL}), lambda l_: {strip('l_')} <> '')) AS line, generate_subscripts(list_filter(string_split(text, {_NL}), lambda l_: {strip('l_')} <> ''), 1) AS i FROM parted WHERE len(bs) <= 1 AND contains(text, {_NL}))),
sp AS ({halves('ln', 'doc_id, i', 'line', 'title')}),
hd AS (SELECT l.doc_id, l.i, l.line, NOT ({starts(strip('line'), fixed.BULLET_STARTS)}) AND NOT regexp_matches({strip('line')}, {q(fixed.COURSE_LINE)}) AND NOT regexp_matches(line, {q(_DATE)})
  AND (sp.a IS NOT NULL OR ({has(strip('line'), fixed.JOBS + fixed.DEGREES)} AND {n_words(strip('line'))} <= 7 AND NOT regexp_matches(line, '[.;]'))) AS head FROM ln l LEFT JOIN sp ON sp.doc_id = l.doc_id AND sp.i = l.i),
st AS (SELECT doc_id, list_reduce(list({{'line': line, 'head': head}} ORDER BY i), lambda s, r: CASE WHEN r.head AND s.held >= 2 THEN {{'b': list_append(s.b, r.line), 'held': 1}} ELSE {{'b': list_append(s.b[1:len(s.b) - 1], CASE WHEN s.held = 0 THEN r.line ELSE s.b[len(s.b)] || {_NL} || r.line END), 'held': s.held + 1}} END, {{'b': ['']::VARCHAR[], 'held': 0}}).b AS b FROM hd GROUP BY doc_id),
chosen AS (SELECT p.doc_id, CASE WHEN len(st.b) > 1 THEN list_transform(st.b, lambda b_: {strip('b_')}) ELSE p.bs END AS bs FROM parted p LEFT JOIN st USING (doc_id)),
blk AS (SELECT doc_id, unnest(bs) AS block, generate_subscripts(bs, 1) AS block_no FROM chosen)"""


_LINES = f"""bl AS (SELECT doc_id, block_no, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, block_no, list_filter(list_transform(string_split(block, {_NL}), lambda l_: {strip('l_')}), lambda l_: l_ <> '') AS ls FROM blk))"""


def experience(more: str = "") -> str:
    """SELECT of a job's fields, with the columns ``more`` of its block first."""
    edge, comma = fixed.EDGE, fixed.EDGE_COMMA
    undated = strip(f"regexp_replace(line, {q(_RANGE)}, '', 'g')", comma)
    bullet = starts("line", fixed.BULLET_STARTS)
    only = "(s.dates = '' AND r.date <> '' AND r.alone)"
    both = f"(NOT {only} AND (s.title = '' OR s.company = '') AND r.a IS NOT NULL)"
    job = f"(NOT {only} AND NOT {both} AND r.job AND s.title = '')"
    firm = f"(NOT {only} AND NOT {both} AND NOT {job} AND r.firm AND s.company = '')"
    step = f"""{{'title': CASE WHEN {job} THEN r.bare WHEN {both} AND s.title = '' THEN r.a ELSE s.title END, 'company': CASE WHEN {firm} THEN r.bare WHEN {both} AND s.company = '' THEN r.b ELSE s.company END,
 'dates': CASE WHEN s.dates = '' THEN r.date ELSE s.dates END, 'told': CASE WHEN {only} OR {both} OR {job} OR {firm} THEN s.told ELSE s.told || {_NL} || r.line END}}"""
    return f"""WITH {SECTIONS}, {blocks('experience')}, {_LINES},
sb AS ({halves('bl', 'doc_id, block_no, i', 'line', 'title')}),
f AS (SELECT bl.*, {strip('line', edge)} AS bare, {strip(f"regexp_extract(line, {q(_RANGE)})")} AS date, {undated} = '' AS alone, a, b, NOT ({bullet}) AND {n_words(strip('line', edge))} <= 6 AND {has('line', fixed.JOBS)} AS job,
  NOT ({bullet}) AND {n_words(strip('line', edge))} <= 6 AND {has('line', fixed.FIRMS)} AS firm, NOT ({starts('line', fixed.SHORT_BULLET_STARTS)}) AND NOT regexp_matches(line, {q(_RANGE)}) AS plain FROM bl LEFT JOIN sb USING (doc_id, block_no, i)),
e AS (SELECT doc_id, block_no, list_reduce(list({{'line': line, 'bare': bare, 'date': date, 'alone': alone, 'a': a, 'b': b, 'job': job, 'firm': firm}} ORDER BY i), lambda s, r: {step}, {{'title': '', 'company': '', 'dates': '', 'told': ''}}) AS s, arg_min(line, i) FILTER (plain) AS spare FROM f GROUP BY ALL)
SELECT doc_id, {more}s.company AS company, CASE WHEN s.title = '' THEN coalesce({strip('spare', edge)}, '') ELSE s.title END AS title, s.dates AS dates, {strip('s.told')} AS description FROM e WHERE s.company <> '' OR s.title <> '' OR coalesce({strip('spare', edge)}, '') <> ''"""


def education(more: str = "") -> str:
    """SELECT of a degree's fields, with the columns ``more`` of its block first."""
    comma = fixed.EDGE_COMMA
    date = f"CASE WHEN regexp_matches(line, {q(_RANGE)}) THEN {strip(f'regexp_extract(line, {q(_RANGE)})')} ELSE {strip(f'regexp_extract(line, {q(_DATE)})')} END"
    undated = strip(f"regexp_replace({strip(f'regexp_replace(line, {q(_RANGE)}, {chr(39)*2}, {q(chr(103))})', comma)}, {q(_DATE)}, '', 'g')", comma)
    out = "((s.dates = '' AND r.date <> '' AND r.alone) OR r.skip)"
    both = f"(NOT {out} AND (s.degree = '' OR s.institution = '') AND r.a IS NOT NULL)"
    degree = f"(NOT {out} AND NOT {both} AND r.degree AND s.degree = '')"
    college = f"(NOT {out} AND NOT {both} AND NOT {degree} AND r.college AND s.institution = '')"
    step = f"""{{'degree': CASE WHEN {degree} THEN r.bare WHEN {both} AND s.degree = '' THEN r.a ELSE s.degree END, 'institution': CASE WHEN {college} THEN r.bare WHEN {both} AND s.institution = '' THEN r.b ELSE s.institution END, 'dates': CASE WHEN s.dates = '' THEN r.date ELSE s.dates END}}"""
    dated = f"({full('s.degree', _RANGE)} OR {full('s.degree', _DATE)})"
    return f"""WITH {SECTIONS}, {blocks('education')}, {_LINES},
bb AS (SELECT *, {strip('line', comma)} AS bare FROM bl), sb AS ({halves('bb', 'doc_id, block_no, i', 'bare', 'degree')}),
f AS (SELECT bb.*, {date} AS date, {undated} = '' AS alone, regexp_matches(line, {q(fixed.COURSE_LINE)}) OR ({starts('line', fixed.SHORT_BULLET_STARTS)}) AS skip, a, b, {has('line', fixed.DEGREES)} AS degree, {has('line', fixed.COLLEGES)} AS college FROM bb LEFT JOIN sb USING (doc_id, block_no, i)),
e AS (SELECT doc_id, block_no, list_reduce(list({{'bare': bare, 'date': date, 'alone': alone, 'skip': skip, 'a': a, 'b': b, 'degree': degree, 'college': college}} ORDER BY i), lambda s, r: {step}, {{'degree': '', 'institution': '', 'dates': ''}}) AS s FROM f GROUP BY ALL),
o AS (SELECT doc_id, {more}CASE WHEN regexp_matches(s.institution, {q(fixed.COURSE_LINE)}) OR regexp_matches(s.institution, '^[-•*]') THEN '' ELSE s.institution END AS institution, CASE WHEN {dated} THEN '' ELSE s.degree END AS degree, CASE WHEN {dated} AND s.dates = '' THEN s.degree ELSE s.dates END AS dates FROM e)
SELECT * FROM o WHERE institution <> '' OR degree <> ''"""


def projects(more: str = "") -> str:
    """SELECT of a project's fields, with the columns ``more`` of its block first."""
    return f"""WITH {SECTIONS}, {blocks('projects')},
l AS (SELECT doc_id, {more}list_filter(list_transform(string_split(block, {_NL}), lambda l_: {strip('l_')}), lambda l_: l_ <> '') AS ls FROM blk)
SELECT doc_id, {more}{strip('ls[1]', fixed.EDGE)} AS name, {strip(f'array_to_string(ls[2:], {_NL})')} AS description FROM l WHERE {strip('ls[1]', fixed.EDGE)} <> ''"""


def alias_table(o: Ontology) -> str:
    return f"aliases AS (SELECT * FROM {_values([(a.number, a.folded, a.canonical, a.category) for a in o.aliases], 't(idx, alias, canonical, category)')}), known AS (SELECT alias, arg_max(canonical, idx) AS canonical, min(idx) AS idx FROM aliases GROUP BY alias)"


def exact_hits(o: Ontology, source: str = "ready", trace: bool = False) -> str:
    """SELECT of (doc_id, canonical): an alias occurs as a word of its own; with ``trace`` (doc_id, alias, canonical), the first alias of each."""
    word = r"[\p{L}\p{N}_]"
    rules = []
    for a in o.aliases:
        body = a.pattern.split("(?iU)", 1)[1]
        inner = body.removeprefix(r"(?:^|\s)").removesuffix(r"(?:\s|$|[,;:])").removeprefix(r"\b").removesuffix(r"\b")
        first = r"(?:^|\s)" if body.startswith("(?:") else rf"(?:^|[^\p{{L}}\p{{N}}_])" if a.alias[0].isalnum() else word
        last = r"(?:\s|$|[,;:])" if body.endswith("])") else rf"(?:$|[^\p{{L}}\p{{N}}_])" if a.alias[-1].isalnum() else word
        rules.append((a, f"(?i){first}{inner}{last}"))
    if trace:
        arms = ", ".join(f"CASE WHEN regexp_matches(text, {q(p)}) THEN {{'n': {a.number}, 'alias': {q(a.folded)}, 'canonical': {q(a.canonical)}}} END" for a, p in rules)
        return f"SELECT doc_id, arg_min(m.alias, m.n) AS alias, m.canonical AS canonical FROM (SELECT doc_id, unnest([{arms}]) AS m FROM {source}) WHERE m IS NOT NULL GROUP BY doc_id, m.canonical"
    arms = ", ".join(f"CASE WHEN regexp_matches(text, {q(p)}) THEN {q(a.canonical)} END" for a, p in rules)
    return f"SELECT DISTINCT doc_id, canonical FROM (SELECT doc_id, unnest([{arms}]) AS canonical FROM {source}) WHERE canonical IS NOT NULL"


def phrase_hits(source: str = "ready") -> str:
    """CTEs that end in ``phrases(doc_id, phrase)`` and ``keys(doc_id, phrase)``."""
    chunk = strip("c", fixed.ITEM_EDGE)
    no = ", ".join(map(q, fixed.NOT_SKILLS))
    gram = lambda n: f"SELECT doc_id, array_to_string(w[i:i+{n - 1}], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM chunks WHERE len(w) >= greatest({n}, 2))"
    return f"""pieces AS (SELECT doc_id, {chunk} AS chunk FROM (SELECT doc_id, unnest(string_split_regex(text, {q(fixed.ITEM_SPLIT)})) AS c FROM {source})),
chunks AS (SELECT doc_id, chunk, {words('chunk')} AS w FROM pieces WHERE chunk <> '' AND length(chunk) <= 50),
phrases AS MATERIALIZED (SELECT DISTINCT doc_id, phrase FROM (SELECT doc_id, chunk AS phrase FROM chunks UNION ALL SELECT * FROM ({gram(1)}) WHERE length(phrase) >= 2 UNION ALL {gram(2)} UNION ALL {gram(3)}) WHERE lower(phrase) NOT IN ({no})),
keys AS MATERIALIZED (SELECT DISTINCT doc_id, {strip('lower(phrase)')} AS phrase FROM phrases WHERE length({strip('lower(phrase)')}) >= 3 AND {strip('lower(phrase)')} NOT IN ({no}))"""


def explicit_rows() -> str:
    """SELECT of (doc_id, skill) listed in the skills section."""
    return f"""SELECT DISTINCT n.doc_id, coalesce(k.canonical, {title('n.name')}) AS skill FROM (SELECT doc_id, {strip('p', fixed.EDGE)} AS name FROM (SELECT doc_id, unnest(string_split_regex({strip('l', fixed.EDGE)}, '[,;]+')) AS p FROM (SELECT doc_id, unnest(string_split(text, {_NL})) AS l FROM {part('skills')}))) n
LEFT JOIN known k ON k.alias = lower(n.name) WHERE n.name <> '' AND length(n.name) <= 60"""


def edits(a: str, b: str) -> str:
    """Levenshtein's distance in characters; the built-in function counts bytes."""
    row = f"list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, least(acc[len(acc)] + 1, prev[j + 1] + 1, prev[j] + CASE WHEN substr({b}, j, 1) = ch THEN 0 ELSE 1 END)), [prev[1] + 1])"
    return f"CASE WHEN strlen({a}) = length({a}) AND strlen({b}) = length({b}) THEN levenshtein({a}, {b}) ELSE list_reduce(string_split({a}, ''), lambda prev, ch: {row}, range(0, length({b}) + 1))[length({b}) + 1] END"


def similar_levenshtein() -> str:
    """SELECT of (phrase, alias, canonical, score) over ``keys`` and ``known``."""
    fold = lambda c: rf"array_to_string(list_sort(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')), ' ')"
    return f"""SELECT phrase, arg_min(alias, idx) AS alias, arg_min(canonical, idx) AS canonical, arg_min(score, idx) AS score FROM (
SELECT phrase, alias, canonical, idx, round((1 - {edits('p_', 'a_')} / greatest(length(p_), length(a_))) * 100, 2) AS score FROM (
SELECT p.phrase, k.alias, k.canonical, k.idx, {fold('p.phrase')} AS p_, {fold('k.alias')} AS a_
FROM (SELECT DISTINCT phrase FROM keys WHERE length(phrase) >= 4 AND phrase NOT IN (SELECT alias FROM known)) p JOIN known k ON left(p.phrase, 1) = left(k.alias, 1) AND abs(length(p.phrase) - length(k.alias)) <= 3 AND {n_words('p.phrase')} = {n_words('k.alias')}
WHERE regexp_matches(left(k.alias, 1), '[\\p{{L}}\\p{{N}}]'))) WHERE score >= 85 GROUP BY phrase"""


def similar_indel() -> str:
    """SELECT of (phrase, alias, canonical, score) over ``keys`` and ``known``: the best alias by common subsequence, then the guards."""
    fold = lambda c: f"array_to_string(list_sort({words(c)}), ' ')"
    row = "list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, greatest(acc[len(acc)], prev[j + 1], CASE WHEN b[j] = ch THEN prev[j] + 1 ELSE 0 END)), [0::BIGINT])"
    return f"""SELECT phrase, best.alias AS alias, best.canonical AS canonical, best.score AS score FROM (
SELECT phrase, arg_max({{'alias': alias, 'canonical': canonical, 'score': score}}, {{'score': score, 'first': -idx}}) AS best FROM (
SELECT *, 200.0::DOUBLE * list_reduce(string_split(p, ''), lambda prev, ch: {row}, list_resize([]::BIGINT[], len(b) + 1, 0))[len(b) + 1] / (length(p) + length(a)) AS score FROM (
SELECT *, string_split(a, '') AS b FROM (SELECT d.phrase, k.alias, k.canonical, k.idx, {fold('d.phrase')} AS p, {fold('k.alias')} AS a
FROM (SELECT DISTINCT phrase FROM keys WHERE length(phrase) >= 4 AND phrase NOT IN (SELECT alias FROM known)) d JOIN known k ON 100 * length(k.alias) BETWEEN 70 * length(d.phrase) AND 140 * length(d.phrase))
WHERE levenshtein(p, a) <= floor(15 * (length(p) + length(a)) / 100) + strlen(p) - length(p) + strlen(a) - length(a))) WHERE score >= 85 GROUP BY phrase)
WHERE len({words('phrase')}) = len({words('best.alias')}) AND abs(length(phrase) - length(best.alias)) <= 3"""


def listed(name: str, fields: list[str], select: str) -> str:
    """CTE ``name(doc_id, v)``: the rows of a SELECT with block_no as a list of structs, by document."""
    pack = ", ".join(f"'{f}': {f}" for f in fields)
    return f"{name} AS MATERIALIZED (SELECT doc_id, list({{{pack}}} ORDER BY block_no) AS v FROM ({select}) GROUP BY 1)"


def records(skills: str) -> str:
    """CTE ``rec`` with a record's fields, from CTEs of SECTIONS, HEADS, NAMES and ``skills(doc_id, skill)``."""
    item = strip("i", fixed.ITEM_EDGE)
    many = lambda s: f"{s}_ AS MATERIALIZED (SELECT doc_id, list(item ORDER BY n) AS v FROM (SELECT doc_id, item, min(n) AS n FROM (SELECT doc_id, {item} AS item, n FROM (SELECT doc_id, unnest(string_split_regex(text, {q(fixed.ITEM_SPLIT)})) AS i, generate_subscripts(string_split_regex(text, {q(fixed.ITEM_SPLIT)}), 1) AS n FROM {part(s)})) WHERE item <> '' AND length(item) <= 50 GROUP BY ALL) GROUP BY 1)"
    certificate = strip("l", fixed.EDGE)
    struct = lambda fields: "STRUCT(" + ", ".join(f'"{f}" VARCHAR' for f in fields) + ")[]"
    jobs, degrees, works, papers = ["company", "title", "dates", "description"], ["institution", "degree", "dates"], ["name", "description"], ["name", "issuer", "dates"]
    whole = lambda t, fields: f"coalesce({t}.v, []::{struct(fields)})"
    return f"""{listed('jobs_', jobs, experience('block_no, '))}, {listed('degrees_', degrees, education('block_no, '))}, {listed('works_', works, projects('block_no, '))},
papers_ AS MATERIALIZED (SELECT doc_id, list({{'name': l, 'issuer': '', 'dates': ''}} ORDER BY n) AS v FROM (SELECT doc_id, {certificate} AS l, n FROM (SELECT doc_id, unnest(string_split(text, {_NL})) AS l, generate_subscripts(string_split(text, {_NL}), 1) AS n FROM {part('certifications')})) WHERE length(l) > 3 GROUP BY 1),
{many('languages')}, {many('hobbies')},
skills_ AS MATERIALIZED (SELECT doc_id, list(skill ORDER BY lower(skill), skill) AS v FROM {skills} GROUP BY 1),
rec AS MATERIALIZED (SELECT r.doc_id, {{'name': coalesce(n.name, ''), 'email': coalesce({extract('r.text', fixed.EMAIL)}, ''), 'phone': coalesce({phone('r.text')}, ''), 'linkedin': coalesce({linkedin('r.text')}, ''), 'portfolio': coalesce({portfolio('r.text')}, '')}} AS contact,
  s.text AS summary, {whole('j', jobs)} AS experience, {whole('d', degrees)} AS education, coalesce(k.v, []::VARCHAR[]) AS skills, {whole('w', works)} AS projects, {whole('c', papers)} AS certifications, coalesce(l.v, []::VARCHAR[]) AS languages, coalesce(h.v, []::VARCHAR[]) AS hobbies
  FROM ready r JOIN names n USING (doc_id) JOIN {part('summary')} s USING (doc_id) LEFT JOIN jobs_ j USING (doc_id) LEFT JOIN degrees_ d USING (doc_id) LEFT JOIN skills_ k USING (doc_id) LEFT JOIN works_ w USING (doc_id) LEFT JOIN papers_ c USING (doc_id) LEFT JOIN languages_ l USING (doc_id) LEFT JOIN hobbies_ h USING (doc_id))"""


RECORD_JSON = "SELECT doc_id, CAST(to_json({" + ", ".join(f"'{f}': {f}" for f in FIELDS) + "}) AS VARCHAR) AS json FROM rec"
COMPLETENESS = """SELECT doc_id, CAST(greatest(65, least(least(5 * len(skills), 50) + least(15 * len(experience), 30) + least(10 * len(education), 20), 98)) AS INT) AS completeness,
format('Profile completeness: {} skills verified, {} career milestones, {} education records.', len(skills), len(experience), len(education)) AS completeness_text,
CAST(len(skills) AS INT) AS n_skills, CAST(len(experience) AS INT) AS n_jobs, CAST(len(education) AS INT) AS n_degrees, CAST(len(projects) AS INT) AS n_projects FROM rec"""


def record_html() -> str:
    """SELECT of (doc_id, two_columns, single_column) from ``rec``."""

    def escaped(x: str) -> str:
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            x = f"replace({x}, {q(raw)}, {q(safe)})"
        return f"replace({x}, {_NL}, '<br>')"

    shown = lambda x, what: escaped(f"coalesce(nullif({x}, ''), {q(fixed.DEFAULTS[what])})")
    line = lambda *parts: f"array_to_string(list_filter([{', '.join(parts)}], lambda p_: p_ <> ''), ' &middot; ')"

    def section(title: str, items: str) -> str:
        return f"CASE WHEN len({items}) > 0 THEN '<section><h2>{title}</h2><ul>' || array_to_string(list_transform({items}, lambda i_: '<li>' || i_ || '</li>'), '') || '</ul></section>' ELSE '' END"

    plain = lambda x: f"list_transform({x}, lambda x_: {escaped('x_')})"
    each = lambda x, body: f"list_transform({x}, lambda e_: {body})"
    p = {
        "details": section("Details", plain("list_filter([contact.email, contact.phone, contact.linkedin, contact.portfolio], lambda y_: y_ <> '')")),
        "summary": f"CASE WHEN summary <> '' THEN '<section><h2>Profile</h2><p>' || {escaped('summary')} || '</p></section>' ELSE '' END",
        "skills": section("Skills", plain("skills")), "languages": section("Languages", plain("languages")), "hobbies": section("Hobbies", plain("hobbies")),
        "experience": section("Employment", each("experience", f"'<b>' || {shown('e_.title', 'title')} || '</b> ' || {line(shown('e_.company', 'company'), shown('e_.dates', 'dates'))} || '<p>' || {escaped('e_.description')} || '</p>'")),
        "education": section("Education", each("education", f"'<b>' || {shown('e_.degree', 'degree')} || '</b> ' || {line(shown('e_.institution', 'institution'), escaped('e_.dates'))}")),
        "certifications": section("Certifications", each("certifications", escaped("e_.name"))),
        "projects": section("Projects", each("projects", f"'<b>' || {shown('e_.name', 'project')} || '</b> ' || {escaped('e_.description')}")),
    }
    name = shown("contact.name", "name")
    page = lambda style, *body: " || ".join(["'<!doctype html><html><head><meta charset=\"utf-8\"><title>'", name, f"'</title><style>{style}</style></head><body><h1>'", name, "'</h1>'", *body, "'</body></html>'"])
    two = page("body{font-family:sans-serif;margin:2em}.page{display:flex;gap:2em}aside{flex:1}main{flex:2}", "'<div class=\"page\"><aside>'", p["details"], p["skills"], p["languages"], p["hobbies"], "'</aside><main>'", p["summary"], p["experience"], p["education"], p["certifications"], p["projects"], "'</main></div>'")
    one = page("body{font-family:serif;max-width:50em;margin:2em auto}", p["details"], p["summary"], p["experience"], p["education"], p["skills"], p["languages"], p["hobbies"])
    return f"SELECT doc_id, {two} AS two_columns, {one} AS single_column FROM rec"
