"""One query per operator, over the driver's tables, with SQL for DuckDB beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import fixed
from dossier.functions.textkit import each, or_empty, present
from dossier.operators import clean, contact, entries, score, sections, skills
from dossier.plans import oracles as sql
from dossier.plans import record, render
from dossier.plans.resumes import job_descriptions, jobs_sql, resumes
from dossier.sources.ontology import Ontology

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function under its name."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _SQL[f.__name__] = oracle
        return f

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.prepared(resumes(spark, sf_dir))


def _part(name: str):
    return F.col("sections")[name]


_S = "coalesce(text, '')"


def _t():
    return F.col("text")



def _cleaning(name: str, step, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _documents(spark, sf_dir).unionByName(resumes(spark, sf_dir).select((F.col("doc_id") + 10**9).alias("doc_id"), "text")).select("doc_id", step(or_empty(_t())).alias("text"))

    run.__name__ = name
    query(f"WITH raw AS ({sql.resumes.sql()}), t AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000000, text FROM raw) SELECT doc_id, {oracle} AS text FROM t")(run)


_cleaning("clean_literals", clean.literals, sql.clean_literals(_S))
_cleaning("clean_controls", lambda x: clean.controls(clean.nfkc(clean.literals(x))), sql.clean_controls(sql.clean_literals(_S)))
_cleaning("clean_pages_dividers", clean.pages_and_dividers, sql.clean_pages(_S))
_cleaning("clean_bullets", clean.bullets, sql.clean_bullets(_S))
_cleaning("clean_whitespace", clean.white_space, sql.clean_white(_S))
_cleaning("clean_full", clean.clean, sql.clean("text"))


@query(f"WITH {sql.SECTIONS} SELECT doc_id, line, opens AS section FROM opened WHERE opens IS NOT NULL")
def header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = each(_ready(spark, sf_dir), ["doc_id"], F.split("text", "\n"), "line")
    return present(rows, ["doc_id", "line"], sections.heading(F.col("line")), "section")


@query(f"WITH {sql.SECTIONS}, every AS (SELECT doc_id, section FROM ready, (SELECT DISTINCT section FROM headings WHERE section <> 'publications') UNION SELECT doc_id, section FROM sec) SELECT doc_id, section, coalesce(s.text, '') AS text FROM every LEFT JOIN sec s USING (doc_id, section)")
def segment_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(_ready(spark, sf_dir), ["doc_id"], F.col("sections"), "section", "text")


@query(f"WITH {sql.SECTIONS} SELECT doc_id, CAST(line_no - 1 AS INT) AS line_no, section, line FROM marked WHERE opens IS NULL")
def segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.section_lines(record.prepared(resumes(spark, sf_dir)))


def _detail(name: str, column, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = _documents(spark, sf_dir).unionByName(_ready(spark, sf_dir).select((F.col("doc_id") + 10**9).alias("doc_id"), "text")).unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").select((F.col("page_id") + 2 * 10**9).alias("doc_id"), F.col("html").alias("text")))
        return present(texts, ["doc_id"], column(or_empty(_t())), name)

    run.__name__ = name
    query(f"WITH {sql.READY}, t AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000000, text FROM ready UNION ALL SELECT page_id + 2000000000, html FROM pages), o AS (SELECT doc_id, {oracle} AS {name} FROM t) SELECT * FROM o WHERE {name} IS NOT NULL")(run)


_detail("email", contact.email, sql.extract(_S, fixed.EMAIL))
_detail("phone", contact.phone, sql.phone(_S))
_detail("linkedin", contact.linkedin, sql.linkedin(_S))
_detail("portfolio_url", contact.portfolio, sql.portfolio(_S))


@query(f"SELECT c_custkey AS doc_id, {sql.phone_format('n')} AS phone FROM (SELECT c_custkey, substr(concat(CASE WHEN c_custkey % 3 = 0 THEN '1' WHEN c_custkey % 3 = 1 THEN '91' ELSE '' END, CAST(2000000000 + c_custkey * 7919 AS VARCHAR)), 1, CAST(10 + c_custkey % 3 AS INT)) AS n FROM customer)")
def phone_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lead = F.when(k % 3 == 0, "1").when(k % 3 == 1, "91").otherwise("")
    number = F.substr(F.concat(lead, (F.lit(2000000000) + k * 7919).cast("string")), F.lit(1), (F.lit(10) + k % 3).cast("int"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("doc_id"), contact.format_phone(number).alias("phone"))


@query(f"WITH {sql.SECTIONS}, {sql.HEADS}, {sql.NAMES} SELECT doc_id, name FROM names WHERE name IS NOT NULL")
def name_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.when(_part("contact") != "", _part("contact")).otherwise(F.substr(_t(), F.lit(1), F.lit(600)))
    return present(_ready(spark, sf_dir), ["doc_id"], contact.name(top), "name")


@query(f"WITH {sql.SECTIONS}, {sql.HEADS}, {sql.NAMES} SELECT doc_id, coalesce(name, '') AS name, coalesce({sql.extract('text', fixed.EMAIL)}, '') AS email, coalesce({sql.phone('text')}, '') AS phone, coalesce({sql.linkedin('text')}, '') AS linkedin, coalesce({sql.portfolio('text')}, '') AS portfolio FROM ready JOIN names USING (doc_id)")
def contact_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ready(spark, sf_dir).select("doc_id", contact.contact(_t(), _part("contact")).alias("c")).select("doc_id", "c.*")


def _on_lines(name: str, fields: dict, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _ready(spark, sf_dir).select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
        out = rows.select("doc_id", "line_no", *(c(F.col("line")).alias(n) for n, c in fields.items()))
        return out.where(F.coalesce(*fields).isNotNull())

    run.__name__ = name
    query(f"WITH {sql.READY}, lines AS (SELECT doc_id, CAST(i - 1 AS INT) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM ready)) {oracle}")(run)


_on_lines("date_range", {"dates": lambda x: F.nullif(entries.date_range(x), F.lit(""))}, f"SELECT doc_id, line_no, {sql.strip(f'regexp_extract(line, {sql.q(sql._RANGE)})')} AS dates FROM lines WHERE regexp_matches(line, {sql.q(sql._RANGE)})")
_on_lines("date_single", {"dates": lambda x: F.nullif(F.regexp_extract(x, entries.SINGLE, 0), F.lit(""))}, f"SELECT doc_id, line_no, regexp_extract(line, {sql.q(sql._DATE)}) AS dates FROM lines WHERE regexp_matches(line, {sql.q(sql._DATE)})")
_on_lines("split_title_company", {"title": lambda x: entries.split_title_company(x).title, "company": lambda x: entries.split_title_company(x).company}, f"SELECT doc_id, line_no, a AS title, b AS company FROM ({sql.halves('lines', 'doc_id, line_no', 'line', 'title')})")
_on_lines("split_degree_institution", {"degree": lambda x: entries.split_degree_institution(x).degree, "institution": lambda x: entries.split_degree_institution(x).institution}, f"SELECT doc_id, line_no, a AS degree, b AS institution FROM ({sql.halves('lines', 'doc_id, line_no', 'line', 'degree')})")


@query(f"WITH {sql.SECTIONS}, {sql.blocks('experience')} SELECT doc_id, CAST(block_no - 1 AS INT) AS block_no, block FROM blk")
def entry_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ready(spark, sf_dir).select("doc_id", F.posexplode_outer(entries.entry_blocks(_part("experience"))).alias("block_no", "block")).where("block_no IS NOT NULL")


def _records(name: str, column, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return each(_ready(spark, sf_dir), ["doc_id"], column(_part(name)), "e").select("doc_id", "e.*")

    run.__name__ = name
    query(oracle)(run)


_records("experience", entries.experience, sql.experience())
_records("education", entries.education, sql.education())
_records("projects", entries.projects, sql.projects())
_records("certifications", entries.certifications, f"WITH {sql.SECTIONS}, o AS (SELECT doc_id, {sql.strip('l', fixed.EDGE)} AS name, '' AS issuer, '' AS dates FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM {sql.part('certifications')})) SELECT * FROM o WHERE length(name) > 3")


@query(f"WITH {sql.SECTIONS}, o AS (SELECT doc_id, section, {sql.strip('i', fixed.ITEM_EDGE)} AS item FROM (SELECT doc_id, section, unnest(string_split_regex(text, {sql.q(fixed.ITEM_SPLIT)})) AS i FROM sec WHERE section IN ('languages', 'hobbies'))) SELECT DISTINCT * FROM o WHERE item <> '' AND length(item) <= 50")
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = _ready(spark, sf_dir)
    one = lambda s: each(ready, ["doc_id", F.lit(s).alias("section")], entries.list_items(_part(s)), "item")
    return one("languages").unionByName(one("hobbies"))


_O = Ontology.load()
_A = sql.alias_table(_O)


@query(f"WITH {_A} SELECT idx AS alias_idx, alias AS alias_lc, canonical, category FROM aliases")
def alias_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _O.frame(spark).select("alias_idx", "alias_lc", "canonical", "category")


@query(f"WITH {sql.READY}, t AS (SELECT doc_id, text FROM ready UNION ALL SELECT doc_id + 1000000000, text FROM documents) {sql.exact_hits(_O, 't')}")
def skills_exact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _ready(spark, sf_dir).select("doc_id", "text").unionByName(_documents(spark, sf_dir).select((F.col("doc_id") + 10**9).alias("doc_id"), "text"))
    return each(texts, ["doc_id"], skills.exact(_t(), _O), "canonical")


@query(f"WITH {sql.READY}, {sql.phrase_hits()} SELECT * FROM phrases")
def candidate_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(_ready(spark, sf_dir), ["doc_id"], skills.candidate_phrases(_t()), "phrase")


@query(f"WITH {sql.READY}, {sql.phrase_hits()}, {_A} SELECT DISTINCT doc_id, canonical FROM keys JOIN known ON phrase = alias")
def skills_phrase_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(_ready(spark, sf_dir), ["doc_id"], skills.phrase_skills(_t(), _O), "canonical")


@query(f"WITH {sql.READY}, t AS (SELECT doc_id, text FROM ready UNION ALL SELECT doc_id + 1000000000, text FROM documents), {sql.phrase_hits('t')}, {_A} {sql.similar_levenshtein()}")
def skills_fuzzy_lev(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _ready(spark, sf_dir).select("doc_id", "text").unionByName(_documents(spark, sf_dir).select((F.col("doc_id") + 10**9).alias("doc_id"), "text"))
    return skills.similar(skills.phrase_rows(texts), _O, method="levenshtein")


@query(f"WITH {sql.READY}, t AS (SELECT doc_id, text FROM ready UNION ALL SELECT doc_id + 1000000000, text FROM documents), {sql.phrase_hits('t')}, {_A} {sql.similar_indel()}")
def skills_fuzzy_indel(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _ready(spark, sf_dir).select("doc_id", "text").unionByName(_documents(spark, sf_dir).select((F.col("doc_id") + 10**9).alias("doc_id"), "text"))
    return skills.similar(skills.phrase_rows(texts), _O)


@query(f"WITH {sql.SECTIONS}, {_A} {sql.explicit_rows()}")
def skills_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(_ready(spark, sf_dir), ["doc_id"], skills.explicit(_part("skills"), _O), "skill")


_LEV = f"fuzzy AS MATERIALIZED ({sql.similar_levenshtein()}), found AS MATERIALIZED ({sql.exact_hits(_O)} UNION SELECT doc_id, canonical FROM keys JOIN known ON phrase = alias UNION SELECT k.doc_id, f.canonical FROM keys k JOIN fuzzy f USING (phrase)), listed AS MATERIALIZED ({sql.explicit_rows()}), allskills AS MATERIALIZED (SELECT doc_id, skill FROM listed UNION SELECT doc_id, canonical FROM found)"
_ALL = f"{sql.SECTIONS}, {sql.phrase_hits()}, {_A}, {_LEV}"
#: whole records, with the default similarity
_REC = f"{sql.SECTIONS}, {sql.HEADS}, {sql.NAMES}, {sql.phrase_hits()}, {_A}, {_LEV.replace(sql.similar_levenshtein(), sql.similar_indel())}, {sql.records('allskills').replace(f'WITH {sql.SECTIONS}, ', 'WITH ')}"


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, skills) by the Levenshtein similarity, which SQL can express."""
    return record.parse_text(resumes(spark, sf_dir), record.Settings(_O, similarity="levenshtein")).select("doc_id", "skills")


@query(f"WITH {_ALL} SELECT doc_id, skill, row_number() OVER (PARTITION BY doc_id ORDER BY lower(skill), skill) AS place FROM allskills")
def skills_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the outer form, as the filter that the optimizer infers for the other would find all skills a second time
    rows = _union(spark, sf_dir).select("doc_id", F.posexplode_outer("skills").alias("place", "skill")).where("skill IS NOT NULL")
    return rows.select("doc_id", "skill", (F.col("place") + 1).cast("long").alias("place"))


@query(f"WITH {_ALL} SELECT doc_id, 'EXACT' AS kind, alias, canonical, 100.0::DOUBLE AS score FROM ({sql.exact_hits(_O, trace=True)}) UNION ALL SELECT doc_id, 'EXACT PHRASE', phrase, canonical, 100.0 FROM keys JOIN known ON phrase = alias UNION ALL SELECT k.doc_id, 'FUZZY', f.alias, f.canonical, f.score FROM keys k JOIN fuzzy f USING (phrase)")
def skill_match_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = skills.skill_matches(_ready(spark, sf_dir).select("doc_id", "text"), _O, method="levenshtein")
    return found.select("doc_id", "kind", "alias", "canonical", "score")


_NAMED = f"cats AS (SELECT * FROM {sql._values([(c, fixed.CATEGORY_NAMES.get(g, fixed.OTHER_CATEGORY)) for c, g in _O.category.items()], 't(canonical, name)')})"


@query(f"WITH {sql.SECTIONS}, {_A}, {_NAMED}, listed AS ({sql.explicit_rows()}) SELECT doc_id, coalesce(name, '{fixed.OTHER_CATEGORY}') AS category, string_agg(skill, '|' ORDER BY lower(skill), skill) AS skills FROM listed LEFT JOIN cats ON canonical = skill GROUP BY ALL")
def skills_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = each(_ready(spark, sf_dir), ["doc_id"], skills.by_category(skills.explicit(_part("skills"), _O), _O), "category", "s")
    return grouped.select("doc_id", "category", F.array_join("s", "|").alias("skills"))


@query(f"WITH {sql.SECTIONS}, {_A}, {_NAMED}, listed AS ({sql.explicit_rows()}) SELECT doc_id, coalesce(name, '{fixed.OTHER_CATEGORY}') AS category, count(*) AS n, least(count(*) / 8.0, 1.0)::DOUBLE AS density FROM listed LEFT JOIN cats ON canonical = skill GROUP BY ALL")
def category_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = each(_ready(spark, sf_dir), ["doc_id"], skills.explicit(_part("skills"), _O), "skill")
    counts = listed.groupBy("doc_id", skills.category_name(F.col("skill"), _O).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("density", score.density(F.col("n")))


@query(f"WITH {_REC} {sql.COMPLETENESS}")
def score_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = record.with_scores(record.parse_text(resumes(spark, sf_dir), record.Settings(_O)))
    return rows.select("doc_id", "completeness", "completeness_text", F.size("skills").alias("n_skills"), F.size("experience").alias("n_jobs"), F.size("education").alias("n_degrees"), F.size("projects").alias("n_projects"))


@query("SELECT o_orderkey AS id, CAST(greatest(65, least(trunc((least(5 * CAST(o_orderkey % 15 AS INT), 50) + least(15 * CAST(o_custkey % 4 AS INT), 30) + least(10 * CAST(o_orderkey % 3 AS INT), 20)) * (CAST(70 + o_custkey % 30 AS DOUBLE) / 85.0::DOUBLE)), 98)) AS INT) AS score, CASE WHEN 70 + o_custkey % 30 >= 90 THEN 'strict' WHEN 70 + o_custkey % 30 >= 80 THEN 'balanced' ELSE 'broad' END AS label FROM orders")
def score_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda n: F.array_repeat(F.lit(""), n.cast("int"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    points = F.coalesce(*(F.when(c % 30 == t, score.completeness(some(k % 15), some(c % 4), some(k % 3), float(70 + t))) for t in range(30)))
    return rows.select(k.alias("id"), points.alias("score"), score.sensitivity(70 + c % 30).alias("label"))


_JOBS = f"jobs AS MATERIALIZED (SELECT jd_id AS doc_id, text FROM ({jobs_sql()})), wanted AS MATERIALIZED ({sql.exact_hits(_O, 'jobs')}), have AS ({sql.exact_hits(_O)})"


def _jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(jd_id, skill) and (doc_id, skill), by exact matches."""
    wanted = each(job_descriptions(spark, sf_dir), ["jd_id"], skills.exact(_t(), _O), "skill")
    return wanted, each(_ready(spark, sf_dir), ["doc_id"], skills.exact(_t(), _O), "skill")


@query(f"WITH {sql.READY}, {_JOBS}, asked AS (SELECT * FROM wanted WHERE doc_id % 20 = 0), n AS (SELECT doc_id AS jd_id, count(*) AS required FROM asked GROUP BY 1), m AS (SELECT h.doc_id, w.doc_id AS jd_id, count(*) AS matched FROM have h JOIN asked w ON lower(h.canonical) = lower(w.canonical) GROUP BY 1, 2) SELECT doc_id, jd_id, required, matched, CAST(trunc(matched / greatest(required, 1) * 100) AS INT) AS score FROM m JOIN n USING (jd_id)")
def jd_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search: the job descriptions whose id is divisible by 20 are the queries, against all resumes."""
    jobs = job_descriptions(spark, sf_dir).where("jd_id % 20 = 0").select("jd_id", skills.exact(_t(), _O).alias("skills"))
    rows = _ready(spark, sf_dir).select("doc_id", skills.exact(_t(), _O).alias("skills"))
    return record.matches(rows, jobs.select("jd_id", F.size("skills").cast("long").alias("required"), "skills"))


def _against(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        wanted, have = _jobs(spark, sf_dir)
        same = [F.col("w.jd_id") == F.col("h.doc_id"), F.lower("w.skill") == F.lower("h.skill")]
        return wanted.alias("w").join(have.alias("h"), same, how).select("jd_id", "skill")

    run.__name__ = {"left_semi": "jd_matched_semi", "left_anti": "jd_missing_anti"}[how]
    word = "" if how == "left_semi" else "NOT "
    query(f"WITH {sql.READY}, {_JOBS} SELECT doc_id AS jd_id, canonical AS skill FROM wanted w WHERE {word}EXISTS (SELECT 1 FROM have h WHERE h.doc_id = w.doc_id AND lower(h.canonical) = lower(w.canonical))")(run)


_against("left_semi")
_against("left_anti")


@query(f"WITH {_ALL}, jobs AS ({sql.experience().replace(f'WITH {sql.SECTIONS}, ', 'WITH ')}), j AS (SELECT *, row_number() OVER () AS n FROM jobs), hit AS (SELECT j.*, skill, row_number() OVER (PARTITION BY n ORDER BY lower(skill), skill) AS p FROM j JOIN listed l ON l.doc_id = j.doc_id AND (contains(lower(j.description), lower(skill)) OR contains(lower(j.title), lower(skill)))) SELECT doc_id, title, description, string_agg(skill, '|' ORDER BY p) AS tags FROM hit WHERE p <= 5 GROUP BY n, doc_id, title, description")
def job_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossier.functions.textkit import sorted_fold

    rows = each(_ready(spark, sf_dir), ["doc_id", sorted_fold(skills.explicit(_part("skills"), _O)).alias("s")], entries.experience(_part("experience")), "e")
    rows = rows.select("doc_id", F.col("e.title").alias("title"), F.col("e.description").alias("description"), F.array_join(score.job_tags(F.col("s"), F.col("e.title"), F.col("e.description")), "|").alias("tags"))
    return rows.where("tags <> ''")


@query(f"WITH {sql.SECTIONS}, {sql.HEADS}, {sql.NAMES}, w AS (SELECT doc_id, name, {sql.words('coalesce(name, chr(32))')} AS w FROM names) SELECT doc_id, CASE WHEN coalesce(name, '') IN ('', 'Candidate Profile', 'Not Specified', 'Candidate Name') THEN 'CV' WHEN len(w) >= 2 THEN upper(left(w[1], 1) || left(w[len(w)], 1)) WHEN len(w) = 1 AND length(w[1]) >= 2 THEN upper(left(w[1], 2)) ELSE 'CV' END AS initials FROM w")
def initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contact_struct(spark, sf_dir).select("doc_id", score.initials(F.col("name")).alias("initials"))


@query(f"WITH {sql.SECTIONS}, e AS ({sql.experience('block_no, ').replace(f'WITH {sql.SECTIONS}, ', 'WITH ')}), t AS (SELECT doc_id, arg_min(title, block_no) AS title FROM e GROUP BY 1) SELECT r.doc_id, coalesce(nullif(t.title, ''), 'Senior Professional') AS top_title FROM ready r LEFT JOIN t USING (doc_id)")
def top_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ready(spark, sf_dir).select("doc_id", score.top_title(entries.experience(_part("experience"))).alias("top_title"))


@query(f"WITH {sql.SECTIONS}, o AS (SELECT doc_id, {sql.strip('i', ' -•*')} AS item FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS i FROM {sql.part('projects')})) SELECT * FROM o WHERE item <> ''")
def bullet_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(_ready(spark, sf_dir), ["doc_id"], score.bullet_items(_part("projects")), "item")


@query(f"WITH {_REC} {sql.RECORD_JSON}")
def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.parse_text(resumes(spark, sf_dir), record.Settings(_O)).select("doc_id", render.record_json(pretty=False).alias("json"))


@query(f"WITH {_REC} {sql.record_html()}")
def record_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = record.parse_text(resumes(spark, sf_dir), record.Settings(_O))
    return rows.select("doc_id", render.two_columns().alias("two_columns"), render.single_column().alias("single_column"))


@query("SELECT c_custkey AS doc_id, concat(replace(c_name, '#', '_'), '_styled_resume.html') AS html, concat(replace(c_name, '#', '_'), '_ats_parsed.json') AS json, md5(concat(c_name, '_', c_mktsegment)) AS content_key FROM customer")
def download_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    names = render.file_names(F.concat(F.lit("/in/"), F.replace("c_name", F.lit("#"), F.lit("_")), F.lit(".pdf")))
    return rows.select(F.col("c_custkey").alias("doc_id"), names.html.alias("html"), names.json.alias("json"), render.content_key(F.col("c_name"), F.col("c_mktsegment")).alias("content_key"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
