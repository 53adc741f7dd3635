"""A deterministic table of resumes, made from the customer table by one SQL text for either engine.

Every operator finds matches in it: headings, noise lines, contact details,
jobs, degrees, skills and lists vary with the customer's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIRST = "Anna,Brian,Carla,David,Elena,Felix,Grace,Henry"
_LAST = "Archer,Bennett,Cooper,Dalton,Ellis,Foster,Greene,Harper,Irwin"
_TITLES = "Senior Software Engineer,Data Scientist,Security Guard,Project Manager,Full-Stack Developer,Lead Analyst"
_FIRMS = "Acme Corp,Globex Technologies,Initech Solutions LLC,Umbrella Services,Northwind,Harbor Security Ltd"
_DEGREES = "Bachelor of Science,Master of Arts,B.Tech in Computing,Diploma in Design,MBA"
_PLACES = "University of Lund,Harbor College,Stanford University,Institute of Technology"
_SKILLS = "Python,React.js,Docker,Postgres,C++,K8s,Machine Learning,node.js tuning,Kubernets,Postgre SQL,PyTest,CCTV,aws,Scrum,Excel modelling,REST,SQL,Go,Kubernete,Dockerr,Machine Learnin,Machine Lerning,Postgresq,Statistcs,Plumbin,Carpentri,Payrol,Copywritting,Sprint Planing,Forklift Drivin,Bookkeping,Load Testin,Kotlyn,Terrafrm,Learning Machine"
_HOBBIES = "Chess,Hiking,Photography,Cooking"
_TONGUES = "English,German,French,Spanish,Hindi"


def _pick(texts: str, k: str) -> str:
    return f"split_part('{texts}', ',', CAST(({k}) % {texts.count(',') + 1} AS INT) + 1)"


def sql(customer: str = "customer") -> str:
    """SELECT of (doc_id, text)."""
    name = f"concat({_pick(_FIRST, 'k')}, ' ', {_pick(_LAST, 'k')})"
    year = "CAST(2005 + k % 15 AS INT)"
    digits = "lpad(CAST(2000000 + (k * 7919) % 7999999 AS VARCHAR(20)), 7, '0')"
    lines = [
        f"CASE WHEN k % 5 = 0 THEN upper({name}) WHEN k % 7 = 0 THEN concat('Resume', chr(10), {name}) ELSE {name} END",
        f"CASE WHEN k % 11 = 3 THEN 'no mail' ELSE concat('Email: ', lower({_pick(_FIRST, 'k')}), '.', CAST(k AS VARCHAR(20)), '@example', CASE WHEN k % 2 = 0 THEN '.com' ELSE '.co.uk' END) END",
        f"CASE k % 4 WHEN 0 THEN concat('Phone: +1 (415) ', substr({digits}, 1, 3), '-', substr({digits}, 4, 4)) WHEN 1 THEN concat('Mobile: 386', {digits}) WHEN 2 THEN concat('Tel +91 98765 4', substr({digits}, 1, 4)) ELSE '2010-2014' END",
        f"CASE k % 3 WHEN 0 THEN concat('https://www.linkedin.com/in/', lower({_pick(_LAST, 'k')}), '-', CAST(k AS VARCHAR(20))) WHEN 1 THEN concat('GitHub: github.com/dev', CAST(k AS VARCHAR(20))) ELSE concat('https://portfolio', CAST(k AS VARCHAR(20)), '.example.org/home') END",
        "CASE WHEN k % 6 = 1 THEN '--------' ELSE '' END",
        "CASE WHEN k % 4 = 1 THEN '° PROFILE °' ELSE 'Professional Summary:' END",
        "concat(chr(8220), 'Careful and attentive', chr(8221), ' worker', chr(8212), 'likes ', '  monitoring systems', chr(8230))",
        "CASE WHEN k % 3 = 0 THEN 'page 1 of 2' WHEN k % 3 = 1 THEN '1 / 2' ELSE '- 3 -' END",
        "'WORK EXPERIENCE'",
        f"CASE k % 3 WHEN 0 THEN concat({_pick(_TITLES, 'k')}, ' at ', {_pick(_FIRMS, 'k')}, ' | Jan ', CAST({year} AS VARCHAR(20)), ' - Present') WHEN 1 THEN concat({_pick(_TITLES, 'k')}, ', ', {_pick(_FIRMS, 'k + 1')}) ELSE {_pick(_TITLES, 'k')} END",
        f"CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN concat('March ', CAST({year} AS VARCHAR(20)), ' to June ', CAST({year} + 2 AS VARCHAR(20))) ELSE {_pick(_FIRMS, 'k')} END",
        "concat(chr(8226), ' Led engineers, shipping tools')",
        f"concat('*  Used ', {_pick(_SKILLS, 'k')}, ' every day')",
        "CASE WHEN k % 2 = 0 THEN '' ELSE 'Kept records.' END",
        f"concat({_pick(_TITLES, 'k + 2')}, ' - ', {_pick(_FIRMS, 'k + 3')})",
        f"concat(CAST({year} - 4 AS VARCHAR(20)), ' - ', CAST({year} - 1 AS VARCHAR(20)))",
        "'Answered phones; wrote reports.'",
        "CASE WHEN k % 2 = 0 THEN 'Education' ELSE '## EDUCATION ##' END",
        f"concat({_pick(_DEGREES, 'k')}, CASE WHEN k % 3 = 0 THEN ' - ' ELSE ', ' END, {_pick(_PLACES, 'k')})",
        f"concat('May ', CAST({year} - 5 AS VARCHAR(20)))",
        "CASE WHEN k % 5 = 2 THEN concat(chr(10), 'Certificate Program', chr(10), 'Training Foundation') ELSE 'Coursework: algebra' END",
        "'Skills'",
        f"concat({_pick(_SKILLS, 'k')}, ', ', {_pick(_SKILLS, 'k * 3 + 1')}, '; ', {_pick(_SKILLS, 'k * 5 + 2')}, chr(10), '- ', {_pick(_SKILLS, 'k * 7 + 3')})",
        f"CASE WHEN k % 2 = 0 THEN concat('Projects', chr(10), 'Site ', CAST(k % 10 AS VARCHAR(20)), chr(10), '- built with ', {_pick(_SKILLS, 'k + 4')}, chr(10), chr(10), 'Ledger', chr(10), 'keeps books') ELSE '' END",
        "CASE WHEN k % 3 = 0 THEN concat('Licenses & Certifications', chr(10), 'First Aid', chr(10), 'abc', chr(10), 'Scrum Master') ELSE '====' END",
        f"concat('Languages', chr(10), {_pick(_TONGUES, 'k')}, ', ', {_pick(_TONGUES, 'k + 2')}, ' | ', {_pick(_TONGUES, 'k')})",
        f"CASE WHEN k % 4 = 0 THEN concat('Interests', chr(10), {_pick(_HOBBIES, 'k')}, ' / ', {_pick(_HOBBIES, 'k * 3 + 1')}) ELSE '' END",
        "CASE WHEN k % 9 = 0 THEN concat('Publications', chr(10), 'On valves') ELSE '' END",
    ]
    return f"SELECT k AS doc_id, concat_ws(chr(10), {', '.join(lines)}) AS text FROM (SELECT c_custkey AS k FROM {customer})"


def jobs_sql(part: str = "part") -> str:
    """SELECT of (jd_id, text): job descriptions made from the part table."""
    text = f"concat('We need ', {_pick(_SKILLS, 'k')}, ', ', {_pick(_SKILLS, 'k * 3 + 5')}, ' and ', {_pick(_SKILLS, 'k * 5 + 7')}, '.')"
    return f"SELECT k AS jd_id, {text} AS text FROM (SELECT p_partkey AS k FROM {part})"


def _spread(spark: SparkSession, path: str) -> DataFrame:
    """A table over all cores: what is made from a row takes far longer than reading it.

    Rows leave as output of a generator, as filters, with all that they are
    made of, would otherwise be moved to the few tasks that read the file.
    """
    return spark.read.parquet(path).repartition(spark.sparkContext.defaultParallelism).select(F.inline(F.array(F.struct("*"))))


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text)."""
    return spark.sql(sql("{t}").replace("VARCHAR(20)", "STRING").replace("chr(8220)", "'“'").replace("chr(8221)", "'”'").replace("chr(8212)", "'—'").replace("chr(8230)", "'…'").replace("chr(8226)", "'•'"), t=_spread(spark, f"{sf_dir}/customer.parquet"))


def job_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(jd_id, text)."""
    return spark.sql(jobs_sql("{t}").replace("VARCHAR(20)", "STRING"), t=_spread(spark, f"{sf_dir}/part.parquet"))
