"""Traced cases for the operators, and properties of the text functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.functions import textkit
from dossier.operators import clean, contact, entries, score, sections, skills
from dossier.plans.record import ResumeEngine
from dossier.sources.ontology import Ontology


@pytest.fixture(scope="module")
def on(spark):
    """Applies a column function to some texts."""

    def run(f, *texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, x STRING")
        return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]

    return run


def test_contact_cases(on):
    assert on(contact.email, "Please reach out to dev_john.doe@company.co.uk or jane@test.com", "none") == ["dev_john.doe@company.co.uk", None]
    phones = {"Contact: +1 (555) 234-5678": "+1 (555) 234-5678", "Phone: +91 98765 43210": "+91 98765 43210", "Mobile: 3868683442": "+1 (386) 868-3442", "+1 (555) 234-2012": None}
    assert on(contact.phone, *phones) == list(phones.values())
    assert on(contact.format_phone, "3868683442", "14155550192", "", None) == ["+1 (386) 868-3442", "+1 (415) 555-0192", None, None]
    links = "LinkedIn: https://www.linkedin.com/in/sarah-connor GitHub: https://github.com/sarahc"
    assert on(contact.linkedin, links) == ["https://www.linkedin.com/in/sarah-connor"]
    assert on(contact.portfolio, links) == ["https://github.com/sarahc"]
    names = {"Sarah Connor\nsarah@sky.net | +1 555-0100\nSenior AI Engineer": "Sarah Connor", "ROBERT COOPER\nx": "Robert Cooper", "Conan O'Brien": None, "Work Experience": None, "": None}
    assert on(contact.name, *names) == list(names.values())


def test_cleaning_cases(on):
    assert on(clean.clean, "A\npage 1\nB", "A\n\npage 1\n\nB", "A\n====\nB", None, "soft­hyphen ﬁt ²") == ["A\n\nB", "A\n\nB", "A\n\nB", "", "soft hyphen fit 2"]
    assert on(clean.clean, "•  a\n* b\n- c\n° DETAILS °") == ["- a\n- b\n- c\n° DETAILS °".replace("° DETAILS °", "° DETAILS °")]


def test_sections(on, spark):
    assert on(sections.heading, "Skills:", "Skills: Python", "> WORK EXPERIENCE", "", "x" * 70) == ["skills", None, "experience", None, None]
    text = "JOHN DOE\nSummary\nhello\nSKILLS:\nPython\nSummary\nmore\nPapers\nOn x"
    got = on(sections.sections, text, "")
    assert {k: v for k, v in got[0].items() if v} == {"contact": "JOHN DOE", "summary": "hello\nmore", "skills": "Python", "publications": "On x"}
    assert set(got[1].values()) == {""} and len(got[1]) == 10
    rows = sections.section_lines(spark.createDataFrame([(1, text)], "doc_id INT, text STRING")).orderBy("line_no").collect()
    assert [(r.section, r.line) for r in rows] == [("contact", "JOHN DOE"), ("summary", "hello"), ("skills", "Python"), ("summary", "more"), ("publications", "On x")]


def test_entries(on):
    assert on(entries.split_title_company, "Full-Stack Developer, Acme", "Lead Engineer at Acme | Jan 2021 - Present", "no job") == [("Stack Developer, Acme", "Full"), ("Lead Engineer", "Acme | Jan 2021 - Present"), None]
    assert on(entries.split_degree_institution, "Bachelor of Science, University of California, Berkeley") == [("Bachelor of Science", "University of California Berkeley")]
    job = "Security Guard, ADT Security, Port Washington\nJanuary 2021 - April 2022\n- Patrolled\n- Reported"
    assert [tuple(r) for r in on(entries.experience, job)[0]] == [("ADT Security Port Washington", "Security Guard", "January 2021 - April 2022", "- Patrolled\n- Reported")]
    assert on(entries.experience, "", None) == [[], []]
    assert [tuple(r) for r in on(entries.education, "MBA\nHarbor College\n2001")[0]] == [("Harbor College", "MBA", "2001")]
    assert [tuple(r) for r in on(entries.projects, "Alpha\n- one\n\nBeta")[0]] == [("Alpha", "- one"), ("Beta", "")]
    assert on(entries.list_items, "English, German | English\n" + "x" * 51) == [["English", "German"]]
    assert [r["name"] for r in on(entries.certifications, "- First Aid\nabc\n")[0]] == ["First Aid"]
    assert on(entries.degree_phrase, "holds a B.Sc. here", "none") == ["B.Sc.", None]


def test_skills(spark, on):
    o = Ontology.load()
    text = "Strong experience in React.js, Python3, Docker, and ML algorithms. Proficient with Postgres databases, C++, K8s, and PyTest."
    got = set(on(lambda x: skills.exact(x, o), text)[0])
    assert {"React", "Python", "Docker", "Machine Learning", "PostgreSQL", "C++", "Kubernetes", "Unit Testing", "C"} <= got
    got = set(on(lambda x: skills.exact(x, o), "SKILLS\nPython, Docker, AWS")[0])
    assert got == {"Python", "Docker", "Amazon Web Services (AWS)"}
    assert on(lambda x: skills.explicit(x, o), "node.js tuning\naws; It's CI/CD things")[0] == ["Node.Js Tuning", "Amazon Web Services (AWS)", "It'S Ci/Cd Things"]
    pairs = {("fastapi", "fast api"): 93.33, ("kubernets", "kubernetes"): 94.74, ("postgre sql", "postgresql"): 95.24}
    df = spark.createDataFrame(list(pairs), "a STRING, b STRING")
    assert [round(r.s, 2) for r in df.select(skills.indel_ratio(F.col("a"), F.col("b")).alias("s")).collect()] == list(pairs.values())
    phrases = spark.createDataFrame([("kubernets",), ("postgre sql",), ("python",), ("kub",)], "phrase STRING")
    for method in ("indel", "levenshtein"):
        assert [(r.phrase, r.canonical) for r in skills.similar(phrases, o, 60, method).collect()] == [("kubernets", "Kubernetes")]
    assert on(lambda x: skills.by_category(F.split(x, ","), o), "Zed,Docker,Microservices")[0] == {"CORE SKILLS & EXPERTISE": ["Microservices", "Zed"], "CLOUD & DEVOPS": ["Docker"]}


def test_the_dictionary_can_be_a_file(spark, tmp_path):
    path = tmp_path / "o.json"
    path.write_text('{"skills":[{"canonical":"Zig","category":"Programming Languages","aliases":["ziglang"]}]}')
    assert Ontology.load(spark, str(path)).canonical == {"ziglang": "Zig", "zig": "Zig"}
    assert Ontology.load(spark, str(tmp_path / "none.json")).aliases == []
    with pytest.raises(Exception):
        Ontology.load(spark, str(tmp_path / "none.json"), allow_missing=False)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


@given(st.lists(st.tuples(st.text("abc ", max_size=9), st.text("abcé", max_size=9)), min_size=1, max_size=30))
@settings(max_examples=8, deadline=None)
def test_common_length(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i INT, a STRING, b STRING")
    got = [r.n for r in df.select("i", skills.common_length(F.col("a"), F.col("b")).alias("n")).orderBy("i").collect()]
    assert got == [lcs(a, b) for a, b in pairs]


@given(st.lists(st.text("aB é'.-/1\tß", max_size=20), min_size=1, max_size=40))
@settings(max_examples=8, deadline=None)
def test_text_functions(on, texts):
    assert on(lambda x: textkit.words(x), *texts) == [t.split() for t in texts]
    assert on(lambda x: textkit.strip(x, " -'"), *texts) == [t.strip(" -'") for t in texts]
    plain = [t.replace("ß", "s") for t in texts]
    assert on(lambda x: textkit.title_case(x), *plain) == [t.title() for t in plain]


def test_scores(spark):
    row = spark.range(1).select(
        score.completeness(F.array_repeat(F.lit("x"), 6), F.array(F.lit(1)), F.array(F.lit(1))).alias("low"),
        score.match_score(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: i.cast("string")), F.transform(F.sequence(F.lit(1), F.lit(29)), lambda i: i.cast("string"))).alias("cut"),
        score.initials(F.lit("Ada Byron Lovelace")).alias("two"), score.initials(F.lit("Cher")).alias("one"), score.initials(F.lit("")).alias("none"),
    ).first()
    assert tuple(row) == (65, 28, "AL", "CH", "CV")


RESUME = "\n".join("Robert Cooper|email@email.com 3868683442|https://www.linkedin.com/in/robert-cooper|PROFILE|Safety conscious.|EMPLOYMENT HISTORY|Security Guard, ADT Security, Port Washington|January 2021 - April 2022|- Kept monitoring systems.|- Reported.|EDUCATION|Certified Protection Guard Program (CPOP), International Foundation for Protection Guards|January 2021 - April 2022|SKILLS|Criminal Investigation|Handcuffing".split("|"))


def test_whole_records(spark):
    got = ResumeEngine(spark).parse_one(RESUME)
    assert got["contact"] == {"name": "Robert Cooper", "email": "email@email.com", "phone": "+1 (386) 868-3442", "linkedin": "https://www.linkedin.com/in/robert-cooper", "portfolio": ""}
    assert got["summary"] == "Safety conscious."
    assert got["experience"] == [{"company": "ADT Security Port Washington", "title": "Security Guard", "dates": "January 2021 - April 2022", "description": "- Kept monitoring systems.\n- Reported."}]
    assert got["education"] == [{"institution": "International Foundation for Protection Guards", "degree": "Certified Protection Guard Program (CPOP)", "dates": "January 2021 - April 2022"}]
    assert got["skills"] == ["Investigation Skills", "Restraining Devices", "Safety Compliance", "Surveillance & CCTV"]
    assert got["projects"] == got["certifications"] == got["languages"] == got["hobbies"] == []
