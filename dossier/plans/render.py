"""Records as JSON and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.textkit import let
from dossier.operators.score import or_default

FIELDS = ("contact", "summary", "experience", "education", "skills", "projects", "certifications", "languages", "hobbies")


def record_json(pretty: bool = True) -> Column:
    """The record's fields as one JSON text; characters beyond ASCII stay as they are."""
    return F.to_json(F.struct(*FIELDS), {"pretty": str(pretty).lower()})


def escaped(x: Column) -> Column:
    """A text for HTML, line feeds as breaks."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return F.replace(x, F.lit("\n"), F.lit("<br>"))


def _section(title: str, items: Column) -> Column:
    """A titled list; nothing if it has no items."""
    body = F.array_join(F.transform(items, lambda i: F.concat(F.lit("<li>"), i, F.lit("</li>"))), "")
    return F.when(F.size(items) > 0, F.concat(F.lit(f"<section><h2>{title}</h2><ul>"), body, F.lit("</ul></section>"))).otherwise(F.lit(""))


def _line(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " &middot; ")


def _parts() -> dict[str, Column]:
    c = F.col("contact")
    details = F.filter(F.array(c.email, c.phone, c.linkedin, c.portfolio), lambda x: x != "")
    job = lambda e: F.concat(F.lit("<b>"), escaped(or_default(e.title, "title")), F.lit("</b> "), _line(escaped(or_default(e.company, "company")), escaped(or_default(e.dates, "dates"))), F.lit("<p>"), escaped(e.description), F.lit("</p>"))
    degree = lambda e: F.concat(F.lit("<b>"), escaped(or_default(e.degree, "degree")), F.lit("</b> "), _line(escaped(or_default(e.institution, "institution")), escaped(e.dates)))
    project = lambda p: F.concat(F.lit("<b>"), escaped(or_default(p["name"], "project")), F.lit("</b> "), escaped(p.description))
    plain = lambda x: F.transform(x, escaped)
    return {
        "details": _section("Details", plain(details)),
        "summary": F.when(F.col("summary") != "", F.concat(F.lit("<section><h2>Profile</h2><p>"), escaped(F.col("summary")), F.lit("</p></section>"))).otherwise(F.lit("")),
        "skills": _section("Skills", plain(F.col("skills"))),
        "languages": _section("Languages", plain(F.col("languages"))),
        "hobbies": _section("Hobbies", plain(F.col("hobbies"))),
        "experience": _section("Employment", F.transform("experience", job)),
        "education": _section("Education", F.transform("education", degree)),
        "certifications": _section("Certifications", F.transform("certifications", lambda x: escaped(x["name"]))),
        "projects": _section("Projects", F.transform("projects", project)),
    }


def _page(style: str, *body: Column | str) -> Column:
    name = escaped(or_default(F.col("contact")["name"], "name"))
    head = lambda n: F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), n, F.lit(f"</title><style>{style}</style></head><body><h1>"), n, F.lit("</h1>"))
    return F.concat(let(name, head), *(F.lit(b) if isinstance(b, str) else b for b in body), F.lit("</body></html>"))


def two_columns() -> Column:
    """A page with a side bar: details, skills, languages and hobbies beside the rest."""
    p = _parts()
    style = "body{font-family:sans-serif;margin:2em}.page{display:flex;gap:2em}aside{flex:1}main{flex:2}"
    return _page(style, '<div class="page"><aside>', p["details"], p["skills"], p["languages"], p["hobbies"], "</aside><main>", p["summary"], p["experience"], p["education"], p["certifications"], p["projects"], "</main></div>")


def single_column() -> Column:
    """A page in one column; projects and certifications are left out."""
    p = _parts()
    return _page("body{font-family:serif;max-width:50em;margin:2em auto}", p["details"], p["summary"], p["experience"], p["education"], p["skills"], p["languages"], p["hobbies"])


def file_names(path: Column) -> Column:
    """STRUCT<html, json>: what downloads of a record are called."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.struct(F.concat(stem, F.lit("_styled_resume.html")).alias("html"), F.concat(stem, F.lit("_ats_parsed.json")).alias("json"))


def content_key(name: Column, content: Column) -> Column:
    """A key for a named content."""
    return F.md5(F.concat_ws("_", name, content))


def write_json(records: DataFrame, path: str) -> None:
    """One JSON object per record, in as many files as there are partitions."""
    records.write.mode("overwrite").json(path)
