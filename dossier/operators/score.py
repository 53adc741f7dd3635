"""Scores, comparisons with job descriptions, and what is shown of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions import fixed
from dossier.functions.textkit import lines, strip, words


def completeness(skills: Column, experience: Column, education: Column, threshold: float = 85.0) -> Column:
    """Points for skills, jobs and degrees, scaled by the threshold, between 65 and 98."""
    base = F.least(F.size(skills) * 5, F.lit(50)) + F.least(F.size(experience) * 15, F.lit(30)) + F.least(F.size(education) * 10, F.lit(20))
    return F.greatest(F.lit(65), F.least((base * F.lit(threshold / 85.0)).cast("int"), F.lit(98)))


def completeness_text(skills: Column, experience: Column, education: Column) -> Column:
    """The score in words."""
    return F.format_string("Profile completeness: %d skills verified, %d career milestones, %d education records.", F.size(skills), F.size(experience), F.size(education))


def _folded(x: Column) -> Column:
    return F.transform(x, F.lower)


def matched(wanted: Column, have: Column) -> Column:
    return F.filter(wanted, lambda s: F.array_contains(_folded(have), F.lower(s)))


def missing(wanted: Column, have: Column) -> Column:
    return F.filter(wanted, lambda s: ~F.array_contains(_folded(have), F.lower(s)))


def match_score(wanted: Column, have: Column) -> Column:
    """Per cent of the wanted skills that are there, truncated."""
    return (F.size(matched(wanted, have)) / F.greatest(F.size(wanted), F.lit(1)) * 100).cast("int")


def density(n: Column) -> Column:
    """How full a category looks: eight skills or more are all of it."""
    return F.least(n / 8.0, F.lit(1.0))


def job_tags(skills: Column, title: Column, description: Column) -> Column:
    """The first five skills that a job's title or description contains."""
    inside = lambda s: F.lower(description).contains(F.lower(s)) | F.lower(title).contains(F.lower(s))
    return F.slice(F.filter(skills, inside), 1, 5)


def initials(name: Column) -> Column:
    """Two capitals that stand for a name."""
    w = words(F.coalesce(name, F.lit("")))
    first, last = F.get(w, F.lit(0)), F.get(w, F.size(w) - 1)
    return (
        F.when(F.coalesce(name, F.lit("")).isin("", *fixed.NO_NAMES), "CV")
        .when(F.size(w) >= 2, F.upper(F.concat(F.substring(first, 1, 1), F.substring(last, 1, 1))))
        .when((F.size(w) == 1) & (F.length(first) >= 2), F.upper(F.substring(first, 1, 2)))
        .otherwise("CV")
    )


def or_default(x: Column, what: str) -> Column:
    """A field, or what is shown in its place."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(fixed.DEFAULTS[what]))


def top_title(experience: Column) -> Column:
    return or_default(F.get(experience, F.lit(0)).title, "top_title")


def sensitivity(threshold: Column) -> Column:
    return F.when(threshold >= 90, "strict").when(threshold >= 80, "balanced").otherwise("broad")


def bullet_items(description: Column) -> Column:
    """The items of a description."""
    return F.filter(F.transform(lines(description), lambda y: strip(y, " -•*")), lambda y: y != "")
