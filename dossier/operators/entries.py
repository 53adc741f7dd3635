"""Employment, education, projects and lists from the text of a section.

What a line says by itself is worked out first, for every line on its own;
only which field is still open is carried from line to line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions import fixed
from dossier.functions.textkit import full_lines, has_any, let, lines, n_words, or_empty, starts_with_any, strip

RANGE, SINGLE = "(?iU)" + fixed.DATE_RANGE, "(?iU)" + fixed.DATE


def date_range(x: Column) -> Column:
    """The first range of dates; empty if there is none."""
    return strip(F.regexp_extract(x, RANGE, 0))


def any_date(x: Column) -> Column:
    """The first range, else the first single date."""
    return let(date_range(x), lambda d: F.when(d != "", d).otherwise(strip(F.regexp_extract(x, SINGLE, 0))))


def is_range(x: Column) -> Column:
    return x.rlike(f"^(?:{RANGE})$")


def is_single(x: Column) -> Column:
    return x.rlike(f"^(?:{SINGLE})$")


def _halves(x: Column, separators: list[str], names: tuple[str, str], choose: Callable[[Column, Column], Column]) -> Column:
    """The first separator at which ``choose`` accepts (first part, the rest); null if none does.

    ``choose`` gives 1 for (first, rest), 2 for the other way round, null to go on.
    """

    def at(bare: Column, separator: str) -> Column:
        def parts(p: Column) -> Column:
            first = strip(F.get(p, F.lit(0)), fixed.EDGE_COMMA)
            more = F.filter(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda y: strip(y) != "")
            rest = strip(F.array_join(F.transform(more, lambda y: strip(y, fixed.EDGE_COMMA)), " "))
            return F.struct((F.size(p) >= 2).alias("cut"), first.alias("a"), rest.alias("b"))

        def pick(h: Column) -> Column:
            usable = h.cut & (h.a != "") & (h.b != "") & ~is_range(h.a) & ~is_range(h.b)
            order = F.when(usable, choose(h.a, h.b))
            one, two = names
            return F.when(order == 1, F.struct(h.a.alias(one), h.b.alias(two))).when(order == 2, F.struct(h.b.alias(one), h.a.alias(two)))

        return let(let(F.split(bare, separator), parts), pick)

    return let(strip(x, fixed.EDGE), lambda bare: F.when(bare != "", F.coalesce(*(at(bare, s) for s in separators))))


def split_title_company(x: Column) -> Column:
    """STRUCT<title, company> of a line that names both; null otherwise."""

    def choose(a: Column, b: Column) -> Column:
        job = lambda y: has_any(F.lower(y), fixed.JOBS)
        return F.when(job(a), 1).when(job(b), 2)

    return _halves(x, fixed.TITLE_SEPARATORS, ("title", "company"), choose)


def split_degree_institution(x: Column, known: Column | None = None) -> Column:
    """STRUCT<degree, institution> of a line that names both; null otherwise. ``known`` has organisations that a model found."""

    def choose(a: Column, b: Column) -> Column:
        degree = lambda y: has_any(F.lower(y), fixed.DEGREES)
        college = lambda y: has_any(F.lower(y), fixed.COLLEGES)
        place = college(b) if known is None else college(b) | F.exists(F.coalesce(known, F.array().cast("array<string>")), b.contains)
        found = F.when(degree(a) & place, 1).when(degree(b) & college(a), 2).when(degree(a) & (n_words(b) <= 8), 1)
        return F.when(~is_single(a), found)

    return _halves(x, fixed.DEGREE_SEPARATORS, ("degree", "institution"), choose)


def is_course(x: Column) -> Column:
    return x.rlike("(?U)" + fixed.COURSE_LINE)


def entry_blocks(x: Column) -> Column:
    """The entries of a section: blank lines part them; where there are none, lines that look like a head."""
    blocks = F.filter(F.transform(F.split(strip(x), r"(?U)\n\s*\n+"), lambda b: strip(b)), lambda b: b != "")

    def facts(line: Column) -> Column:
        bare = strip(line)
        stays = starts_with_any(bare, fixed.BULLET_STARTS) | is_course(bare) | line.rlike(RANGE) | line.rlike(SINGLE)
        head = has_any(F.lower(bare), fixed.JOBS + fixed.DEGREES) & (n_words(bare) <= 7) & ~bare.rlike("[.;]")
        return F.struct(line.alias("line"), (~stays & (split_title_company(bare).isNotNull() | head)).alias("head"))

    def regroup(rows: Column) -> Column:
        # where blocks start, and how many lines the current one has
        start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"), F.lit(0).alias("held"))

        def step(s: Column, r: Column) -> Column:
            new = r.head & (s.held >= 2)
            return F.struct(F.when(new, F.array_append(s.starts, s.at)).otherwise(s.starts).alias("starts"), (s.at + 1).alias("at"), F.when(new, F.lit(1)).otherwise(s.held + 1).alias("held"))

        def cut(starts: Column) -> Column:
            bounds = F.concat(F.array(F.lit(0)), starts, F.array(F.size(rows)))
            return F.transform(F.sequence(F.lit(0), F.size(starts)), lambda i: strip(F.array_join(F.transform(F.slice(rows, F.get(bounds, i) + 1, F.get(bounds, i + 1) - F.get(bounds, i)), lambda r: r.line), "\n")))

        return let(F.aggregate(rows, start, step, lambda s: s.starts), cut)

    def choose(b: Column) -> Column:
        own = F.filter(lines(x), lambda y: strip(y) != "")
        single = let(F.transform(own, facts), regroup)
        return F.when((F.size(b) <= 1) & x.contains("\n"), let(single, lambda s: F.when(F.size(s) > 1, s).otherwise(b))).otherwise(b)

    return let(blocks, choose)


def _set(open_: Column, value: Column, old: Column) -> Column:
    return F.when(open_, value).otherwise(old)


def experience_of(block: Column, known: Column | None = None) -> Column:
    """One job from the lines of an entry."""

    def facts(line: Column) -> Column:
        low, bare, bullet = F.lower(line), strip(line, fixed.EDGE), starts_with_any(line, fixed.BULLET_STARTS)
        short = ~bullet & (n_words(bare) <= 6)
        named = F.lit(None).cast("string") if known is None else F.get(F.filter(known, lambda o: line.contains(o) & (n_words(o) <= 5)), F.lit(0))
        return F.struct(
            F.when(short, named).alias("named"),
            line.alias("line"),
            bare.alias("bare"),
            date_range(line).alias("date"),
            (strip(F.regexp_replace(line, RANGE, ""), fixed.EDGE_COMMA) == "").alias("only_date"),
            split_title_company(line).alias("both"),
            (short & has_any(low, fixed.JOBS)).alias("job"),
            (short & has_any(low, fixed.FIRMS)).alias("firm"),
            (~starts_with_any(line, fixed.SHORT_BULLET_STARTS) & ~line.rlike(RANGE)).alias("plain"),
        )

    empty = F.struct(*(F.lit("").alias(c) for c in ("title", "company", "dates")), F.array().cast("array<string>").alias("told"))

    def step(s: Column, r: Column) -> Column:
        dated = (s.dates == "") & (r.date != "")
        only = dated & r.only_date
        both = ~only & ((s.title == "") | (s.company == "")) & r.both.isNotNull()
        job = ~only & ~both & r.job & (s.title == "")
        # a line that names an organisation gives the company, and is told as well
        named = ~only & ~both & ~job & r.named.isNotNull() & (s.company == "")
        firm = ~only & ~both & ~job & ~named & r.firm & (s.company == "")
        rest = ~(only | both | job | firm)
        return F.struct(
            _set(job, r.bare, _set(both & (s.title == ""), r.both.title, s.title)).alias("title"),
            _set(named, r.named, _set(firm, r.bare, _set(both & (s.company == ""), r.both.company, s.company))).alias("company"),
            _set(dated, r.date, s.dates).alias("dates"),
            _set(rest, F.array_append(s.told, r.line), s.told).alias("told"),
        )

    def finish(rows: Column) -> Column:
        def record(s: Column) -> Column:
            spare = or_empty(strip(F.get(F.filter(rows, lambda r: r.plain), F.lit(0)).line, fixed.EDGE))
            title = F.when(s.title == "", spare).otherwise(s.title)
            return F.struct(s.company.alias("company"), title.alias("title"), s.dates.alias("dates"), strip(F.array_join(s.told, "\n")).alias("description"))

        return let(F.aggregate(rows, empty, step), record)

    return let(F.transform(full_lines(block), facts), finish)


def experience(x: Column, known: Column | None = None) -> Column:
    """ARRAY<STRUCT<company, title, dates, description>> of a section; ``known`` has organisations that a model found."""
    jobs = F.transform(entry_blocks(or_empty(x)), lambda b: experience_of(b, known))
    return F.filter(jobs, lambda e: (e.title != "") | (e.company != ""))


def education_of(block: Column, known: Column | None = None) -> Column:
    """One degree from the lines of an entry."""

    def facts(line: Column) -> Column:
        low, bare = F.lower(line), strip(line, fixed.EDGE_COMMA)
        undated = strip(F.regexp_replace(strip(F.regexp_replace(line, RANGE, ""), fixed.EDGE_COMMA), SINGLE, ""), fixed.EDGE_COMMA)
        return F.struct(
            bare.alias("bare"),
            any_date(line).alias("date"),
            (undated == "").alias("only_date"),
            (is_course(line) | starts_with_any(line, fixed.SHORT_BULLET_STARTS)).alias("skip"),
            split_degree_institution(bare, known).alias("both"),
            has_any(low, fixed.DEGREES).alias("degree"),
            has_any(low, fixed.COLLEGES).alias("college"),
        )

    empty = F.struct(*(F.lit("").alias(c) for c in ("degree", "institution", "dates")))

    def step(s: Column, r: Column) -> Column:
        dated = (s.dates == "") & (r.date != "")
        out = (dated & r.only_date) | r.skip
        both = ~out & ((s.degree == "") | (s.institution == "")) & r.both.isNotNull()
        degree = ~out & ~both & r.degree & (s.degree == "")
        college = ~out & ~both & ~degree & r.college & (s.institution == "")
        return F.struct(
            _set(degree, r.bare, _set(both & (s.degree == ""), r.both.degree, s.degree)).alias("degree"),
            _set(college, r.bare, _set(both & (s.institution == ""), r.both.institution, s.institution)).alias("institution"),
            _set(dated, r.date, s.dates).alias("dates"),
        )

    def by_model(s: Column) -> Column:
        # what the lines don't give comes from degree phrases and organisations of the whole entry
        college = F.get(F.filter(known, lambda o: block.contains(o) & has_any(F.lower(o), fixed.COLLEGES) & ~is_course(o)), F.lit(0))
        fill = lambda old, new: F.when(old == "", or_empty(new)).otherwise(old)
        return F.struct(fill(s.degree, degree_phrase(block)).alias("degree"), fill(s.institution, college).alias("institution"), s.dates.alias("dates"))

    def record(s: Column) -> Column:
        only_date = is_range(strip(s.degree)) | is_single(strip(s.degree))
        place = F.when(is_course(s.institution) | starts_with_any(s.institution, "-•*"), F.lit("")).otherwise(s.institution)
        return F.struct(place.alias("institution"), F.when(only_date, F.lit("")).otherwise(s.degree).alias("degree"), F.when(only_date & (s.dates == ""), s.degree).otherwise(s.dates).alias("dates"))

    said = F.aggregate(F.transform(full_lines(block), facts), empty, step)
    return let(said if known is None else let(said, by_model), record)


def education(x: Column, known: Column | None = None) -> Column:
    """ARRAY<STRUCT<institution, degree, dates>> of a section; ``known`` has organisations that a model found."""
    return F.filter(F.transform(entry_blocks(or_empty(x)), lambda b: education_of(b, known)), lambda e: (e.degree != "") | (e.institution != ""))


def projects(x: Column) -> Column:
    """ARRAY<STRUCT<name, description>>: an entry's first line and the others."""

    def project(block: Column) -> Column:
        return let(full_lines(block), lambda y: F.struct(or_empty(strip(F.get(y, F.lit(0)), fixed.EDGE)).alias("name"), strip(F.array_join(F.slice(y, 2, F.greatest(F.size(y) - 1, F.lit(0))), "\n")).alias("description")))

    return F.filter(F.transform(entry_blocks(or_empty(x)), project), lambda p: p["name"] != "")


def list_items(x: Column) -> Column:
    """Distinct items of a delimited list, in order, of at most 50 characters."""
    items = F.transform(F.split(or_empty(x), fixed.ITEM_SPLIT), lambda y: strip(y, fixed.ITEM_EDGE))
    return F.array_distinct(F.filter(items, lambda y: (y != "") & (F.length(y) <= 50)))


def certifications(x: Column) -> Column:
    """ARRAY<STRUCT<name, issuer, dates>>: lines of more than three characters; issuer and dates are always empty."""
    named = F.filter(F.transform(lines(or_empty(x)), lambda y: strip(y, fixed.EDGE)), lambda y: F.length(y) > 3)
    return F.transform(named, lambda y: F.struct(y.alias("name"), F.lit("").alias("issuer"), F.lit("").alias("dates")))


def degree_phrase(x: Column) -> Column:
    """The first phrase that names a degree; null if there is none."""
    return F.nullif(F.regexp_extract(x, fixed.DEGREE_PHRASES, 0), F.lit(""))
