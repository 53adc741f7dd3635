"""Contact details by patterns and heuristics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions import fixed
from dossier.functions.textkit import found, full_lines, has_any, let, n_words, or_empty, strip, title_case, words


def email(x: Column) -> Column:
    return found(x, "(?U)" + fixed.EMAIL)


def format_phone(x: Column) -> Column:
    """+1 and +91 numbers in one layout; others as they are."""

    def layout(d: Column) -> Column:
        part = lambda a, n: F.substr(d, F.lit(a), F.lit(n))
        us = lambda a: F.concat(F.lit("+1 ("), part(a, 3), F.lit(") "), part(a + 3, 3), F.lit("-"), part(a + 6, 4))
        return (
            F.when(F.length(d) == 10, us(1))
            .when((F.length(d) == 11) & d.startswith("1"), us(2))
            .when((F.length(d) == 12) & d.startswith("91"), F.concat(F.lit("+91 "), part(3, 5), F.lit(" "), part(8, 5)))
            .otherwise(strip(x))
        )

    return F.when(x.isNotNull() & (x != ""), let(F.regexp_replace(x, r"\D", ""), layout))


def phone(x: Column) -> Column:
    """The first number of 9 to 15 digits once years are blanked out."""
    bare = F.regexp_replace(F.regexp_replace(x, r"\b(?:19|20)\d{2}\s*[-–—]\s*(?:19|20)\d{2}\b", " "), r"\b(?:19|20)\d{2}\b", " ")
    numbers = F.regexp_extract_all(bare, F.lit(fixed.PHONE), F.lit(0))
    fits = lambda n: F.length(F.regexp_replace(n, r"\D", "")).between(9, 15)
    return format_phone(F.get(F.filter(numbers, fits), F.lit(0)))


def _with_scheme(url: Column) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))


def linkedin(x: Column) -> Column:
    return let(found(x, fixed.LINKEDIN), _with_scheme)


def portfolio(x: Column) -> Column:
    """A GitHub page, else the first address that is neither the LinkedIn page nor a mail host."""
    urls = F.regexp_extract_all(x, F.lit(fixed.URL), F.lit(0))
    profile = or_empty(linkedin(x))
    other = let(profile, lambda p: F.get(F.filter(urls, lambda u: ~F.contains(p, u) & ~has_any(F.lower(u), fixed.MAIL_HOSTS)), F.lit(0)))
    return F.coalesce(let(found(x, fixed.GITHUB), _with_scheme), other)


def name(x: Column) -> Column:
    """A line in capitals among the first ten, else one in title case without digits or addresses."""
    known = F.array(*map(F.lit, fixed.NOT_NAMES))
    letters = r"^\p{L}+$"

    def parts(line: Column) -> Column:
        bare = strip(F.regexp_replace(line, r"[,|•·\-_°º]", " "))
        return F.struct(line.alias("line"), bare.alias("bare"), words(bare).alias("words"))

    def plain(p: Column) -> Column:
        return F.size(p.words).between(2, 4) & ~F.arrays_overlap(F.transform(p.words, F.lower), known)

    def capitals(p: Column) -> Column:
        return plain(p) & F.forall(p.words, lambda w: w.rlike(letters) & (w == F.upper(w)) & (w != F.lower(w)))

    def titled(p: Column) -> Column:
        upper = lambda w: (w == F.upper(w)) & (w != F.lower(w))
        title = lambda w: (w == title_case(w)) & (w != F.lower(w))
        noisy = p.line.rlike(fixed.EMAIL) | p.line.rlike(fixed.PHONE) | F.lower(p.line).contains("http") | p.line.contains("@") | p.line.rlike(r"(?U)\d")
        return plain(p) & ~noisy & F.forall(p.words, lambda w: F.replace(w, F.lit("."), F.lit("")).rlike(letters) & (title(w) | upper(w)))

    def pick(top: Column) -> Column:
        first = F.get(F.filter(top, capitals), F.lit(0)).bare
        second = F.array_join(F.get(F.filter(top, titled), F.lit(0)).words, " ")
        return title_case(F.coalesce(first, second))

    return let(F.transform(F.slice(full_lines(x), 1, 10), parts), pick)


def contact(text: Column, header: Column) -> Column:
    """Struct of the five details, empty where missing; names are looked for in the header or the first 600 characters."""
    top = F.when(or_empty(header) != "", header).otherwise(F.substr(text, F.lit(1), F.lit(600)))
    fields = {"name": name(top), "email": email(text), "phone": phone(text), "linkedin": linkedin(text), "portfolio": portfolio(text)}
    return F.struct(*(or_empty(c).alias(n) for n, c in fields.items()))


def known_name(text: Column, people: Column) -> Column:
    """The first of the people whom a model found that stands, with two words or more, in one of the first lines that could be a name."""
    top = F.slice(full_lines(text), 1, 8)
    fit = F.filter(top, lambda y: ~y.rlike(r"(?U)[\d@]") & ~F.lower(y).contains("http") & n_words(y).between(2, 4))
    return title_case(F.get(F.filter(people, lambda p: (n_words(p) >= 2) & F.exists(fit, lambda y: y.contains(p))), F.lit(0)))
