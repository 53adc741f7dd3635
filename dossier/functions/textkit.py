"""Text functions on columns, with Unicode-aware meanings that plain Spark functions lack."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What strip() takes off; cleaning turns all other white space but line separators into spaces.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(x: Column, chars: str = WHITE) -> Column:
    """The text without any of ``chars`` at either end."""
    return F.btrim(x, F.lit(chars))


def lines(x: Column) -> Column:
    return F.split(x, "\n")


def full_lines(x: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(lines(x), lambda y: strip(y)), lambda y: y != "")


def words(x: Column) -> Column:
    """Words between white space."""
    # split() would compile the pattern again for each text
    return F.regexp_extract_all(x, F.lit(r"(?U)(\S+)"), F.lit(1))


def n_words(x: Column) -> Column:
    return F.size(words(x))


def title_case(x: Column) -> Column:
    """A capital after everything that isn't a letter, lower case otherwise."""
    runs = F.regexp_extract_all(x, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def any_of(texts: list[str]) -> str:
    """A pattern for any of some literal texts."""
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in texts)


def has_any(x: Column, texts: list[str]) -> Column:
    """Whether any of the texts occurs in a lower-case text."""
    return x.rlike(any_of(texts))


def starts_with_any(x: Column, chars: str) -> Column:
    return F.substring(x, 1, 1).isin(*chars)


def found(x: Column, pattern: str) -> Column:
    """The first match; null if there is none."""
    return F.nullif(F.regexp_extract(x, pattern, 0), F.lit(""))


def or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def sorted_fold(x: Column) -> Column:
    """An array of texts in order of their lower case, then their own."""
    pairs = F.array_sort(F.transform(x, lambda s: F.struct(F.lower(s).alias("k"), s.alias("v"))))
    return F.transform(pairs, lambda p: p.v)


def each(df: DataFrame, keep: list[Column | str], values: Column, *names: str) -> DataFrame:
    """``keep`` and one row per element of an array without nulls, or per entry of a map.

    The outer form and a filter on its result: for the plain one the optimizer
    infers a filter on the whole array, which is then made a second time, and
    below a repartition, where a small table is a single task.
    """
    return df.select(*keep, F.explode_outer(values).alias(*names)).where(F.col(names[0]).isNotNull())


def present(df: DataFrame, keep: list[Column | str], value: Column, name: str) -> DataFrame:
    """``keep`` and a value where it isn't null; a plain filter would make the value a second time, as for ``each``."""
    return each(df, keep, F.array(value), name)
