"""Cleaning of raw text, in a fixed order of steps."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dossier.functions import fixed
from dossier.functions.textkit import WHITE, lines, strip


def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(x: Column) -> Column:
    """Unicode compatibility composition, which the JVM functions don't offer; ASCII passes untouched."""
    return F.pandas_udf(_compose, StringType())(x)


def literals(x: Column) -> Column:
    """Typographic quotes, dashes, dots and spaces as ASCII; zero-width characters and carriage returns go."""
    ascii_ = F.translate(x, "‘’“”–—―\xa0​﻿\r", "''\"\"--- ")
    return F.replace(F.replace(ascii_, F.lit("…"), F.lit("...")), F.lit("\t"), F.lit("    "))


def controls(x: Column) -> Column:
    """Control, format and unassigned characters but line feeds, and all beyond the basic plane, as spaces."""
    return F.regexp_replace(x, r"[\p{C}&&[^\n]]|[\x{10000}-\x{10FFFF}]", " ")


def pages_and_dividers(x: Column) -> Column:
    """Page numbers and divider lines go; their line break stays."""
    for pattern in [*fixed.PAGE_LINES, fixed.DIVIDER_LINES]:
        x = F.regexp_replace(x, pattern.replace("m)", "md)", 1), "")
    return x


def bullets(x: Column) -> Column:
    """Bullet glyphs that start a line as ``- ``; lines are stripped."""
    glyphs = f"[{fixed.BULLETS}]"

    def one(line: Column) -> Column:
        bare = strip(line)
        rest = strip(F.regexp_replace(bare, rf"^{glyphs}+\s*", ""))
        framed = bare.rlike(r"^°\s*[A-Z\s]+\s*°$")
        return F.when(~framed & bare.rlike(f"^{glyphs}"), F.concat(F.lit("- "), rest)).otherwise(bare)

    return F.array_join(F.transform(lines(x), one), "\n")


def white_space(x: Column) -> Column:
    """Single spaces, stripped lines, one blank line at most, nothing blank at the ends."""
    tidy = F.transform(lines(F.regexp_replace(x, r"[ \t]+", " ")), lambda y: F.btrim(y, F.lit(WHITE)))
    return strip(F.regexp_replace(F.array_join(tidy, "\n"), r"\n{3,}", "\n\n"))


def clean(x: Column, compose: bool = True) -> Column:
    """All steps; null is empty. ``compose=False`` leaves out NFKC and with it the only Python step."""
    x = literals(F.coalesce(x, F.lit("")))
    x = nfkc(x) if compose else x
    return white_space(bullets(pages_and_dividers(controls(x))))
