"""Section headings and the segmentation of a text by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import fixed
from dossier.functions.textkit import let, lines, strip

#: Sections that every map has.
ALWAYS = [s for s in fixed.SECTIONS if s != "publications"]
_NAMES = {name: section for section, names in fixed.SECTIONS.items() for name in names}


def heading_key(line: Column) -> Column:
    """What is looked up: the line in lower case without decoration; null if it can't be a heading."""
    bare = strip(line)
    key = F.regexp_replace(F.regexp_replace(bare, r"^[\s#*\-_~>|•·°º]+", ""), r"[\s#*\-_~:|•·°º]+$", "")
    return F.when((bare != "") & (F.length(bare) <= 60), F.lower(key))


def heading(line: Column) -> Column:
    """The section that a line opens; null if it is no heading."""
    table = F.create_map(*(F.lit(x) for pair in _NAMES.items() for x in pair))
    key = heading_key(line)
    return F.when(key.isin(*_NAMES), F.try_element_at(table, key))


def segments(x: Column) -> Column:
    """(section, lines) of each stretch between headings; the first belongs to ``contact``."""

    def cut(marked: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(marked) - 1), lambda i: F.get(marked, i).section.isNotNull())
        starts = F.concat(F.array(F.lit(-1)), at)

        def stretch(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(marked))
            section = F.when(start < 0, F.lit("contact")).otherwise(F.get(marked, F.greatest(start, F.lit(0))).section)
            own = F.slice(marked, start + 2, F.greatest(end - start - 1, F.lit(0)))
            return F.struct(section.alias("section"), F.transform(own, lambda m: m.line).alias("lines"))

        return F.transform(starts, stretch)

    return let(F.transform(lines(x), lambda y: F.struct(heading(y).alias("section"), y.alias("line"))), cut)


def sections(x: Column) -> Column:
    """Map from section to its text. ``publications`` is there only where a heading names it."""

    def gather(parts: Column) -> Column:
        def text(name: Column) -> Column:
            own = F.flatten(F.transform(F.filter(parts, lambda p: p.section == name), lambda p: p.lines))
            return strip(F.array_join(own, "\n"))

        names = F.array(*map(F.lit, ALWAYS))
        extra = F.filter(F.array(F.lit("publications")), lambda n: F.exists(parts, lambda p: p.section == n))
        return F.map_from_entries(F.transform(F.concat(names, extra), lambda n: F.struct(n, text(n))))

    return let(segments(x), gather)


def section_lines(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, line_no, section, line): the same by a window, one row per line; only for tables of short texts."""
    rows = df.select(key, F.posexplode(lines(F.col(text))).alias("line_no", "line")).withColumn("opens", heading(F.col("line")))
    so_far = Window.partitionBy(key).orderBy("line_no")
    named = rows.withColumn("section", F.coalesce(F.last("opens", ignorenulls=True).over(so_far), F.lit("contact")))
    return named.where("opens IS NULL").select(key, "line_no", "section", "line")
