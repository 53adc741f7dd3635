"""Skills of a text by a dictionary: patterns, phrases, similar phrases, and explicit lists."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import fixed
from dossier.functions.textkit import each, let, lines, sorted_fold, strip, title_case, words
from dossier.sources.ontology import Ontology

#: The least similarity that counts; lower thresholds are raised to it.
LEAST = 85.0


def _texts(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _lookup(table: dict[str, str], key: Column) -> Column:
    if not table:
        return F.lit(None).cast("string")
    return F.when(key.isin(*table), F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key))


def exact(x: Column, ontology: Ontology) -> Column:
    """Canonicals whose alias occurs as a word of its own.

    Aliases of one word are looked up among the text's words; the others are
    searched for, each only where its plain text occurs at all.
    """
    own = {a.folded: a.canonical for a in ontology.aliases if a.is_word}
    rest = [a for a in ontology.aliases if not a.is_word]

    def found(folded: Column) -> Column:
        hits = F.array_intersect(F.split(folded, r"(?U)[^\w]+"), _texts(own))
        single = F.transform(hits, lambda w: _lookup(own, w))
        several = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(folded.contains(a.folded) & x.rlike(a.pattern), F.lit(a.canonical)) for a in rest)))
        return F.array_distinct(F.concat(single, several))

    return let(F.lower(x), found)


def exact_found(x: Column, ontology: Ontology) -> Column:
    """ARRAY<STRUCT<source, alias, canonical>>: the first alias of each canonical that ``exact`` finds, and the text that it matched."""
    folded = F.lower(x)
    at = lambda a: F.when(folded.contains(a.folded) & x.rlike(a.pattern), F.struct(strip(F.regexp_extract(x, a.pattern, 0)).alias("source"), F.lit(a.folded).alias("alias"), F.lit(a.canonical).alias("canonical")))
    none = F.lit(None).cast("struct<source:string,alias:string,canonical:string>")
    found = F.array_compact(F.array(none, *map(at, ontology.aliases)))
    return let(found, lambda f: F.filter(f, lambda y, i: F.array_position(F.transform(f, lambda z: z.canonical), y.canonical) == i + 1))


def candidate_phrases(x: Column) -> Column:
    """Chunks between delimiters of at most 50 characters, with their words, pairs and triples of words."""

    def phrases(chunk: Column) -> Column:
        def grams(w: Column) -> Column:
            run = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " "))).otherwise(_texts([]))
            many = F.concat(F.filter(w, lambda y: F.length(y) >= 2), run(2), run(3))
            return F.concat(F.array(chunk), F.when(F.size(w) > 1, many).otherwise(_texts([])))

        return let(words(chunk), grams)

    chunks = F.transform(F.split(x, fixed.ITEM_SPLIT), lambda y: strip(y, fixed.ITEM_EDGE))
    chunks = F.filter(chunks, lambda y: (y != "") & (F.length(y) <= 50))
    return F.array_distinct(F.filter(F.flatten(F.transform(chunks, phrases)), lambda p: ~F.lower(p).isin(*fixed.NOT_SKILLS)))


def lookup_keys(x: Column) -> Column:
    """Candidate phrases as they are looked up: in lower case, three characters or more."""
    keys = F.transform(candidate_phrases(x), lambda p: strip(F.lower(p)))
    return F.array_distinct(F.filter(keys, lambda k: ~k.isin(*fixed.NOT_SKILLS) & (F.length(k) >= 3)))


def phrase_skills(x: Column, ontology: Ontology) -> Column:
    """Canonicals of candidate phrases that are aliases."""
    return F.array_distinct(F.transform(F.array_intersect(lookup_keys(x), _texts(ontology.canonical)), lambda k: _lookup(ontology.canonical, k)))


def explicit(x: Column, ontology: Ontology) -> Column:
    """What a skills section lists: canonicals, or the words in title case."""
    parts = F.flatten(F.transform(lines(F.coalesce(x, F.lit(""))), lambda y: F.split(strip(y, fixed.EDGE), "[,;]+")))
    names = F.filter(F.transform(parts, lambda y: strip(y, fixed.EDGE)), lambda y: (y != "") & (F.length(y) <= 60))
    return F.array_distinct(F.transform(names, lambda y: F.coalesce(_lookup(ontology.canonical, F.lower(y)), title_case(y))))


def token_sort(x: Column) -> Column:
    """Words in order, joined by spaces."""
    return F.array_join(F.array_sort(words(x)), " ")


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts."""

    def row(before: Column, letter: Column, other: Column) -> Column:
        # values to the right of the last one: from above, from the left, or one more on the diagonal
        start = F.struct(F.array(F.lit(0)).alias("out"), F.lit(0).alias("i"))

        def step(s: Column, c: Column) -> Column:
            left, above = F.element_at(s.out, -1), F.get(before, s.i + 1)
            best = F.greatest(left, above, F.when(c == letter, F.get(before, s.i) + 1).otherwise(0))
            return F.struct(F.array_append(s.out, best).alias("out"), (s.i + 1).alias("i"))

        return F.aggregate(other, start, step, lambda s: s.out)

    letters = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    return let(letters(b), lambda other: F.aggregate(letters(a), F.array_repeat(F.lit(0), F.size(other) + 1), lambda before, c: row(before, c, other), lambda r: F.element_at(r, -1)))


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * common subsequence / total length."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * common_length(a, b) / total)


#: Longest text whose positions fit the bits of a number, with one to spare for a sum.
MOST_BITS = 62
#: Letters are told apart by their code modulo this; small letters and digits all differ.
LETTERS = 39


def letter_mask(x: Column) -> Column:
    """A bit for each letter that occurs. An insertion or deletion changes one bit at most, so the differing bits bound the edits between two texts."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.ascii(c), F.lit(LETTERS)))
    return F.aggregate(F.split(x, ""), F.lit(0).cast("bigint"), lambda m, c: m.bitwiseOR(F.when(c == "", F.lit(0).cast("bigint")).otherwise(bit(c))))


def _traits(a: str) -> dict:
    """Of a constant text: its letter mask, and the positions of each of its letters as bits; none where it is too long."""
    mask, bits = 0, {}
    for i, c in enumerate(a):
        mask |= 1 << ord(c) % LETTERS
        bits[c] = bits.get(c, 0) | 1 << i
    return {"mask": mask, "bits": bits if len(a) <= MOST_BITS else None}


def common_bits(x: Column, bits: Column, length: Column) -> Column:
    """``common_length`` of a text and one of this length whose letters' positions are given as bits, one step a letter."""
    one = F.lit(1).cast("bigint")
    full = F.call_function("shiftleft", one, length) - one

    def step(free: Column, c: Column) -> Column:
        own = free.bitwiseAND(F.coalesce(F.try_element_at(bits, c), F.lit(0).cast("bigint")))
        return let(own, lambda u: (free + u).bitwiseOR(free - u).bitwiseAND(full))

    return length - F.bit_count(F.aggregate(F.split(x, ""), full, step))


def _indel(x: Column, a: Column, bits: Column) -> Column:
    """``indel_ratio`` of a text and one with traits, neither empty."""
    fast = 200.0 * common_bits(x, bits, F.length(a)) / (F.length(x) + F.length(a))
    return F.when(bits.isNull(), indel_ratio(x, a)).otherwise(fast)


def phrase_rows(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, phrase) of the keys looked up."""
    return each(df, [key], lookup_keys(F.col(text)), "phrase")


def similar(phrases: DataFrame, ontology: Ontology, threshold: float = LEAST, method: str = "indel") -> DataFrame:
    """(phrase, alias, canonical, score) for distinct phrases that resemble an alias without being one.

    ``indel``: the best alias by token-sorted similarity, then the guard that
    it has as many words and a length within 3. ``levenshtein``: the first
    alias in dictionary order with the same first character that passes the
    guard and the threshold. Either joins on lengths, never all with all.
    """
    least = max(float(threshold), LEAST)
    spark = phrases.sparkSession
    rows = list(dict.fromkeys((f, c) for f, c in ontology.canonical.items()))
    sorted_ = lambda a: " ".join(sorted(a.split()))
    table = spark.createDataFrame([(n, a, c, sorted_(a), *_traits(sorted_(a)).values()) for n, (a, c) in enumerate(rows)], "idx INT, alias STRING, canonical STRING, a STRING, mask BIGINT, bits MAP<STRING, BIGINT>")
    distinct = phrases.select("phrase").where(F.length("phrase") >= 4).distinct().join(table.select(F.col("alias").alias("phrase")), "phrase", "left_anti")
    n = lambda c: F.size(words(F.col(c)))
    if method == "indel":
        one = distinct.select("phrase", token_sort(F.col("phrase")).alias("p")).withColumn("has", letter_mask(F.col("p")))
        two = table
        # a similarity of T bounds the lengths: each is at most (200 - T) / T of the other
        ratio = (200 - least) / least
        two = two.withColumn("size", F.explode(F.sequence(F.ceil(F.length("a") / ratio).cast("int"), F.floor(F.length("a") * ratio).cast("int"))))
        met = one.withColumn("size", F.length("p")).join(two, "size")
        # edits are at least Levenshtein's distance, so too distant pairs go before the costly score
        most = F.floor((100 - least) * (F.length("p") + F.length("a")) / 100).cast("int")
        met = met.where(F.bit_count(F.col("has").bitwiseXOR(F.col("mask"))) <= most).where(F.call_function("levenshtein", F.col("p"), F.col("a"), most) >= 0)
        near = met.withColumn("score", _indel(F.col("p"), F.col("a"), F.col("bits"))).where(F.col("score") >= least)
        best = near.groupBy("phrase").agg(F.max(F.struct("score", (-F.col("idx")).alias("first"), "alias", "canonical")).alias("b")).select("phrase", "b.alias", "b.canonical", "b.score")
        return best.where((n("phrase") == n("alias")) & (F.abs(F.length("phrase") - F.length("alias")) <= 3))
    fold = lambda c: F.array_join(F.array_sort(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))), " ")
    one = distinct.select("phrase", F.substring("phrase", 1, 1).alias("initial"), n("phrase").alias("n"), fold("phrase").alias("p"))
    two = table.drop("a").where(F.substring("alias", 1, 1).rlike(r"(?U)[\p{L}\p{N}]")).select("*", F.substring("alias", 1, 1).alias("initial"), n("alias").alias("n"), fold("alias").alias("a"))
    longest = F.greatest(F.length("p"), F.length("a"))
    score = F.when(F.col("p") == F.col("a"), F.lit(100.0)).when(F.least(F.length("p"), F.length("a")) == 0, F.lit(0.0)).otherwise(F.round((1 - F.levenshtein("p", "a") / longest) * 100, 2))
    near = one.join(two, ["initial", "n"]).where(F.abs(F.length("phrase") - F.length("alias")) <= 3).withColumn("score", score).where(F.col("score") >= least)
    return near.groupBy("phrase").agg(F.min(F.struct("idx", "alias", "canonical", "score")).alias("b")).select("phrase", "b.alias", "b.canonical", "b.score")


def _groups(rows: list[tuple[int, dict]], fields: str) -> Column:
    """A constant array that has, for each length of a phrase, the array of what can resemble it."""
    groups: list[list[dict]] = [[] for _ in range(max((n for n, _ in rows), default=0) + 1)]
    for n, row in rows:
        groups[n].append(row)
    return F.from_json(F.lit(json.dumps(groups)), f"ARRAY<ARRAY<STRUCT<{fields}>>>")


def similar_in(keys: Column, ontology: Ontology, threshold: float = LEAST, method: str = "indel") -> Column:
    """ARRAY<STRUCT<phrase, alias, canonical, score>> of the looked-up keys of one text, by the rules of ``similar``.

    Everything happens within the row: of the dictionary, which is a constant
    of the plan, only aliases of a fitting length are compared, and those too
    many edits away go before the costly score.
    """
    kind = "array<struct<phrase:string,alias:string,canonical:string,score:double>>"
    if not ontology.canonical:
        return F.array().cast(kind)
    least, rows = max(float(threshold), LEAST), []
    if method == "indel":
        ratio = (200 - least) / least
        for n, (alias, canonical) in enumerate(ontology.canonical.items()):
            a = " ".join(sorted(alias.split()))
            row = {"idx": n, "alias": alias, "canonical": canonical, "a": a, **_traits(a)}
            rows += [(size, {**row, "most": math.floor((100 - least) * (size + len(a)) / 100)}) for size in range(math.ceil(len(a) / ratio), math.floor(len(a) * ratio) + 1)]
        groups = _groups(rows, "idx INT, alias STRING, canonical STRING, a STRING, mask BIGINT, bits MAP<STRING, BIGINT>, most INT")

        def best(p: Column) -> Column:
            def of(k: Column) -> Column:
                alike = F.filter(F.get(groups, F.length(k.s)), lambda c: F.bit_count(k.mask.bitwiseXOR(c.mask)) <= c.most)
                near = F.filter(alike, lambda c: F.call_function("levenshtein", k.s, c.a, c.most) >= 0)
                scored = F.transform(near, lambda c: F.struct(_indel(k.s, c.a, c.bits).alias("score"), (-c.idx).alias("first"), c["alias"].alias("alias"), c.canonical.alias("canonical")))
                return F.array_max(F.filter(scored, lambda y: y.score >= least))

            def guarded(b: Column) -> Column:
                fits = (F.size(words(p)) == F.size(words(b["alias"]))) & (F.abs(F.length(p) - F.length(b["alias"])) <= 3)
                return F.when(b.isNotNull() & fits, F.struct(p.alias("phrase"), b["alias"].alias("alias"), b.canonical.alias("canonical"), b.score.alias("score")))

            return let(let(let(token_sort(p), lambda s: F.struct(s.alias("s"), letter_mask(s).alias("mask"))), of), guarded)
    else:
        for n, (alias, canonical) in enumerate(ontology.canonical.items()):
            if not alias[:1].isalnum():
                continue
            row = {"idx": n, "alias": alias, "canonical": canonical, "a": " ".join(sorted(re.findall(r"\w+", alias))), "initial": alias[0], "n": len(alias.split())}
            rows += [(size, row) for size in range(max(0, len(alias) - 3), len(alias) + 4)]
        groups = _groups(rows, "idx INT, alias STRING, canonical STRING, a STRING, initial STRING, n INT")

        def best(p: Column) -> Column:
            def of(k: Column) -> Column:
                longest = lambda c: F.greatest(F.length(k.s), F.length(c.a))
                score = lambda c: F.when(k.s == c.a, F.lit(100.0)).when(F.least(F.length(k.s), F.length(c.a)) == 0, F.lit(0.0)).otherwise(F.round((1 - F.levenshtein(k.s, c.a) / longest(c)) * 100, 2))
                near = F.filter(F.get(groups, F.length(p)), lambda c: (c.initial == k.initial) & (c.n == k.n))
                scored = F.filter(F.transform(near, lambda c: F.struct(p.alias("phrase"), c["alias"].alias("alias"), c.canonical.alias("canonical"), score(c).alias("score"))), lambda y: y.score >= least)
                return F.get(scored, F.lit(0))

            fold = F.array_join(F.array_sort(F.regexp_extract_all(p, F.lit(r"(?U)\w+"), F.lit(0))), " ")
            return let(F.struct(fold.alias("s"), F.substring(p, 1, 1).alias("initial"), F.size(words(p)).alias("n")), of)

    unknown = F.filter(keys, lambda k: (F.length(k) >= 4) & ~k.isin(*ontology.canonical))
    return F.array_compact(F.transform(unknown, best)).cast(kind)


def skill_matches(df: DataFrame, ontology: Ontology, threshold: float = LEAST, method: str = "indel", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, kind, source, alias, canonical, score): why each skill was found."""
    kind = "struct<kind:string,source:string,alias:string,canonical:string,score:double>"
    if not ontology.aliases:
        return df.select(key, F.explode(F.array().cast(f"array<{kind}>")).alias("m")).select(key, "m.*")
    row = lambda name, source, alias, canonical, score: F.struct(F.lit(name).alias("kind"), source.alias("source"), alias.alias("alias"), canonical.alias("canonical"), score.alias("score")).cast(kind)

    def found(keys: Column) -> Column:
        first = F.transform(exact_found(F.col(text), ontology), lambda e: row("EXACT", e.source, e["alias"], e.canonical, F.lit(100.0)))
        second = F.transform(F.array_intersect(keys, _texts(ontology.canonical)), lambda k: row("EXACT PHRASE", k, k, _lookup(ontology.canonical, k), F.lit(100.0)))
        third = F.transform(similar_in(keys, ontology, threshold, method), lambda m: row("FUZZY", m.phrase, m["alias"], m.canonical, m.score))
        return F.concat(first, second, third)

    return each(df, [key], let(lookup_keys(F.col(text)), found), "m").select(key, "m.*")


def skills_in(x: Column, ontology: Ontology, threshold: float = LEAST, method: str = "indel") -> Column:
    """The distinct skills of one text, in order of their lower case: exact, by phrase, and similar ones."""
    if not ontology.aliases:
        return _texts([])

    def found(keys: Column) -> Column:
        phrases = F.transform(F.array_intersect(keys, _texts(ontology.canonical)), lambda k: _lookup(ontology.canonical, k))
        near = F.transform(similar_in(keys, ontology, threshold, method), lambda m: m.canonical)
        return F.array_union(exact(x, ontology), F.array_union(phrases, near))

    return sorted_fold(let(lookup_keys(x), found))


def skills(df: DataFrame, ontology: Ontology, threshold: float = LEAST, method: str = "indel", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, skills) of each row, as ``skills_in`` finds them; keys without any are left out."""
    return df.select(key, skills_in(F.coalesce(F.col(text), F.lit("")), ontology, threshold, method).alias("skills")).where(F.size("skills") > 0)


def category_name(skill: Column, ontology: Ontology) -> Column:
    """The display name of a skill's category."""
    return F.coalesce(_lookup({c: fixed.CATEGORY_NAMES[g] for c, g in ontology.category.items() if g in fixed.CATEGORY_NAMES}, skill), F.lit(fixed.OTHER_CATEGORY))


def by_category(x: Column, ontology: Ontology) -> Column:
    """Map from category to its skills in order; categories as first seen."""

    def group(rows: Column) -> Column:
        names = F.array_distinct(F.transform(rows, lambda r: r.category))
        own = lambda g: sorted_fold(F.transform(F.filter(rows, lambda r: r.category == g), lambda r: r.skill))
        return F.map_from_entries(F.transform(names, lambda g: F.struct(g, own(g))))

    return let(F.transform(x, lambda s: F.struct(category_name(s, ontology).alias("category"), s.alias("skill"))), group)
