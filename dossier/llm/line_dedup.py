"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words. A word becomes one number, its hash shifted by
twice its length, so long words tend to come first: they are the rare ones, and no
table has to say so. The order need only be the same everywhere for what
follows to be exact; words of one number make lines meet, never part.

Sets link at a Jaccard similarity of 0.8 if and only if they share i words
and n >= 5x + 4y, where n = i + x is the size of the one and m = i + y that of
the other. Consider the pairs of words that are neighbours in the order. A
word that only this set has breaks two of its neighbourhoods, a word that only
the other has breaks one, so at most 2x + y are broken, and that is at most
2 * floor(n / 5), and one more where n is 4 modulo 5. Of one neighbourhood more
than that from the start, each set holds the first that both share (prefix
filter on pairs). Pairs of words are much rarer than words, so few lines meet
that don't link; those that meet are compared by size and by sketches of
parities, in which a word changes one, and then on the words themselves.

Lines of equal sets are one class, standing at its first place. Only the
question whether an earlier line links matters. So each class first meets the
earliest class and the one before it for each of its keys, which is two
candidates a key, however many lines share it; only classes that link with none
of these go on to meet the others, for keys of more than three. There too only
those meet whose sketches are near enough, long lines by wide sketches.

Only built-in expressions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.workdir import Workspace

#: What parts words within a line.
BLANKS = "\t\x0b\x0c\r"
PLACE = ("doc_id", "tie", "line_no")
#: Keys are met in so many rounds, of which only one takes disk at a time.
ROUNDS = 2
#: Lines of more words have a wide sketch, as 64 parities don't tell them apart.
SHORT = 40

_NUMBER = "shiftrightunsigned(xxhash64(w), 2 * octet_length(w))"
_PARITIES = "aggregate(numbers, 0L, (a, x) -> a ^ shiftleft(1L, int(x & 63)))"
_WIDE = "array(" + ", ".join(f"aggregate(numbers, 0L, (a, x) -> if((shiftright(x, 6) & 3) = {k}, a ^ shiftleft(1L, int(x & 63)), a))" for k in range(4)) + ")"
_REACH = "2 * int(n div 5) + if(n % 5 = 4, 2, 1)"


def spaced(text: Column) -> Column:
    """The text with spaces for all that parts words."""
    # most texts have none, and looking for a character is cheaper than replacing it
    some = reduce(Column.__or__, (F.contains(text, F.lit(c)) for c in BLANKS))
    return F.when(some, F.translate(text, BLANKS, " " * len(BLANKS))).otherwise(text)


def words_of(line: Column) -> Column:
    """The distinct words of a spaced line."""
    return F.array_distinct(F.array_remove(F.split(line, " "), ""))


def documents(df: DataFrame, text: str, key: str) -> DataFrame:
    """(doc_id, tie, text); the tie, a hash of the text, tells rows of one id apart."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))


def numbered(docs: DataFrame) -> DataFrame:
    """Lines (doc_id, tie, line_no, line) with ids that follow the places.

    Where no doc_id comes twice and there is room in 63 bits, the id is made of
    doc_id and line number; else the texts are sorted.
    """
    docs = docs.where("text IS NOT NULL")
    have = docs.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text")), F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    least, most, longest, rows, ids = have
    if packed := 0 < rows == ids and (most - least + 1) * (longest + 1) < 2**62:
        # a small table is dealt over all cores
        if docs.rdd.getNumPartitions() < (cores := docs.sparkSession.sparkContext.defaultParallelism):
            docs = docs.repartition(cores)
    else:
        docs = docs.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    lines = docs.select("doc_id", "tie", F.posexplode(F.split(spaced(F.col("text")), "\n")).alias("line_no", "line"))
    # tested on the line, as a filter on its words would split it twice
    lines = lines.where(F.btrim("line") != "")
    own = (F.col("doc_id") - least) * (longest + 1) + F.col("line_no") if packed else F.monotonically_increasing_id()
    return lines.select(own.alias("id"), *PLACE, "line")


def lines_of(docs: DataFrame, space: Workspace) -> DataFrame:
    """(id, doc_id, tie, line_no, n, first, same, sketch, wide, keys) of each line with words; ids follow the places.

    ``first`` is the earliest line of this set, ``same`` tells whether the line
    is at that very place, in an equal row. ``keys`` are those of a first line's
    neighbourhoods, null where it can link with no other set; ``sketch`` holds
    64 parities, ``wide`` 256 of a long line, else null.
    """
    rows = numbered(docs).select("id", *PLACE, words_of(F.col("line")).alias("words"))
    rows = rows.select("id", *PLACE, F.size("words").alias("n"), F.xxhash64(F.sort_array("words")).alias("k2"), F.sort_array(F.expr(f"transform(words, w -> {_NUMBER})")).alias("numbers"))
    keys = F.expr(f"if(n > 3, zip_with(slice(numbers, 1, {_REACH}), slice(numbers, 2, {_REACH}), (a, b) -> xxhash64(a, b)), null)")
    sketch = F.expr(f"if(n > 3, {_PARITIES}, 0L)")
    wide = F.expr(f"if(n > {SHORT}, {_WIDE}, null)")
    rows = space.table(rows.select("id", *PLACE, "n", F.xxhash64("numbers").alias("k1"), "k2", sketch.alias("sketch"), wide.alias("wide"), keys.alias("keys")), "line-rows")
    firsts = [F.min_by(c, "id").alias(f"first_{c}") for c in PLACE]
    known = rows.groupBy("k1", "k2", "n").agg(F.min("id").alias("first"), *firsts, F.count(F.lit(1)).alias("lines")).where("lines > 1").drop("lines")
    same = reduce(Column.__and__, (F.col(c) == F.col(f"first_{c}") for c in PLACE))
    all_rows = rows.join(known, ["k1", "k2", "n"], "left").withColumn("first", F.coalesce("first", "id"))
    keys = F.when(F.col("id") == F.col("first"), F.col("keys"))
    out = space.table(all_rows.select("id", *PLACE, "n", "first", F.coalesce(same, F.lit(True)).alias("same"), "sketch", "wide", keys.alias("keys")), "line-sets")
    space.drop(rows)
    return out


def near(other: str) -> Column:
    """Whether a set may link with another, by (n, sketch) and the other's columns of these names."""
    m, bits = f"{other}_n", f"{other}_sketch"
    return F.expr(f"5 * n >= 4 * {m} AND 5 * {m} >= 4 * n AND 9 * bit_count(sketch ^ {bits}) <= n + {m}")


def shared_keys(classes: DataFrame, space: Workspace) -> list[DataFrame]:
    """(key, id, n, sketch, head, prev, many) of the keys that several classes hold, for those that may link by them.

    ``head`` and ``prev`` are the key's earliest class and the one before this,
    null where they can't link; ``many``: the key has more than three holders.
    """
    out = []
    holders = Window.partitionBy("key").orderBy("id")
    whole = holders.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for turn in range(ROUNDS):
        rows = classes.select("id", "n", "sketch", F.explode("keys").alias("key")).where(F.pmod("key", F.lit(ROUNDS)) == turn)
        ends = [f(c).over(w).alias(f"{name}_{c}") for f, w, name in ((F.first, whole, "head"), (F.lag, holders, "prev")) for c in ("id", "n", "sketch")]
        # most keys have one holder, and these go before anything else is asked of them
        rows = rows.select("*", F.count(F.lit(1)).over(whole).alias("holders")).where("holders > 1").select("*", *ends)
        head = F.when((F.col("head_id") < F.col("id")) & near("head"), F.col("head_id")).alias("head")
        prev = F.when(near("prev"), F.col("prev_id")).alias("prev")
        rows = rows.select("key", "id", "n", "sketch", head, prev, (F.col("holders") > 3).alias("many"))
        out.append(space.table(rows.where("head IS NOT NULL OR prev IS NOT NULL OR many"), "line-keys"))
    return out


def texts_of(ids: DataFrame, lines: DataFrame, docs: DataFrame, space: Workspace) -> DataFrame:
    """(id, line) of the lines with these ids."""
    places = lines.select("id", *PLACE).join(ids.distinct(), "id").groupBy("doc_id", "tie").agg(F.collect_list(F.struct("id", "line_no")).alias("places"))
    # a text is split below the generator, once for all its lines
    found = docs.join(places, ["doc_id", "tie"]).select(F.split("text", "\n").alias("own"), "places").select("own", F.explode("places").alias("p"))
    return space.table(found.select("p.id", F.get("own", F.col("p.line_no")).alias("line")).dropDuplicates(["id"]), "line-texts")


def similar(other: str) -> Column:
    """Whether sets may link by (n, wide) and the other's columns of these names; true where one has no wide sketch."""
    apart = " + ".join(f"bit_count(wide[{k}] ^ {other}_wide[{k}])" for k in range(4))
    return F.expr(f"coalesce(9 * ({apart}) <= n + {other}_n, true)")


def verified(close: DataFrame, lines: DataFrame, docs: DataFrame, space: Workspace) -> DataFrame:
    """(id): those classes of ``close`` (id, other) whose words link with the other's."""
    close = space.table(close.distinct(), "line-close")
    texts = texts_of(close.select("id").union(close.select("other")), lines, docs, space)
    both = close.join(texts.toDF("id", "a"), "id").join(texts.toDF("other", "b"), "other")
    both = both.select("id", *(words_of(spaced(F.col(c))).alias(f"w{c}") for c in "ab"))
    out = space.table(both.where(9 * F.size(F.array_intersect("wa", "wb")) >= 4 * (F.size("wa") + F.size("wb"))).select("id").distinct(), "line-found")
    space.drop(close, texts)
    return out


def later(lines: DataFrame, docs: DataFrame, space: Workspace) -> DataFrame:
    """(id): classes that link with an earlier one."""
    turns = shared_keys(lines.where("keys IS NOT NULL").select("id", "n", "sketch", "keys"), space)
    shared = reduce(DataFrame.union, turns)
    pairs = shared.select("id", F.col("head").alias("other")).union(shared.select("id", F.col("prev").alias("other")))
    pairs = space.table(pairs.where("other IS NOT NULL").distinct(), "line-pairs")
    sets = lines.select("id", "n", "wide")
    close = pairs.join(sets, "id").join(sets.toDF("other", "other_n", "other_wide"), "other").where(similar("other"))
    found = verified(close.select("id", "other"), lines, docs, space)
    many = space.table(shared.where("many").select("key", "id", "n", "sketch").join(lines.where("wide IS NOT NULL").select("id", "wide"), "id", "left"), "line-many")
    space.drop(pairs, *turns)
    left = many.join(found, "id", "left_anti")
    met = left.join(many.toDF(*(c if c == "key" else "other" if c == "id" else f"other_{c}" for c in many.columns)), "key")
    met = met.where((F.col("other") < F.col("id")) & near("other") & similar("other"))
    more = verified(met.select("id", "other"), lines, docs, space)
    space.drop(many)
    return found.union(more)


def removed_lines(docs: DataFrame, space: Workspace) -> DataFrame:
    """(doc_id, tie, line_no) of the lines of which an earlier line is a near duplicate."""
    lines = lines_of(docs, space)
    gone = later(lines, docs, space)
    out = lines.select("id", *PLACE).join(gone, "id").select(*PLACE).union(lines.where("id <> first AND NOT same").select(*PLACE))
    out = space.table(out, "line-gone")
    space.drop(lines, gone)
    return out


def dedup_lines(df: DataFrame, text: str = "text", key: str = "doc_id", space: Workspace | None = None) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, kept_sha256, kept.

    A line is what lies between line feeds. It goes when an earlier line, of a
    smaller id or before it in the same text, has a word set of Jaccard
    similarity 0.8 or more; lines are judged on the input. Lines without words
    always stay. Null texts have no lines and stay null, with the digest of an
    empty text. Rows that share an id are texts of their own, in an order given
    by their contents; rows with the same id and text are treated as one. Other
    columns are ignored.
    """
    space = space or Workspace(df.sparkSession)
    docs = documents(df, text, key)
    gone = removed_lines(docs, space).groupBy("doc_id", "tie").agg(F.collect_set("line_no").alias("gone"))
    rows = docs.join(gone, ["doc_id", "tie"], "left").withColumn("split", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("split"), i)), "\n"))
    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("split")).cast("long")
    removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    rows = rows.select("doc_id", lines.alias("n_lines"), removed.alias("n_removed"), kept.alias("kept"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"), "kept")
