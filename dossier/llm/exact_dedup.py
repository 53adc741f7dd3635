"""Exact deduplication by an extendible-hash index on shared files.

Rows are written once, in runs, with the 64-bit hash of their normalised text.
A run first collapses its own equal texts. The directory is built from the
distinct hashes: it doubles, one more leading bit of the hash at a time, while
a bucket holds more than ``capacity`` of them; only overfull buckets split.
Each bucket is a range of hashes with one owner task, which gets one text from
each run that has it. The owner sorts its bucket by hash and bytes: texts that
collide in their hash stand in one chain and are told apart byte by byte. What
it finds is the index, written to the shared folder by owners; rows take their
answers from its entries.

A hot text reaches its owner once from each run, never row by row, and a run
has RUN rows at most. Only built-in expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.workdir import Workspace

#: Distinct hashes a bucket holds before it splits.
CAPACITY = 5_000
#: Rows of a run at most, as a power of two.
RUN = 16
#: Doublings at most beyond what evenly spread hashes need: further on, hashes share so many leading bits that splitting is in vain and a bucket grows a longer chain.
SPREAD = 6

SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without any of ``[\\x20\\x09-\\x0D]``; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def hashed(norm: Column) -> Column:
    return F.xxhash64(norm)


def prefix(h: Column, depth: int) -> Column:
    """The first ``depth`` bits of a hash."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(hashes: DataFrame, space: Workspace, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(entry, bucket) for every value of the directory's bits, and the number of these bits, its depth.

    ``hashes`` has distinct values ``h``. A bucket is named by its first entry.
    """
    total, done = hashes.count(), []
    # pigeonhole: before this depth some bucket is overfull for sure
    depth = max(0, (total // capacity).bit_length() - 1)
    deepest = min(63, depth + SPREAD)
    open_ = space.table(hashes.groupBy(prefix(F.col("h"), deepest).alias("fine")).agg(F.count(F.lit(1)).alias("n")), "dedup-prefixes")
    while True:
        at = F.shiftright("fine", deepest - depth)
        counts = space.table(open_.groupBy(at.alias("at")).agg(F.sum("n").alias("n")), "dedup-directory")
        over = counts.where(F.col("n") > capacity)
        last = depth == deepest
        done.append((depth, counts if last else counts.where(F.col("n") <= capacity)))
        if last or over.isEmpty():
            break
        # only overfull buckets split; the directory doubles for them
        open_ = open_.join(over.select(F.col("at").alias("_at")), at == F.col("_at"), "left_semi")
        depth += 1
    found = None
    for local, counts in done:
        wide = depth - local
        start = F.shiftleft("at", wide)
        rows = counts.select(F.explode(F.sequence(start, start + (1 << wide) - 1)).alias("entry"), start.alias("bucket"))
        found = rows if found is None else found.union(rows)
    return space.table(found, "dedup-entries"), depth


def rows_of(df: DataFrame, space: Workspace, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """(run, row, doc_id, n_chars, h, norm) of each row, written so that a run lies in one bucket file."""
    number = F.monotonically_increasing_id()
    rows = df.select(number.alias("_n"), (F.col(row) if row else number).alias("row"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.char_length(text), F.lit(0)).alias("n_chars"), normalised(F.col(text)).alias("norm"))
    rows = rows.select(F.shiftrightunsigned("_n", RUN).alias("run"), "row", "doc_id", "n_chars", hashed(F.col("norm")).alias("h"), "norm")
    return space.table(rows, "dedup-rows", buckets=int(space.spark.conf.get("spark.sql.shuffle.partitions")), by="run")


def build_index(rows: DataFrame, space: Workspace, capacity: int = CAPACITY) -> DataFrame:
    """(bucket, h, members, keep, group_size, digest): an entry for each run's part of each group of equal texts."""
    hashes = space.table(rows.select("h").distinct(), "dedup-hashes")
    entries, depth = directory(hashes, space, capacity)
    member = F.struct("n_chars", (-F.col("doc_id")).alias("minus_id"), (-F.col("row")).alias("minus_row"), "doc_id", "row")
    own = rows.groupBy("run", "h", "norm").agg(F.collect_list(F.struct("doc_id", "row")).alias("members"), F.max(member).alias("best"))
    dealt = own.withColumn("entry", prefix(F.col("h"), depth)).join(entries, "entry").repartition("bucket")
    chain = Window.partitionBy("bucket", "h", "norm")
    best = F.max("best").over(chain)
    index = dealt.select("bucket", "h", "members", F.struct(best.doc_id.alias("doc_id"), best.row.alias("row")).alias("keep"), F.sum(F.size("members").cast("long")).over(chain).alias("group_size"), F.sha2("norm", 256).alias("digest"))
    return space.table(index, "dedup-index")


def groups(df: DataFrame, text: str = "text", key: str = "doc_id", row: str | None = None, capacity: int = CAPACITY, space: Workspace | None = None) -> DataFrame:
    """The rows of ``exact_dedup``, with ``_row``: the number that the column ``row`` gives each row of ``df``."""
    space = space or Workspace(df.sparkSession)
    rows = rows_of(df, space, text, key, row)
    index = build_index(rows, space, capacity)
    space.drop(rows)
    found = index.select(F.explode("members").alias("member"), "keep", "group_size", "digest")
    return found.select(F.col("member.row").alias("_row"), F.col("member.doc_id").alias("doc_id"), F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("member.row") == F.col("keep.row")).alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, space: Workspace | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are copies when their texts are equal without ``[\\x20\\x09-\\x0D]``.
    The longest original text stays, then the smallest key; of rows repeated
    with their key, one. Null texts are empty; a null key comes last; other
    columns are ignored; an empty table gives no rows.
    """
    return groups(df, text, key, None, capacity, space).drop("_row")


SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
