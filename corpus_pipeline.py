"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), with docs the table its predecessor
wrote, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from dossier.llm.queries import tokenizer
from dossier.llm.workdir import Workspace


def _numbered(docs: DataFrame, space: Workspace) -> DataFrame:
    """The rows with a number each, written once, so that decisions meet the very row they were made on."""
    return space.table(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, space: Workspace | None = None) -> DataFrame:
    """Rows that the classifier chain, fitted on the labelled ones, doesn't reject.

    Each row is judged by its own text; null and empty texts have no words and
    stay unless the chain rejects everything without words. Without labels all stay.
    """
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), space=space)
    return toxicity.clean(docs, chain)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, space: Workspace | None = None) -> DataFrame:
    """One row of each group of equal texts: the longest original, then the smallest id.

    Null texts count as empty, so one of all null and empty ones stays. Rows
    that share an id are judged each by its own text.
    """
    space = space or Workspace(spark)
    rows = _numbered(docs, space)
    kept = exact_dedup.groups(rows, row="_row", space=space).where("kept").select("_row")
    return rows.join(kept, "_row", "left_semi").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, space: Workspace | None = None) -> DataFrame:
    """The row of smallest id of each component of linked rows.

    Null and empty texts link with nothing and stay. Rows that share an id are
    judged each by its own text.
    """
    space = space or Workspace(spark)
    rows = _numbered(docs, space)
    parts = jaccard_join.components(rows, key="_row", space=space).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("part"))
    # most rows are components of their own and need no look at the others
    mixed = parts.where("_row <> part").select("part").distinct()
    least = rows.select("_row", "doc_id").join(parts.join(mixed, "part"), "_row").groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("best"))
    dropped = space.table(parts.join(least, "part").where(F.col("best._row") != F.col("_row")).select("_row"), "pipeline-near")
    return rows.join(dropped, "_row", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str, space: Workspace | None = None) -> DataFrame:
    """Each row as often as the mix takes it; rows without words are drawn like the others and add no words."""
    space = space or Workspace(spark)
    rows = _numbered(docs, space)
    copies = mixing.mix_sources(rows, key="_row", space=space).where("copies > 0").select(F.col("doc_id").alias("_row"), "copies")
    taken = rows.join(copies, "_row")
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, space: Workspace | None = None) -> DataFrame:
    """Pieces of the rows in sequences of 2,048 tokens; null and empty texts are one end token."""
    return packing.digests(packing.pack(docs, tokenizer("byte_bpe_50k.json"), space=space))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: The first, fourth and fifth stage can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it; what only a finished stage read is deleted."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark)
    for name, stage in STAGES[:-1]:
        before, space = docs, Workspace(spark)
        docs = written.table(stage(spark, docs, sf_dir, space), name.replace(" ", "-"))
        space.close()
        written.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
