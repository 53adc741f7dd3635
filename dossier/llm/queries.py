"""The subpackage's queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossier.llm.line_dedup import dedup_lines

    return dedup_lines(_read(spark, sf_dir, "documents")).drop("kept")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossier.llm.substring_dedup import dedup_substrings

    return dedup_substrings(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossier.llm.jaccard_join import components

    return components(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossier.llm import toxicity

    documents = _read(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, _read(spark, sf_dir, "labels")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossier.llm.token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossier.llm.packing import digests, pack

    return digests(pack(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossier.llm.exact_dedup import exact_dedup

    return exact_dedup(_read(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossier.llm.embedding_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "embeddings"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from dossier.llm.chat_format import conversations

    # -1 where a message answers none, as a column of nulls alone compares badly
    return conversations(_read(spark, sf_dir, "conversations")).withColumn("parent_turn", F.coalesce("parent_turn", F.lit(-1).cast("long")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossier.llm.mixing import mix_sources

    return mix_sources(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_substring_dedup, op3_toxicity, op4_jaccard_join, op5_token_counts, op6_packing, op7_exact_dedup, op8_embedding_dedup, op9_chat_format, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    from dossier.llm import exact_dedup, oracles

    return {
        "op1_line_dedup": oracles.LINES,
        "op2_substring_dedup": oracles.SUBSTRING,
        "op4_jaccard_join": oracles.JACCARD,
        "op7_exact_dedup": exact_dedup.SQL,
        "op8_embedding_dedup": oracles.EMBEDDINGS,
        "op9_chat_format": f"SELECT * REPLACE (coalesce(parent_turn, -1) AS parent_turn) FROM ({oracles.CONVERSATIONS})",
    }
