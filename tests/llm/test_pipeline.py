"""The pipeline's stages against brute force, on a small fixture."""

import importlib
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dossier.llm import toxicity

from .test_jaccard import brute as brute_near
from .test_text_operators import brute_copies


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for table in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    steps = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        steps.append(docs.collect())
        assert k == 4 or docs.columns == columns
    start = spark.read.parquet(f"{tmp_path}/documents.parquet")
    chain = toxicity.train(start, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(start, chain).where("rejected").collect()}
    want = {r.doc_id for r in start.collect()} - rejected
    assert {r.doc_id for r in steps[0]} == want
    want = {i for i, keep, *_ in brute_copies(steps[0]) if i == keep}
    assert {r.doc_id for r in steps[1]} == want
    want = {i for i, _, c in brute_near([(r.doc_id, r.text) for r in steps[1]]) if i == c}
    assert {r.doc_id for r in steps[2]} == want and len(steps[2]) == len(want)
    texts = {r.doc_id: r.text for r in steps[2]}
    assert all(texts[r.doc_id] == r.text for r in steps[3])
    size = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(size(steps[3]) - 1.5 * size(steps[2])) <= 0.05 * size(steps[2])
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = 0
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    for r in steps[4]:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        total += r.length
    assert total == sum(len(ids[r.doc_id]) for r in steps[3])
    assert {r.sequence_id for r in steps[4]} == set(range(-(-total // 2048)))


def test_rows_of_one_id_and_rows_without_text(spark, tmp_path):
    words = " ".join(f"w{k}" for k in range(40))
    texts = [(3, "A x y"), (5, "A x y"), (5, "quite another text"), (5, "A x  y"), (8, None), (9, ""), (11, words), (11, words + " more"), (12, "short text")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, _row_ string").repartition(3)
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    kept = corpus_pipeline.drop_copies(spark, docs, "")
    assert rows(kept) == rows(docs.where("doc_id IN (8, 11, 12) OR text IN ('A x  y', 'quite another text')"))
    assert kept.columns == docs.columns
    near = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert near.count() == 6 and near.where("text = 'quite another text'").count() == 1 and near.where("doc_id = 11").count() == 1
    assert near.where("text IS NULL OR text = ''").count() == 2
    taken = corpus_pipeline.mix(spark, docs, "")
    size = lambda df: df.agg(F.sum(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), " "), "")))).first()[0]
    assert taken.columns == docs.columns and abs(size(taken) - 1.5 * size(docs)) <= 41
    assert corpus_pipeline.pack(spark, docs, "").where("doc_id IN (8, 9)").agg(F.sum("length")).first()[0] == 2


def test_a_result_outlives_a_run_of_the_pipeline(spark):
    from dossier.llm.queries import queries

    before = queries()["op7_exact_dedup"](spark, "/root/testdata/sf0.001")
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert before.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from dossier.llm.workdir import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(cluster)


def test_run_and_an_empty_table(spark, tmp_path):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.agg(F.min("offset")).first()[0] == 0
    for table in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {k[: k.index("_") + 1] for k in names if k.startswith("op")} and "pipeline" in names
    assert "dossier.llm" in sys.modules
