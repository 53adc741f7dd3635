"""What the plans of queries must look like to stay in proportion to their tables."""

import pytest
from pyspark.sql import functions as F

from dossier.plans import record
from dossier.plans.queries import queries

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["name_heuristic", "email", "phone", "linkedin", "portfolio_url", "segment_sections", "skills_exact_scan", "skills_fuzzy_indel", "skill_match_trace"])
def test_texts_are_made_once_and_by_all_tasks(spark, name):
    """Neither a query's own filter nor an inferred one makes the texts a second time, where the file is read."""
    text = plan(queries()[name](spark, SMALL))
    assert text.count("ArrowEvalPython [_compose") == 1
    assert "_compose" not in text.split("Repartition", 1)[1]


def test_jobs_of_one_set_of_skills_meet_records_as_one_row(spark):
    jobs = spark.createDataFrame([(j, 2, ["A", "b"]) for j in range(500)] + [(900, 1, ["c"]), (901, 3, ["B", "a", "A"]), (902, 0, [])], "jd_id LONG, required LONG, skills ARRAY<STRING>")
    records = spark.createDataFrame([(1, ["a", "B"]), (2, ["C"]), (3, ["x"]), (4, [])], "doc_id LONG, skills ARRAY<STRING>")
    met = record.matches(records, jobs)
    got = sorted(map(tuple, met.collect()))
    assert got == sorted([(1, j, 2, 2, 100) for j in range(500)] + [(1, 901, 3, 2, 66), (2, 900, 1, 1, 100)])
    # rows for pairs arise above the last join
    text = plan(met)
    assert 0 <= text.find("Generate explode(ids") < text.find("Join")


def test_pairs_are_dealt_over_tasks_and_take_little_disk(spark, tmp_path, monkeypatch):
    """Jobs of one set of skills: the rows of pairs come from many tasks, as runs that files hold in a fraction of a byte a row."""
    monkeypatch.setattr(record, "SLOTS", 4, raising=False)
    jobs = spark.range(20_000).select(F.col("id").alias("jd_id"), F.lit(2).alias("required"), F.array(F.lit("A"), F.lit("b")).alias("skills"))
    records = spark.range(160).select(F.col("id").alias("doc_id"), F.array(F.lit("B"), F.lit("x")).alias("skills"))
    record.matches(records, jobs).withColumn("task", F.spark_partition_id()).write.parquet(out := f"{tmp_path}/out")
    got = spark.read.parquet(out)
    assert got.select("doc_id", "jd_id").distinct().count() == got.count() == 160 * 20_000
    assert [tuple(r) for r in got.select("required", "matched", "score").distinct().collect()] == [(2, 1, 50)]
    assert got.select("task").distinct().count() > 1
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.5 * 160 * 20_000
