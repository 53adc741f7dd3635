"""From texts or files to candidate records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.textkit import each, let, sorted_fold
from dossier.operators import contact, entries, score, skills
from dossier.operators.clean import clean
from dossier.operators.sections import sections
from dossier.plans.render import FIELDS
from dossier.sources.files import read_files
from dossier.sources.ontology import Ontology

#: Parts that the ids of jobs with the same wanted skills are gathered in.
SHARES = 16
#: Ids of jobs in a block, and parts that the records of a set of wanted skills are dealt to.
BLOCK, SLOTS = 256, 128


@dataclass
class Settings:
    """What can be set: the dictionary, the threshold (at least 85 counts), the similarity, and named entities.

    ``entities`` runs a named-entity model: it adds ``people`` and
    ``organisations`` (arrays of texts as they stand, in order) to (key, text).
    Names the heuristics miss, companies and institutions are then taken from
    these, and degrees from the patterns for degrees. Without it there is no
    named-entity step.
    """

    ontology: Ontology = field(default_factory=Ontology.load)
    threshold: float = skills.LEAST
    similarity: str = "indel"
    entities: Callable[[DataFrame], DataFrame] | None = None


def prepared(df: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns to keep, text, sections) with the text cleaned."""
    return df.select(key, *keep, clean(F.col(text)).alias("text")).select(key, *keep, "text", sections(F.col("text")).alias("sections"))


def parse_text(df: DataFrame, settings: Settings | None = None, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One record per row: FIELDS, after the key and before the columns in ``keep``.

    All are columns of one projection: one scan, no shuffle. With ``entities``
    set, what the model finds is joined by key first.
    """
    settings = settings or Settings()
    ready = prepared(df, text, key, keep)
    if settings.entities:
        ready = ready.join(settings.entities(ready.select(key, "text")).select(key, "people", "organisations"), key, "left")
    part = lambda name: F.col("sections")[name]
    listed = skills.explicit(part("skills"), settings.ontology)
    found = skills.skills_in(F.col("text"), settings.ontology, settings.threshold, settings.similarity)
    known = F.col("organisations") if settings.entities else None
    whom = contact.contact(F.col("text"), part("contact"))
    if settings.entities:
        whom = let(whom, lambda c: c.withField("name", F.coalesce(F.nullif(c["name"], F.lit("")), contact.known_name(F.col("text"), F.col("people")), F.lit(""))))
    return ready.select(
        key,
        whom.alias("contact"),
        part("summary").alias("summary"),
        entries.experience(part("experience"), known).alias("experience"),
        entries.education(part("education"), known).alias("education"),
        sorted_fold(F.array_union(listed, found)).alias("skills"),
        entries.projects(part("projects")).alias("projects"),
        entries.certifications(part("certifications")).alias("certifications"),
        entries.list_items(part("languages")).alias("languages"),
        entries.list_items(part("hobbies")).alias("hobbies"),
        *keep,
    )


def parse_files(spark: SparkSession, path: str, settings: Settings | None = None, strict: bool = False) -> DataFrame:
    """Records of PDF, DOCX and text files, with ``path`` as key and an ``error`` struct where a file can't be read."""
    found = parse_text(read_files(spark, path, strict), settings, "text", "path", keep=("error",))
    # each file is unpacked once: what can't be read goes through as an empty text
    return found.select("path", *(F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in FIELDS), "error")


def matches(records: DataFrame, jobs: DataFrame, key: str = "doc_id", job_key: str = "jd_id") -> DataFrame:
    """(key, job, required, matched, score) of each record (key, skills) and job (job, required, skills) with a skill in common.

    Jobs that want the same skills are compared once: the join is on skills,
    between records and distinct sets of wanted skills. The ids of the jobs of
    a set stay in blocks until after the last join, so nothing that has a row
    for each pair is shuffled or sorted. That join is dealt by set and slot of
    the record, to a number of tasks that doesn't follow from its few bytes. A
    task meets its records with one block after the other, so rows come as runs
    of a record over the same few jobs, which takes a tenth or so of a byte a
    row in Parquet files instead of up to two: ``merge`` keeps this order, in
    which the left side's rows each meet all of the right's.
    """
    folded = lambda c: F.array_sort(F.array_distinct(F.transform(c, F.lower)))
    jobs = jobs.select(job_key, "required", folded("skills").alias("wanted"))
    sets = each(jobs.select("wanted").distinct(), ["wanted"], F.col("wanted"), "skill")
    have = each(records, [key], folded("skills"), "skill")
    met = have.join(sets, "skill").groupBy(key, "wanted").agg(F.count(F.lit(1)).alias("matched"))
    # in order, so that a task that runs again cuts the same blocks
    same = jobs.groupBy("wanted", "required", F.pmod(F.xxhash64(job_key), F.lit(SHARES)).alias("share")).agg(F.array_sort(F.collect_list(job_key)).alias("all"))
    cut = F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(BLOCK)), lambda i: F.slice("all", i + 1, BLOCK))
    blocks = same.where(F.size("all") > 0).select("wanted", "required", F.explode(cut).alias("ids"))
    blocks = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)).cast("array<bigint>")).alias("slot"))
    met = met.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(SLOTS)))
    spark = met.sparkSession
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), "wanted", "slot"
    tiles = blocks.repartition(*dealt).hint("merge").join(met.repartition(*dealt), ["wanted", "slot"])
    score = (F.col("matched") / F.greatest("required", F.lit(1)) * 100).cast("int").alias("score")
    return tiles.select(key, "ids", "required", "matched", score).select(key, F.explode("ids").alias(job_key), "required", "matched", "score")


def compare(records: DataFrame, jobs: DataFrame, settings: Settings | None = None, key: str = "doc_id", job_key: str = "jd_id", zero: bool = False) -> DataFrame:
    """(key, job, required, matched, score): each record against each job it shares a skill with.

    Jobs' skills are found as in texts. A pair without a common skill makes no
    row; ``zero`` adds those pairs with a score of 0, which is as many rows as
    there are records times jobs.
    """
    settings = settings or Settings()
    wanted = jobs.select(job_key, skills.skills_in(F.coalesce(F.col("text"), F.lit("")), settings.ontology, settings.threshold, settings.similarity).alias("skills"))
    wanted = wanted.select(job_key, F.size("skills").alias("required"), "skills")
    met = matches(records.select(key, "skills"), wanted, key, job_key)
    if zero:
        every = records.select(key).crossJoin(wanted.select(job_key, "required"))
        met = every.join(met.drop("required"), [key, job_key], "left").withColumns({"matched": F.coalesce("matched", F.lit(0).cast("long")), "score": F.coalesce("score", F.lit(0))})
    return met


class ResumeEngine:
    """The library's front door: settings once, then files, tables or single texts."""

    def __init__(self, spark: SparkSession, ontology_path: str | None = None, threshold: float = skills.LEAST, similarity: str = "indel", entities=None):
        self.spark = spark
        self.settings = Settings(Ontology.load(spark, ontology_path), threshold, similarity, entities)

    def parse_files(self, path: str, strict: bool = False) -> DataFrame:
        return parse_files(self.spark, path, self.settings, strict)

    def parse_text(self, df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        return parse_text(df, self.settings, text, key)

    def parse_one(self, text: str) -> dict:
        """The record of a single text."""
        df = self.spark.createDataFrame([(0, text)], "doc_id LONG, text STRING")
        return self.parse_text(df).drop("doc_id").first().asDict(recursive=True)

    def extract_skills(self, df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        return skills.skills(df, self.settings.ontology, self.settings.threshold, self.settings.similarity, text, key)

    def compare(self, records: DataFrame, jobs: DataFrame, zero: bool = False) -> DataFrame:
        return compare(records, jobs, self.settings, zero=zero)


def with_scores(records: DataFrame, threshold: float = skills.LEAST) -> DataFrame:
    """Records with completeness, its text, initials and the top title."""
    three = (F.col("skills"), F.col("experience"), F.col("education"))
    return records.select("*", score.completeness(*three, threshold).alias("completeness"), score.completeness_text(*three).alias("completeness_text"), score.initials(F.col("contact")["name"]).alias("initials"), score.top_title(F.col("experience")).alias("top_title"))
