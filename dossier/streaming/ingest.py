"""Files that arrive over time, parsed as they come.

An extension beyond batch parsing: a record is a projection of its text, so a
stream needs no watermark and appends its records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossier.plans.record import Settings, parse_text
from dossier.sources.files import decoded


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, format, text, links, error) of files that arrive in a folder."""
    return decoded(spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder))


def stream_records(texts: DataFrame, settings: Settings | None = None, text: str = "text", key: str = "path") -> DataFrame:
    """Whole records of streamed texts. ``entities``, if set, must be a map without state of its own."""
    return parse_text(texts, settings, text, key)
