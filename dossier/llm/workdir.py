"""Tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A written table cuts lineage: whatever reads it afterwards survives the loss
of the executors that wrote it. Each run of an operator owns a workspace;
nothing but that workspace deletes its tables.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Drops a query's shuffle files when it ends: its rows are in the table by then.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; where none is set, a temporary one on a local master and an error on a cluster."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="dossier-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Workspace:
    """The tables of one run of an operator.

    ``drop`` deletes tables that nothing reads any more. The rest, which the
    operator's result reads, goes with ``close`` or when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}
        self.names: list[str] = []
        self._held: list[DataFrame] = []

    def table(self, df: DataFrame, name: str, buckets: int = 0, by: str = "") -> DataFrame:
        """Write ``df`` and read it back; with ``buckets``, so that joins on the column ``by`` don't shuffle it."""
        spark, unique = self.spark, f"{name}-{uuid.uuid4().hex}"
        path = f"{shared_dir(spark)}/{unique}"
        writer = df.write.format("parquet").option("compression", "zstd")
        with _shuffles_end(spark):
            if buckets:
                table = unique.replace("-", "_")
                writer.bucketBy(buckets, by).option("path", path).saveAsTable(table)
                self.names.append(table)
                out = spark.table(table)
            else:
                writer.save(path)
                out = spark.read.schema(df.schema).parquet(path)
        self._fs(path, "deleteOnExit")
        self.paths[id(out)] = path
        self._held.append(out)  # an id is unique while its frame lives
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables; call once their readers are done."""
        for table in tables:
            if path := self.paths.pop(id(table), None):
                self._fs(path, "delete", True)

    def close(self) -> None:
        """Delete all tables; call once the operator's result is written."""
        for path in self.paths.values():
            self._fs(path, "delete", True)
        self.paths = {}
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []

    def reads(self, df: DataFrame) -> bool:
        """Whether ``df`` still reads one of these tables."""
        files = df.inputFiles()
        return any(path.rsplit("/", 1)[1] in f for path in self.paths.values() for f in files)

    def _fs(self, path: str, call: str, *more) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        getattr(where.getFileSystem(self.spark._jsc.hadoopConfiguration()), call)(where, *more)
