"""Near-duplicate embeddings by product quantisation.

Vectors of equal label and direction first become one class. Classes are coded
against coarse centroids and per-subspace codebooks of the residuals, both
fitted on a bounded hash sample. A query probes every list that can hold a
vector within reach: y in the list of c' is no farther from c' than from the
query's own centroid c, so the query lies within the link radius of the plane
between them. Within a list, table-lookup distances to the codes, lowered by
each code's stored error, bound the true distance from below; what passes is
reranked by the exact cosine. Both bounds are exact up to rounding, so links
are found wholly, not in part.

Lists too large for a task are cut into blocks, and so are their queries; each
block of vectors meets each block of queries in a task of its own. A task sends
back how many rows each query links with and a spanning forest of its links,
so dense groups aren't expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.components import connected_components, forest
from dossier.llm.workdir import Workspace

COSINE = 0.98
#: Vectors that centroids and codebooks are fitted on, at most.
SAMPLE = 16_384
#: Classes of a label in a list, about, and vectors of the sample for each list at least: the sample bounds the lists, blocks do the rest.
LIST, PER_LIST = 400, 8
SUBSPACES, CODES = 8, 64
#: Codes, and queries, of a list that one task holds at once.
BLOCK = 2048
#: Allowance for rounding in single steps; candidates are reranked exactly.
SLACK = 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k centroids of the rows of x."""
    k = min(k, len(x))
    if not k:
        return np.zeros((0, x.shape[1]))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from those of c."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray, rows: int = 4096) -> np.ndarray:
    return np.concatenate([distances(x[at : at + rows], c).argmin(1) for at in range(0, len(x), rows)] or [np.zeros(0, np.int64)])


class Quantiser:
    """Coarse centroids and residual codebooks of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centroids = kmeans(sample, lists) if len(sample) else np.zeros((1, sample.shape[1]))
        residual = sample - self.centroids[nearest(sample, self.centroids)] if len(sample) else np.zeros((1, sample.shape[1]))
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [kmeans(residual[:, p], CODES) for p in self.parts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, error): error is the distance from what the codes stand for."""
        own = nearest(x, self.centroids)
        rest = x - self.centroids[own]
        codes = np.column_stack([nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)]).astype(np.uint8)
        for j, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            rest[:, p] -= b[codes[:, j]]
        return own, codes, np.sqrt((rest * rest).sum(1))

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, distance from its centroid): every list that can hold a vector within ``radius`` of a row."""
        d = distances(x, self.centroids)
        between = np.sqrt(distances(self.centroids, self.centroids))
        own = d.argmin(1)
        rows, lists = np.nonzero(d - d[np.arange(len(x)), own][:, None] <= 2 * radius * between[own] + SLACK)
        return rows, lists, np.sqrt(d[rows, lists])

    def lower_bounds(self, query: np.ndarray, at: int, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances of queries from the coded vectors of list ``at``."""
        rest = query - self.centroids[at]
        total = np.zeros((len(query), len(codes)))
        for j, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            total += distances(rest[:, p], b)[:, codes[:, j]]
        return np.sqrt(total) - error


def unit_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, unit): unit null where the vector can't link."""

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            # null components become NaN, which is as little finite
            x = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            starts, size = offsets[:-1] - offsets[0], np.diff(offsets)
            good = (size > 0) & (np.asarray(lists.is_valid()) & np.asarray(batch.column(1).is_valid()))
            some = np.flatnonzero(size > 0)
            if len(some):
                at = starts[some]
                fine = np.logical_and.reduceat(np.isfinite(x), at)
                x = np.where(np.repeat(fine, size[some]), x, 0.0)
                top = np.maximum.reduceat(np.abs(x), at)
                x = x / np.repeat(np.where(top > 0, top, 1.0), size[some])
                x = x / np.repeat(np.where(top > 0, np.sqrt(np.add.reduceat(x * x, at)), 1.0), size[some])
                good[some] &= fine & (top > 0)
            raw = x.astype("<f8").tobytes()
            out = [raw[8 * a : 8 * (a + n)] if g else None for a, n, g in zip(starts.tolist(), size.tolist(), good.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "unit"])

    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("embedding"))
    return rows.mapInArrow(norm, "vec_id long, label long, unit binary")


def link_classes(classes: DataFrame, space: Workspace, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """(id, more): the rows of other classes that a class links with; (a, b): links enough to give the components of all."""
    spark = classes.sparkSession
    # lengths of vectors: each is a space of its own; one row per dimension. Vectors meet within their label, so lists are cut for the largest
    labels = classes.groupBy(F.octet_length("unit").alias("d"), "label").agg(F.count(F.lit(1)).alias("n"))
    dims = {r.d: (r.n, r.most) for r in labels.groupBy("d").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()}
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    fitted = {}
    for d, (n, most) in dims.items():
        step = max(1, math.ceil(n / SAMPLE))
        rows = classes.where(F.octet_length("unit") == d).where(F.pmod(F.xxhash64("unit"), F.lit(step)) == 0).select("unit").orderBy(F.xxhash64("unit")).limit(SAMPLE).collect()
        x = np.frombuffer(b"".join(bytes(r.unit) for r in rows), "<f8").reshape(-1, d // 8)
        fitted[d] = Quantiser(x, max(1, min(most // LIST, len(x) // PER_LIST)))
    model = spark.sparkContext.broadcast(fitted)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dim", "label", "list", "member", "id", "n", "unit", "codes", "error", "away"]
        for batch in batches:
            pdf = batch.to_pandas()
            size = pdf["unit"].map(len)
            for d, own in pdf.groupby(size):
                q = model.value[d]
                x = np.frombuffer(b"".join(own["unit"]), "<f8").reshape(len(own), -1)
                at, codes, error = q.encode(x)
                away = np.sqrt(((x - q.centroids[at]) ** 2).sum(1))
                for member, rows, lists, far in ((True, np.arange(len(own)), at, away), (False, *q.probes(x, radius))):
                    part = own.iloc[rows]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), d, np.int32)), pa.array(part["label"].to_numpy()), pa.array(lists.astype(np.int32)), pa.array(np.full(len(rows), member)), pa.array(part["id"].to_numpy()), pa.array(part["n"].to_numpy()), pa.array(part["unit"].tolist(), pa.binary()), pa.array([c.tobytes() if member else None for c in codes[rows]], pa.binary()), pa.array(error[rows]), pa.array(far)],
                        names,
                    )

    key = ["dim", "label", "list"]
    schema = "dim int, label long, list int, member boolean, id long, n long, unit binary, codes binary, error double, away double"
    rows = space.table(classes.mapInArrow(spread, schema), "embedding-lists")
    # a list's vectors lie in a ring around its centroid; queries farther from the ring than the radius find nothing there
    rings = rows.where("member").groupBy(*key).agg(F.max("away").alias("outer"), F.min("away").alias("inner"), F.count(F.lit(1)).alias("members"))
    near = F.col("member") | ((F.col("away") <= F.col("outer") + radius + SLACK) & (F.col("away") >= F.col("inner") - radius - SLACK))
    rows = rows.join(rings, key).where(near).drop("outer", "inner", "away")
    asking = rows.where("NOT member").groupBy(*key).agg(F.count(F.lit(1)).alias("queries"))
    rows = rows.join(asking, key).withColumn("inside", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("asking", F.ceil(F.col("queries") / BLOCK).cast("int"))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("member"), F.col("asking")).otherwise(F.col("inside")) - 1))
    met = rows.select(*key, "member", "id", "n", "unit", "codes", "error", own("inside").alias("i"), own("asking").alias("j"), other.alias("k"))
    met = met.withColumn("block", F.when(F.col("member"), F.struct("i", F.col("k").alias("j"))).otherwise(F.struct(F.col("k").alias("i"), "j"))).drop("i", "j", "k")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        inside, asked = pdf[pdf["member"]], pdf[~pdf["member"]]
        counts, edges = [], (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(inside) and len(asked):
            q, at = model.value[int(pdf["dim"].iloc[0])], int(pdf["list"].iloc[0])
            codes = np.frombuffer(b"".join(inside["codes"]), np.uint8).reshape(len(inside), -1)
            x = np.frombuffer(b"".join(inside["unit"]), "<f8").reshape(len(inside), -1)
            error, ids, n = inside["error"].to_numpy(), inside["id"].to_numpy(), inside["n"].to_numpy()
            for first in range(0, len(asked), 256):
                part = asked.iloc[first : first + 256]
                y, query = np.frombuffer(b"".join(part["unit"]), "<f8").reshape(len(part), -1), part["id"].to_numpy()
                close = (q.lower_bounds(y, at, codes, error) <= radius) & (query[:, None] != ids)
                i, j = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
                good = close[np.ix_(i, j)] & (y[i] @ x[j].T >= cosine)
                total = good @ n[j]
                counts.append(pd.DataFrame({"a": query[i][total > 0], "n": total[total > 0]}))
                i, j = i[np.nonzero(good)[0]], j[np.nonzero(good)[1]]
                edges = forest(np.concatenate([edges[0], query[i]]), np.concatenate([edges[1], ids[j]]))
        out = [*counts, pd.DataFrame({"a": edges[0], "b": edges[1]})]
        return pd.concat(out).reindex(columns=["a", "b", "n"]).astype("Int64")

    found = space.table(met.groupBy(*key, "block").applyInPandas(meet, "a long, b long, n long"), "embedding-links")
    return found.where("n IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("more")), found.where("b IS NOT NULL").select("a", "b")


def near_duplicates(df: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label", space: Workspace | None = None) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Vectors link within a label at a cosine of ``cosine`` or more. Null labels
    and vectors that are null, zero, or hold null or non-finite components
    link with nothing; vectors of different lengths never link. Equal vectors
    are one class, so groups of copies aren't expanded into pairs. Repeated
    ids count as vectors of their own; other columns are ignored.
    """
    space = space or Workspace(df.sparkSession)
    rows = space.table(unit_vectors(df, key, vector, label), "embedding-units")
    # classes have numbers of their own: rows that share an id can lie in several
    classes = rows.where("unit IS NOT NULL").groupBy("label", "unit").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = space.table(classes.select(F.monotonically_increasing_id().alias("id"), "*"), "embedding-classes")
    more, links = link_classes(classes.drop("least"), space, cosine)
    parts = space.table(connected_components(links, space).withColumnRenamed("node", "id"), "embedding-parts")
    least = parts.join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("component_id"))
    parts = parts.join(least, "component").select("id", "component_id")
    found = classes.join(more, "id", "left").join(parts, "id", "left")
    found = found.select("label", "unit", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.join(found, ["label", "unit"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
