"""Mixing sources to target weights by the cube method.

A source's target over its size is the copies each of its documents should
get: a whole number for all, and a fraction that is an inclusion probability.
The flight moves the fractions of three documents at a time along the null
space of their balancing constraints (sum of probabilities, sum of probability
times tokens), so both totals stay exact while at least one fraction becomes 0
or 1. At most two fractions are left over in each bucket of a source; those of
all its buckets fly together, in buckets again while they are many, and the one or
two left then land where the
source's tokens come nearest to the target.

Buckets are cut by a hash of the document's id and text, so a hot source or id
is spread over many tasks, and random numbers derive from both, so reruns agree
whatever the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.arrowtext import Words, mix, slices
from dossier.llm.workdir import Workspace

#: Repeating weights of the sources in order of their names, null last.
WEIGHTS = (5, 2, 1)
#: Share of all tokens that the mix takes, and the most copies of a source.
SHARE, MOST = 1.5, 2.0
#: Rows of a source in a bucket, about.
BUCKET = 2000


def sizes(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, size, tie): words of each row's whole text, null texts 0, and a hash that tells rows of one id apart."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [Words(data, offsets).counts() for _, _, data, offsets in slices(batch.column(2))]
            n = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), batch.column(3)], ["doc_id", "source", "size", "tie"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    return rows.mapInArrow(count, "doc_id long, source string, size long, tie long")


def targets(totals: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Target of each source: shares by weight; what lies above ``most`` times a source's size is shared anew."""
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    cap = {s: most * n for s, n in order}
    left, open_, done = share * sum(n for _, n in order), [s for s, _ in order], {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > cap[s]]
        if not over:
            return done | {s: unit * weight[s] for s in open_}
        for s in over:
            done[s] = cap[s]
            left -= cap[s]
        open_ = [s for s in open_ if s not in done]
    return done


def _uniform(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    return mix((ids ^ ties).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) / 2.0**64


def flight(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Probabilities after the flight: all 0 or 1 but two at most; sums of p and of p times size are kept."""
    p, tiny = p.astype(float).tolist(), 1e-9
    size, draw = size.astype(float).tolist(), draw.tolist()
    hand: list[int] = []
    for k in range(len(p)):
        if not tiny < p[k] < 1 - tiny:
            p[k] = float(round(p[k]))
            continue
        hand.append(k)
        while len(hand) == 3:
            a, b, c = hand
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if u == (0.0, 0.0, 0.0):  # equal sizes: any move that keeps the sum
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(hand, u, strict=True) if x)
            down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(hand, u, strict=True) if x)
            step = up if draw[k] * (up + down) < down else -down
            draw[k] = draw[k] * 7.31 % 1.0
            for i, x in zip(hand, u, strict=True):
                p[i] += step * x
                if not tiny < p[i] < 1 - tiny:
                    p[i] = float(round(p[i]))
            hand = [i for i in hand if 0 < p[i] < 1]
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the last fractions (two at most) so that their tokens come nearest to what they stand for."""
    at = np.flatnonzero((p > 0) & (p < 1))
    due = float((p[at] * size[at]).sum())
    best = min(product((0.0, 1.0), repeat=len(at)), key=lambda x: (abs(sum(a * b for a, b in zip(x, size[at], strict=True)) - due), x))
    p[at] = best
    return p


def _flyer(land: bool, columns: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The flight of one bucket, with the landing or without."""

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size", "tie"], kind="stable", ignore_index=True)
        size = pdf["size"].to_numpy()
        p = flight(pdf["p"].to_numpy(), size, _uniform(pdf["doc_id"].to_numpy(np.int64), pdf["tie"].to_numpy(np.int64)))
        pdf["p"] = landing(p, size) if land else p
        return pdf[columns]

    return fly


def mix_sources(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, text: str = "text", key: str = "doc_id", source: str = "source", space: Workspace | None = None) -> DataFrame:
    """Per row: doc_id, size, source_size, target (its source's), taken (tokens the mix takes).

    ``taken`` is a multiple of ``size``, at most ``most`` rounded up. Null
    texts have size 0, so they are drawn but give no tokens; a null source is a source of its
    own, last in order. Repeated ids are separate rows; other columns are
    ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    space = space or Workspace(spark)
    rows = space.table(sizes(df, text, key, source), "mixing-sizes")
    # one row per source
    totals = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    target = targets([(r.source, r.n) for r in totals], weights, share, most)
    plan, buckets = [], {}
    for r in totals:
        copies = target[r.source] / r.n if r.n else 0.0
        buckets[r.source] = max(1, math.ceil(r.rows / BUCKET))
        plan.append((r.source, r.n, target[r.source], float(math.floor(copies)), copies - math.floor(copies)))
    table = spark.createDataFrame(plan, "s string, source_size long, target double, whole double, p double")
    schema = "doc_id long, source string, size long, tie long, source_size long, target double, whole double, p double"
    order = [c.split(" ")[0] for c in schema.split(", ")]
    open_ = rows.join(table, F.col("source").eqNullSafe(F.col("s")), "left").select(order)
    done, between = [], (F.col("p") > 0) & (F.col("p") < 1)
    while True:
        last = max(buckets.values(), default=1) == 1
        cut = spark.createDataFrame(list(buckets.items()), "s string, buckets int")
        # the level goes into the hash, else what is left of a bucket would meet again
        bucket = F.pmod(F.xxhash64("doc_id", "tie", F.lit(len(done))), F.col("buckets")).cast("int").alias("bucket")
        dealt = open_.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(*order, bucket)
        flown = space.table(dealt.groupBy("source", "bucket").applyInPandas(_flyer(last, order), schema), "mixing-flight")
        if last:
            done.append(flown)
            break
        done.append(flown.where(~between))
        open_ = flown.where(between)
        buckets = {s: math.ceil(2 * b / BUCKET) for s, b in buckets.items()}
    out = reduce(DataFrame.unionByName, done)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("p"))).cast("long").alias("taken"), (F.col("whole") + F.col("p")).cast("int").alias("copies"))
