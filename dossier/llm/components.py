"""Connected components by local forests and alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.workdir import Workspace

#: Edges that a task holds at once.
PART = 200_000


def connected_components(edges: DataFrame, space: Workspace, a: str = "a", b: str = "b", part: int = PART) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge with two ends.

    A round first replaces the edges of each partition by a forest, so each
    task solves what it holds; with all edges in one partition that is the
    answer. Otherwise each edge then meets its ends' smallest neighbours, which
    come from pre-aggregated minima; hot nodes are on one side of an equi-join
    only, so adaptive execution can split them. Rounds are logarithmic in
    practice; each is written to the shared folder.
    """

    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = space.table(tidy(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "components")
    size, seen = edges.count(), None
    while True:
        parts = -(-size // part)
        local = (edges.coalesce(1) if parts <= 1 else edges.repartition(parts, "a", "b")).mapInPandas(_solve, "a long, b long")
        local = space.table(local, "components")
        space.drop(edges)
        edges = local
        if parts <= 1:
            break
        # large star: larger neighbours move to the smallest of the neighbourhood
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = tidy(both.where("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).toDF("a", "b"))
        # small star: smaller neighbours and the node itself move to the smallest
        large = space.table(large, "components")
        space.drop(edges)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).union(least.select("a", "m").toDF("x", "y"))
        edges = space.table(tidy(moved.toDF("a", "b")), "components")
        space.drop(large)
        now = _digest(edges)
        if now == seen:
            break
        size, seen = now[0], now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(edges.select("b", "b").distinct().toDF("node", "component"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component), other than itself, of the graph with edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forest of a partition's edges, which are added to it batch by batch."""
    node = least = np.zeros(0, np.int64)
    for pdf in parts:
        node, least = forest(np.concatenate([node, pdf["a"].to_numpy()]), np.concatenate([least, pdf["b"].to_numpy()]))
    yield pd.DataFrame({"a": node, "b": least})


def _digest(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftrightunsigned(F.xxhash64("b", "a"), 24))).first())
