"""Toxicity by a classifier chain.

Categories are predicted one after the other; each linear model also sees the
probabilities of the categories before it. While training, those are
out-of-fold predictions, so a model never learns from probabilities that were
fitted on its own rows; the features of a fold's models are chosen without the
fold as well.

Features are the distinct words of the whole text, letters and digits with
A-Z folded, and the words' first bytes (stems whose endings vary). Feature
statistics are gathered from a bounded sample of labelled documents: SAMPLE of
them in the order of a hash of their id. Scoring is one map over the documents.

Categories come from given label columns alone, in chain order; by default:
- ``low_quality``: the ``quality`` label is 0
- ``toxic``: the ``toxic`` label is 1; this one decides what is rejected
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.arrowtext import Words, slices
from dossier.llm.workdir import Workspace

#: Labelled rows that the models are fitted on, at most.
SAMPLE = 8000
#: Features kept, at most: those most associated with a category.
FEATURES = 1500
#: Labelled rows a feature must occur in.
LEAST_ROWS = 5
FOLDS = 3
STEMS = (0, 4, 5, 6)
#: Name, label column and the label that means yes.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each feature, feature hashes) over runs of texts."""
    for row, end, data, offsets in slices(column):
        words = Words(data, offsets, letters_only=True)
        doc = words.doc_of()
        rows, found = [], []
        for size, (at, h) in zip(STEMS, words.prefix_hashes(STEMS), strict=True):
            rows.append(doc[at])
            found.append(h ^ np.uint64(size))
        yield row, end, np.concatenate(rows), np.concatenate(found)


@dataclass
class Chain:
    """Sorted feature hashes and, per category, weights: features, earlier probabilities, intercept."""

    hashes: np.ndarray
    weights: list[np.ndarray]
    names: tuple[str, ...] = tuple(name for name, *_ in CATEGORIES)

    def __post_init__(self):
        self.mask = np.zeros(1 << 20, bool)
        self.mask[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature index) pairs among the chain's features."""
        near = self.mask[(found & np.uint64((1 << 20) - 1)).astype(np.int64)]
        rows, found = rows[near], found[near]
        at = np.searchsorted(self.hashes, found)
        at[at == len(self.hashes)] = 0
        right = self.hashes[at] == found if len(self.hashes) else np.zeros(0, bool)
        pairs = np.unique(rows[right].astype(np.int64) * max(1, len(self.hashes)) + at[right])
        return pairs // max(1, len(self.hashes)), pairs % max(1, len(self.hashes))

    def predict(self, n: int, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probabilities of the categories for n rows."""
        out = np.zeros((n, len(self.weights)))
        for j, w in enumerate(self.weights):
            z = np.bincount(rows, w[at], minlength=n) + out[:, :j] @ w[len(self.hashes) : -1] + w[-1]
            out[:, j] = sigmoid(z)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: np.ndarray, at: np.ndarray, size: int, dense: np.ndarray, y: np.ndarray, steps: int = 120) -> np.ndarray:
    """Logistic regression, L2-penalised, on binary sparse features plus dense ones and an intercept.

    Accelerated descent under a diagonal bound of the Hessian.
    """
    n, extra = len(y), np.column_stack([dense, np.ones(len(y))])
    if not n or y.min() == y.max():  # nothing to learn but the rate
        w = np.zeros(size + extra.shape[1])
        w[-1] = 0.0 if not n else (6.0 if y[0] else -6.0)
        return w
    per_row = np.bincount(rows, minlength=n) + extra.sum(1)
    bound = 0.25 * np.concatenate([np.bincount(at, per_row[rows], minlength=size), (np.abs(extra) * per_row[:, None]).sum(0)]) + 1.0
    w = seen = np.zeros(size + extra.shape[1])
    for k in range(steps):
        z = np.bincount(rows, seen[at], minlength=n) + extra @ seen[size:]
        r = sigmoid(z) - y
        g = np.concatenate([np.bincount(at, r[rows], minlength=size), extra.T @ r]) + 0.1 * seen
        g[-1] -= 0.1 * seen[-1]
        new = seen - g / bound
        seen = new + (k / (k + 3)) * (new - w)
        w = new
    return w


def sampled(documents: DataFrame, labels: DataFrame, sample: int, categories: tuple, text: str, key: str) -> DataFrame:
    """(doc_id, fold, one flag for each category, text) of at most ``sample`` labelled documents."""
    names = [c for _, c, _ in categories]
    every = " AND ".join(f"{c} IS NOT NULL" for c in ["doc_id", *names])
    marks = labels.select(F.col(key).cast("long").alias("doc_id"), *names).where(every).groupBy("doc_id").agg(*(F.max(c).alias(c) for c in names))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    marks = marks.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), *((F.col(c) == yes).cast("long").alias(f"y{j}") for j, (_, c, yes) in enumerate(categories)))
    # at most ``sample`` rows of a few numbers; of documents that share an id, the one of smallest hash
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(marks), "doc_id")
    flags = [f"y{j}" for j in range(len(categories))]
    rows = rows.groupBy("doc_id", "fold", *flags).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    return rows.select("doc_id", "fold", *flags, "one.text")


def association(n, k, rows: float, positive: float):
    """Chi-square of features that are in n of ``rows`` documents, k of them among the ``positive`` ones."""
    other = positive - k
    num = k * (rows - n - other) - (n - k) * other
    return num * num / F.greatest(F.lit(1.0), n * (rows - n) * F.lit(float(positive * (rows - positive))))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, categories: tuple = CATEGORIES, text: str = "text", key: str = "doc_id", space: Workspace | None = None) -> Chain:
    """Fit the chain on at most ``sample`` labelled documents.

    Rows with a null label or id are not used; of rows labelled several times
    the largest labels count; of documents that share an id one is used.
    Without labelled rows every probability is 0.5. The sample bounds what
    reaches the driver: the features of its documents among those chosen.
    """
    space = space or Workspace(documents.sparkSession)
    rows = space.table(sampled(documents, labels, sample, categories, text, key), "toxicity-sample")
    flags = [f"y{j}" for j in range(len(categories))]
    every = range(FOLDS)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column("fold").to_numpy()
            marks = [batch.column(c).to_numpy() for c in flags]
            for row, end, doc, found in features(batch.column("text")):
                order = np.lexsort((doc, found))
                doc, found = doc[order], found[order]
                first = np.ones(len(found), bool)
                first[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
                doc, found = doc[first], found[first]
                keys, start = np.unique(found, return_index=True)
                if not len(keys):
                    continue
                own = fold[row:end][doc]
                sums = [np.add.reduceat((own == k) * m, start) for m in [np.ones(len(doc), np.int64), *(x[row:end][doc] for x in marks)] for k in every]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, sums)], ["h", *columns])

    columns = [f"{c}_{k}" for c in ("n", *flags) for k in every]
    stats = rows.select("fold", *flags, "text").mapInArrow(spread, "h long, " + ", ".join(f"{c} long" for c in columns)).groupBy("h").agg(*(F.sum(c).alias(c) for c in columns))
    stats = space.table(stats.where(sum(F.col(f"n_{k}") for k in every) >= LEAST_ROWS), "toxicity-features")
    totals = {r.fold: r for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in flags)).collect()}
    chosen = []
    for held in (None, *every):
        folds = [k for k in every if k != held]
        total = lambda c: float(sum(totals[k][c] for k in folds if k in totals))  # noqa: E731, B023
        part = lambda c: sum(F.col(f"{c}_{k}") for k in folds)  # noqa: E731, B023
        scores = [association(part("n"), part(c), total("n"), total(c)) for c in flags]
        best = stats.where(part("n") >= LEAST_ROWS).orderBy(F.desc(F.greatest(*scores, F.lit(0.0))), "h").limit(FEATURES).select("h").toPandas()
        chosen.append(np.sort(best["h"].to_numpy(np.int64).view(np.uint64)))
    wide = Chain(np.unique(np.concatenate(chosen)), [])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [np.empty(0, np.int64)] * batch.num_rows
            for row, end, doc, h in features(batch.column("text")):
                at_row, at = wide.hits(doc, h)
                for k, part in enumerate(np.split(at, np.searchsorted(at_row, np.arange(1, end - row)))):
                    hit[row + k] = part
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "fold", *flags)), pa.array(hit, pa.list_(pa.int32()))], ["doc_id", "fold", *flags, "hits"])

    schema = "doc_id long, fold int, " + "".join(f"{c} long, " for c in flags) + "hits array<int>"
    data = rows.mapInArrow(found, schema).toPandas().sort_values("doc_id")
    space.drop(rows, stats)
    n, fold = len(data), data["fold"].to_numpy(np.int64)
    at = np.concatenate([np.asarray(x, np.int64) for x in data["hits"]]) if n else np.empty(0, np.int64)
    doc = np.repeat(np.arange(n), [len(x) for x in data["hits"]]) if n else np.empty(0, np.int64)

    def own(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) pairs of the sample among these features."""
        number = np.full(len(wide.hashes), -1)
        number[np.searchsorted(wide.hashes, hashes)] = np.arange(len(hashes))
        use = number[at] >= 0
        return doc[use], number[at[use]]

    whole, *others = (own(h) for h in chosen)
    chain, earlier = Chain(chosen[0], [], tuple(name for name, *_ in categories)), np.zeros((n, 0))
    for flag in flags:
        y = data[flag].to_numpy(float)
        chain.weights.append(fit(*whole, len(chosen[0]), earlier, y) if n else np.zeros(len(chosen[0]) + earlier.shape[1] + 1))
        held = np.zeros(n)
        for k in every:
            inside, new = fold != k, np.cumsum(fold != k) - 1
            d, a = others[k]
            use, size = inside[d], len(chosen[k + 1])
            w = fit(new[d[use]], a[use], size, earlier[inside], y[inside])
            z = np.bincount(d, w[a], minlength=n) + earlier @ w[size:-1] + w[-1]
            held[~inside] = sigmoid(z)[~inside]
        earlier = np.column_stack([earlier, held])
    return chain


def _predicted(df: DataFrame, chain: Chain, column: str, schema, out) -> DataFrame:
    """Map ``df`` by ``out(batch, probabilities of the categories)``; ``column`` has the texts."""
    model = df.sparkSession.sparkContext.broadcast((chain.hashes, chain.weights, chain.names))
    at = df.columns.index(column)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(*model.value)
        for batch in batches:
            parts = [own.predict(end - row, *own.hits(doc, h)) for row, end, doc, h in features(batch.column(at))]
            yield out(batch, np.concatenate(parts) if parts else np.zeros((0, len(own.weights))))

    return df.mapInArrow(predict, schema)


def score(df: DataFrame, chain: Chain, text: str = "text", key: str = "doc_id", reject: str = "toxic") -> DataFrame:
    """Per row: doc_id, p_<category> of each category, and whether it is rejected (``reject`` at 0.5 or more).

    Null and empty texts have no features, so only the intercepts speak; other
    columns are ignored; repeated rows score alike.
    """
    names, at = [f"p_{name}" for name in chain.names], chain.names.index(reject)
    # without labels every probability is 0.5, which rejects nothing
    known = any(w.any() for w in chain.weights)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = lambda batch, p: pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, j]) for j in range(len(names))), pa.array((p[:, at] >= 0.5) & known)], ["doc_id", *names, "rejected"])
    return _predicted(rows, chain, "text", "doc_id long, " + "".join(f"{c} double, " for c in names) + "rejected boolean", out)


def clean(df: DataFrame, chain: Chain, text: str = "text", reject: str = "toxic") -> DataFrame:
    """The rows of ``df`` that the chain doesn't reject, with all their columns."""
    at = chain.names.index(reject)
    known = any(w.any() for w in chain.weights)
    return _predicted(df, chain, text, df.schema, lambda batch, p: batch.filter(pa.array(~((p[:, at] >= 0.5) & known))))
