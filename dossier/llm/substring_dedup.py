"""Substring dedup by factors against indexed blocks, in place of a left-to-right relative Lempel-Ziv parse.

A parse of each document against each reference block in turn costs documents
times blocks. Here the corpus is cut alike everywhere instead: a 20-word window
belongs to the seed of smallest hash among its 8-word runs, and a factor is a
stretch of windows that share one seed, with the words of these windows. A
copied window has its copy's seed, so a factor has to visit one block only:
the one its seed is dealt to. A block holds the distinct factors of its seeds
in order of where they start first, with their words, indexed by seed. There a
factor whose words stand in the block from earlier is a copy as a whole; at
the boundaries of copied passages, where factors differ, it is matched window
by window. Words are compared, not hashes. Adjacent copied windows merge into
the longest spans.

Texts are written once, in chunks of whole documents, as a table bucketed by
chunk. What blocks decide is sent back to the chunks, so texts are never
shuffled; factors are, if another factor has their seed. Copies are reduced
within a chunk and then by a partial aggregate, so a hot passage doesn't gather
anywhere. A seed that stands in more than HOT different factors has its windows
dealt out by their words instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.arrowtext import U, Words, ngram_hashes, slices
from dossier.llm.workdir import Workspace

WINDOW, SEED = 20, 8
#: Text of a chunk, for each bucket of seeds, and for each block of factors, in bytes.
CHUNK, BUCKET, BLOCK = 2 << 20, 24 << 20, 6 << 20
#: Different factors of a seed in a block at most.
HOT = 20_000
#: Marks an entry that stands for several factors of its chunk.
SEVERAL = 0xFFFFFFFF


def window_seeds(seeds: np.ndarray, span: int) -> np.ndarray:
    """For each window, the position of its smallest seed, the first of equals."""
    n = len(seeds) - span + 1
    width, at = 1, np.arange(len(seeds))
    # doubling: the minimum of a run of 2 * width from those of its halves
    while width * 2 <= span:
        left, right = at[: len(at) - width], at[width:]
        at = np.where(seeds[right] < seeds[left], right, left)
        width *= 2
    left, right = at[:n], at[span - width : span - width + n]
    return np.where(seeds[right] < seeds[left], right, left)


def parse(words: np.ndarray, doc: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of a run of texts, given by word hashes and each word's text: (first window, number of windows, seed hash)."""
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U)
    seeds = ngram_hashes(words, seed, salt=31)
    at = window_seeds(seeds, window - seed + 1)
    inside = doc[: len(at)] == doc[window - 1 :]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    ends = np.append(np.flatnonzero(new | ~inside), len(at))
    size = ends[np.searchsorted(ends, first, side="right")] - first
    return first, size, seeds[at[first]]


def chunks_of(docs: DataFrame, most: int = CHUNK) -> DataFrame:
    """(chunk, ids, ends, text): runs of whole texts of about ``most`` bytes end to end, null texts as empty ones."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, end, data, offsets in slices(batch.column(1), most):
                yield _row([(part << 32) + number, ids[row:end].astype("<i8"), offsets[1:].astype("<i8"), data], _CHUNK)
                number += 1

    return docs.mapInArrow(cut, "chunk long, ids binary, ends binary, text binary")


_CHUNK = ["chunk", "ids", "ends", "text"]


def _row(values: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v if isinstance(v, int) else v.tobytes()]) for v in values], names)


class Chunk:
    """A chunk's texts, words and factors."""

    def __init__(self, batch: pa.RecordBatch, k: int, window: int, seed: int):
        get = lambda c, t: np.frombuffer(batch.column(c)[k].as_buffer(), t)
        self.window = window
        self.number, self.ids = batch.column("chunk")[k].as_py(), get("ids", "<i8")
        self.ends, self.data = np.concatenate([[0], get("ends", "<i8")]), get("text", np.uint8)
        self.words = Words(self.data, self.ends)
        self.doc = self.words.doc_of()
        self.first, self.size, self.seeds = parse(self.words.hashes(), self.doc, window, seed)

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """(rank of each text by id and content, hash of each text): rows that share an id come in the order of their contents."""
        raw = self.data.data
        ties = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True)], U).view(np.int64)
        rank = np.empty(len(self.ids), np.int64)
        rank[np.lexsort((ties, self.ids))] = np.arange(len(self.ids))
        return rank, ties

    def distinct(self, shared: np.ndarray, rank: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Of the factors marked in ``shared``: texts of the distinct ones, the factor each first is, and for all (factor, number of its text).

        Numbers are given in order of place, so they are the same each time.
        """
        use = np.flatnonzero(shared)
        use = use[np.lexsort((self.first[use], rank[self.doc[self.first[use]]]))]
        joined, at = self.words.joined()
        raw = joined.tobytes()
        known: dict[bytes, int] = {}
        heads, number = [], np.empty(len(use), np.int64)
        for i, (k, a, b) in enumerate(zip(use.tolist(), at[self.first[use]].tolist(), at[self.first[use] + self.size[use] + self.window - 1].tolist(), strict=True)):
            n = known.setdefault(raw[a : b - 1], len(known))
            number[i] = n
            if n == len(heads):
                heads.append(k)
        return list(known), np.array(heads, np.int64), use, number


def shared_seeds(chunks: DataFrame, blocks: int, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(chunk, bits): which of a chunk's factors have a seed that another factor has.

    Seeds travel as 32 bits in blocks to hash buckets, which answer with the
    places of those they see twice; a seed that repeats within a chunk is sent
    once. Equal bits of different seeds only open a factor for nothing.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = Chunk(batch, k, window, seed)
                seeds = chunk.seeds
                if not len(seeds):
                    continue
                order = np.argsort(seeds, kind="stable")
                new = np.ones(len(seeds), bool)
                new[1:] = seeds[order][1:] != seeds[order][:-1]
                head = np.flatnonzero(new)
                times = np.diff(np.append(head, len(seeds)))
                known = np.zeros(len(seeds), bool)
                known[order[np.repeat(times > 1, times)]] = True
                h, at = seeds[order[head]], np.where(times > 1, SEVERAL, order[head]).astype("<u4")
                block = (h % U(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                cuts = np.searchsorted(block[order], np.arange(blocks + 1))
                h, at = (h // U(blocks)).astype("<u4")[order], at[order]
                used = np.flatnonzero(np.diff(cuts))
                part = lambda x: [None, *(x[cuts[b] : cuts[b + 1]].tobytes() for b in used)]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used) + 1, chunk.number)), pa.array(np.append(-1, used).astype(np.int32)), pa.array(part(h), pa.binary()), pa.array(part(at), pa.binary()), pa.array([np.packbits(known).tobytes()] + [None] * len(used), pa.binary())],
                    ["chunk", "block", "h", "at", "bits"],
                )

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        passed, pdf = pdf[pdf["block"] < 0], pdf[pdf["block"] >= 0]
        out = [passed[["chunk", "at", "bits"]]] if len(passed) else []
        if len(pdf):
            h = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["h"]])
            order = np.argsort(h, kind="stable")
            twice = h[order][1:] == h[order][:-1]
            shared = np.zeros(len(h), bool)
            shared[order[1:][twice]] = True
            shared[order[:-1][twice]] = True
            replies, at = [], 0
            for x in pdf["at"]:
                x = np.frombuffer(x, "<u4")
                hit = x[shared[at : at + len(x)]]
                replies.append(hit[hit != SEVERAL].tobytes())
                at += len(x)
            out.append(pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "at": replies, "bits": None}))
        return pd.concat(out)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf["bits"].notna()
        bits = np.unpackbits(np.frombuffer(pdf["bits"][known].iloc[0], np.uint8)).astype(bool)
        for reply in pdf["at"][~known]:
            bits[np.frombuffer(reply, "<u4")] = True
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "bits": [np.packbits(bits).tobytes()]})

    asked = chunks.mapInArrow(ask, "chunk long, block int, h binary, at binary, bits binary")
    dealt = F.when(F.col("block") < 0, F.pmod(F.xxhash64("chunk"), F.lit(blocks)).cast("int")).otherwise(F.col("block"))
    answered = asked.withColumn("place", dealt).groupBy("place").applyInPandas(answer, "chunk long, at binary, bits binary")
    return answered.groupBy("chunk").applyInPandas(decide, "chunk long, bits binary")


def _shared(batch: pa.RecordBatch, k: int, chunk: Chunk) -> np.ndarray:
    bits = batch.column("bits")[k].as_py()
    return np.zeros(len(chunk.first), bool) if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8), count=len(chunk.first)).astype(bool)


def factors(chunks: DataFrame, blocks: int, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(block, seed, chunk, n, windows, doc_id, tie, row, start, words) of each chunk's distinct factors that share a seed, at their first place."""
    names = ["block", "seed", "chunk", "n", "windows", "doc_id", "tie", "row", "start", "words"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = Chunk(batch, k, window, seed)
                rank, ties = chunk.order()
                texts, heads, _, _ = chunk.distinct(_shared(batch, k, chunk), rank)
                first, seeds = chunk.first[heads], chunk.seeds[heads]
                doc = chunk.doc[first] if len(heads) else np.zeros(0, np.int64)
                columns = [((seeds >> U(7)) % U(blocks)).astype(np.int32), seeds.view(np.int64), np.full(len(heads), chunk.number), np.arange(len(heads)), chunk.size[heads].astype(np.int32), chunk.ids[doc], ties[doc], doc.astype(np.int64), first - chunk.words.bounds[doc]]
                rows = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(texts, pa.binary())], names)
                for at in range(0, rows.num_rows, 20_000):
                    yield rows.slice(at, 20_000)

    return chunks.mapInArrow(cut, "block int, seed long, chunk long, n long, windows int, doc_id long, tie long, row long, start long, words binary")


PLACE = ("doc_id", "tie", "chunk", "row", "start")


def firsts(found: DataFrame) -> DataFrame:
    """Each distinct factor at its first place."""
    first = F.min(F.struct(*PLACE, "n", "windows")).alias("first")
    return found.groupBy("block", "seed", "words").agg(first).select("block", "seed", "words", "first.*")


def _edges(text: bytes) -> list[int]:
    """Where the words of a factor begin, and one past its end."""
    edges = [0]
    while (at := text.find(b" ", edges[-1])) >= 0:
        edges.append(at + 1)
    return [*edges, len(text) + 1]


def matched(distinct: DataFrame, window: int = WINDOW) -> DataFrame:
    """(chunk, n, mask) of distinct factors: which of their windows also start earlier, as bits from the lowest."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seed", *PLACE], ignore_index=True)
        seeds, words, size = pdf["seed"].to_numpy(), pdf["words"].tolist(), pdf["windows"].tolist()
        masks = [0] * len(pdf)
        cuts = np.concatenate([[0], np.flatnonzero(seeds[1:] != seeds[:-1]) + 1, [len(pdf)]]).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a == 1:
                continue
            index: set[bytes] = set()  # windows of the seed so far
            for k in range(a, b):
                text, edges = words[k], _edges(words[k])
                for j in range(size[k]):
                    part = text[edges[j] : edges[j + window] - 1]
                    if part in index:
                        masks[k] |= 1 << j
                    else:
                        index.add(part)
        return pdf[["chunk", "n"]].assign(mask=masks)

    return distinct.groupBy("block").applyInPandas(match, "chunk long, n long, mask long")


def matched_by_window(distinct: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``matched`` where no window is left out of ``mask`` alone, by an aggregate over windows."""
    names = [*PLACE, "n", "windows", "j", "words"]

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size = batch.column("words").to_pylist(), batch.column("windows").to_numpy()
            edges = [_edges(t) for t in texts]
            row = np.repeat(np.arange(len(size)), size)
            j = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            parts = [texts[r][edges[r][i] : edges[r][i + window] - 1] for r, i in zip(row.tolist(), j.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in names[:-2]), pa.array(j), pa.array(parts, pa.binary())], names)

    opened = distinct.withColumn("windows", F.col("windows").cast("int")).select(*names[:-2], "words").mapInArrow(open_, "doc_id long, tie long, chunk long, row long, start long, n long, windows int, j long, words binary")
    first = opened.groupBy("words").agg(F.min(F.struct(*PLACE, "j", "n", "windows")).alias("first")).select("first.*")
    own = first.groupBy("chunk", "n", "windows").agg(F.sum(F.expr("shiftleft(1L, CAST(j AS INT))")).alias("own"))
    return own.select("chunk", "n", (F.expr("shiftleft(1L, windows)") - 1 - F.col("own")).alias("mask"))


def dedup_substrings(df: DataFrame, window: int = WINDOW, seed: int = SEED, text: str = "text", key: str = "doc_id", space: Workspace | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, spans, kept.

    A word goes when a window of ``window`` words (``seed`` to ``seed`` + 60)
    covering it also starts earlier: in a smaller id, or before it in the same
    text. ``spans`` lists the removed (start, end) word ranges; ``kept`` joins
    what stays by single spaces. Null and empty texts have no words. Rows that
    share an id are texts of their own, in an order given by their contents.
    Other columns are ignored.
    """
    space = space or Workspace(df.sparkSession)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    # as many buckets as chunks, about: each file of the table holds one or a few
    chunks = space.table(chunks_of(docs), "substring-chunks", buckets=max(8, min(100_000, size // (2 * CHUNK))), by="chunk")
    bits = space.table(shared_seeds(chunks, max(8, size // BUCKET), window, seed), "substring-bits")
    distinct = space.table(firsts(factors(chunks.join(bits, "chunk"), max(32, size // BLOCK), window, seed)), "substring-factors")
    hot = space.table(distinct.groupBy("seed").agg(F.count(F.lit(1)).alias("factors")).where(F.col("factors") > HOT).select("seed"), "substring-hot")
    masks = matched(distinct.join(hot, "seed", "left_anti"), window)
    if not hot.isEmpty():
        masks = masks.union(matched_by_window(distinct.join(hot, "seed"), window))
    # what isn't answered is a copy as a whole
    masks = space.table(masks, "substring-masks")
    space.drop(distinct, hot)
    replies = masks.groupBy("chunk").agg(F.collect_list(F.struct("n", "mask")).alias("replies"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>, kept string"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _kept(Chunk(batch, k, window, seed), batch, k)

    return chunks.join(bits, "chunk", "left").join(replies, "chunk", "left").mapInArrow(remove, schema)


def _kept(chunk: Chunk, batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk without their copied words."""
    words, shared = chunk.words, _shared(batch, k, chunk)
    delta = np.zeros(len(words) + 1, np.int64)
    if shared.any():
        texts, heads, use, number = chunk.distinct(shared, chunk.order()[0])
        masks = (np.int64(1) << chunk.size[heads]) - 1  # for all but the first of its kind
        own = masks.copy()
        if (replies := batch.column("replies")[k]).is_valid:
            own[replies.values.field("n").to_numpy()] = replies.values.field("mask").to_numpy()
        mask = np.where(use == heads[number], own[number], masks[number])
        for j in range(int(chunk.size[use].max())):
            hit = chunk.first[use[(mask >> j) & 1 == 1]] + j
            np.add.at(delta, hit, 1)
            np.add.at(delta, hit + chunk.window, -1)
    gone = np.cumsum(delta[:-1]) > 0
    joined, at = words.joined()
    stay = joined[np.repeat(~gone, np.diff(at))].tobytes()
    bounds = np.concatenate([[0], np.cumsum(np.where(gone, 0, np.diff(at)))])[words.bounds].tolist()
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    # runs of removed words; those of adjacent texts are cut apart
    cut = words.bounds[1:-1][gone[words.bounds[1:-1] - 1] & gone[np.minimum(words.bounds[1:-1], len(words) - 1)] & (words.bounds[1:-1] > 0) & (words.bounds[1:-1] < len(words))] if len(words) else np.zeros(0, np.int64)
    starts = np.unique(np.concatenate([np.flatnonzero(edge == 1), cut]))
    ends = np.unique(np.concatenate([np.flatnonzero(edge == -1), cut]))
    rows = np.searchsorted(words.bounds, starts, side="right") - 1
    spans: list[list[list[int]]] = [[] for _ in chunk.ids]
    for r, a, b, o in zip(rows.tolist(), starts.tolist(), ends.tolist(), words.bounds[rows].tolist(), strict=True):
        spans[r].append([a - o, b - o])
    removed = np.concatenate([[0], np.cumsum(gone)])[words.bounds]
    counts, lost = words.counts(), np.diff(removed)
    for row in range(0, len(chunk.ids), 1000):
        here = slice(row, row + 1000)
        texts = [stay[a : b - 1] if b > a else b"" for a, b in zip(bounds[:-1][here], bounds[1:][here], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk.ids[here]), pa.array(counts[here]), pa.array(lost[here]), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(spans[here], pa.list_(pa.list_(pa.int64()))), pa.array(texts, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"],
        )
