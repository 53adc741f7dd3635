"""N-gram Jaccard join in metric space.

Documents are sets of 5-word shingles; Jaccard distance is a metric, and two
documents link at a distance of at most RADIUS = 0.2. Nearly all documents are
at distance 1 from any pivot, where the triangle inequality prunes nothing, so
the join narrows down first, without losing a link:

1. Equal sets become one class, of which the smallest id stands for all.
2. A document that has more than a fifth of its shingles to itself links with
   nothing. Which shingles are shared is found out by hash buckets, first on a
   consistent half of all shingles, then wholly for what remains.
3. Two linked documents share one of their rarest floor(n / 5) + 1 shingles.
   Documents connected by such shingles form the top regions.

In each region pivots create Voronoi cells: a document goes to the cell of its
nearest pivot and is linked to the pivots within the radius. Members of one
component of the region stop asking: all others still ask them; d(x, y) <= r
lets x visit the cell of q only if d(x, q) <= d(x, p) + 2 r for its nearest
pivot p, and d(x, q) <= r + the cell's radius. Cells are joined recursively,
with new pivots, until LEAF documents are left or a cell doesn't shrink; those
are compared directly. Components count the links of all levels, and where some
members ask no more, only their own component may stop. A document that only
visits a cell stops once all members are in its component.

The recursion runs inside one task for a region whose sets fit there; a larger
region is first split by the same rules over many tasks, with pivots in
proportion to its size, until its cells fit. All of it is exact, and dense
groups of near copies aren't expanded into pairs: links come as forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.arrowtext import U, Words, mix, ngram_hashes, pair_hash, slices
from dossier.llm.components import connected_components, forest
from dossier.llm.workdir import Workspace

SHINGLE = 5
#: Links: DEN * |intersection| >= NUM * |union|.
NUM, DEN = 80, 100
RADIUS = 1 - NUM / DEN
#: Text that is looked up in the buckets at once, and text for each bucket, in bytes.
CHUNK, BUCKET = 8 << 20, 12 << 20
#: Rows of a chunk at most: they are numbered in 16 bits.
CHUNK_ROWS = 60_000
#: Bytes of sets, and documents, of a region that one task holds; documents on either side of a block that is compared directly.
FIT, MOST, BLOCK = 16 << 20, 4096, 1024
#: Documents of a cell that are compared directly, for each pivot in a task, and the most pivots there and of a split over tasks.
LEAF, EACH, PIVOTS, WIDE = 48, 24, 32, 64
#: A cell of more than this share of its region doesn't shrink.
SHRINK = 0.9
#: Marks an entry that stands for several documents of its chunk, already counted there.
SEVERAL = 0xFFFF


def shingle_sets(words: Words, size: int = SHINGLE, twice: bool = False) -> tuple[np.ndarray, ...]:
    """(text index, shingle hash) of each distinct shingle, ordered by both; with ``twice`` also a second, independent hash."""
    count, own = words.counts(), words.doc_of()
    docs, found = [], []
    for seed in range(1 + twice):
        h = words.hashes(lower=True, seed=seed)
        whole = ngram_hashes(h, size, salt=17 * seed)
        doc = own[: len(whole)]
        inside = doc == own[size - 1 :] if len(whole) else np.zeros(0, bool)
        docs, hashes = [doc[inside]], [whole[inside]]
        for k in range(1, size):  # shorter texts are one shingle
            short = np.flatnonzero(count == k)
            if len(short):
                docs.append(short.astype(doc.dtype))
                part = ngram_hashes(h, k, salt=17 * seed)[words.bounds[short]]
                hashes.append(pair_hash(part, np.full(len(part), k, U), 11))
        found.append(np.concatenate(hashes))
    doc = np.concatenate(docs)
    order = np.lexsort((found[0], doc))
    doc, found = doc[order], [h[order] for h in found]
    new = np.ones(len(doc), bool)
    new[1:] = (found[0][1:] != found[0][:-1]) | (doc[1:] != doc[:-1])
    return doc[new], *(h[new] for h in found)


def chunks_of(batches: Iterator[pa.RecordBatch], most: int = CHUNK, rows: int = CHUNK_ROWS, twice: bool = False):
    """(ids, set sizes, shingle hashes by document) of runs of documents of about ``most`` bytes."""
    held: list[tuple[np.ndarray, ...]] = []
    size = count = 0
    for batch in batches:
        for row, end, data, offsets in slices(batch.column(1)):
            doc, *h = shingle_sets(Words(data, offsets), twice=twice)
            if held and (size + len(data) > most or count + end - row > rows):
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size, count = [], 0, 0
            for first in range(row, end, rows):
                last = min(end, first + rows)
                if first > row:
                    yield tuple(map(np.concatenate, zip(*held, strict=True)))
                    held, size, count = [], 0, 0
                here = (doc >= first - row) & (doc < last - row) if end - row > rows else slice(None)
                ids = batch.column(0).slice(first, last - first).to_numpy(zero_copy_only=False)
                held.append((ids, np.bincount(doc[here] - (first - row), minlength=last - first), *(x[here] for x in h)))
                count += last - first
            size += len(data)
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def set_keys(sizes: np.ndarray, *hashes: np.ndarray) -> list[np.ndarray]:
    """A 64-bit key of each set from each hash of its shingles."""
    at, keys = np.concatenate([[0], np.cumsum(sizes)]), []
    for h in hashes:
        sums = np.zeros(len(h) + 1, U)
        np.cumsum(mix(h * U(2) + U(0x5851F42D4C957F2D)), out=sums[1:])
        keys.append(mix(sums[at[1:]] - sums[at[:-1]] + sizes.astype(U)).view(np.int64))
    return keys


def survey(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, n, k1, k2, alive) of each document; alive: it may link with a different row."""
    share = U(1 << 63)  # a consistent half of all shingles

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, (ids, sizes, h, other) in enumerate(chunks_of(batches, twice=True)):
            chunk = (part << 32) + number
            k1, k2 = set_keys(sizes, h, other)
            doc = np.repeat(np.arange(len(ids)), sizes)
            use = h < share
            h, doc = h[use], doc[use]
            asked = np.bincount(doc, minlength=len(ids))
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order].astype(np.uint16)
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(h))) > 1
            known = np.bincount(doc[np.repeat(many, np.diff(np.append(first, len(h))))], minlength=len(ids))
            h, doc = h[first], np.where(many, SEVERAL, doc[first]).astype(np.uint16)
            info = np.stack([x.astype("<i8") for x in (ids, sizes, k1, k2, asked, known)]).tobytes()
            bucket = (h % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            h, doc = (h // U(buckets)).astype(np.uint32)[order], doc[order]
            used = np.flatnonzero(np.diff(cuts))
            part_of = lambda x: pa.array([None, *(x[cuts[b] : cuts[b + 1]].tobytes() for b in used)], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used) + 1, chunk)), pa.array(np.append(-1, used).astype(np.int32)), part_of(h), part_of(doc), pa.array([info] + [None] * len(used), pa.binary())], ["chunk", "bucket", "h", "doc", "info"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        passed = pdf[pdf["bucket"] < 0]
        pdf = pdf[pdf["bucket"] >= 0]
        h = [np.frombuffer(x, np.uint32) for x in pdf["h"]]
        own = [np.frombuffer(x, np.uint16) for x in pdf["doc"]]
        if not h:
            return passed[["chunk", "doc", "info"]]
        flat = np.concatenate(h)
        order = np.argsort(flat, kind="stable")
        same = flat[order]
        shared = np.zeros(len(flat), bool)
        twice = same[1:] == same[:-1]
        shared[order[1:][twice]] = True
        shared[order[:-1][twice]] = True
        replies, at = [], 0
        for x in own:
            hit = x[shared[at : at + len(x)]]
            replies.append(np.bincount(hit[hit != SEVERAL], minlength=1).astype("<u4").tobytes())
            at += len(x)
        out = pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "doc": replies, "info": None})
        return pd.concat([passed[["chunk", "doc", "info"]], out]) if len(passed) else out

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        info = np.frombuffer(pdf["info"].dropna().iloc[0], "<i8").reshape(6, -1)
        shared = info[5].copy()
        for reply in pdf["doc"][pdf["info"].isna()]:
            n = np.frombuffer(reply, "<u4")
            shared[: len(n)] += n
        alone = info[4] - shared
        # no link leaves more than (1 - NUM / DEN) of a set unshared
        alive = (info[1] > 0) & (DEN * alone <= (DEN - NUM) * info[1])
        return pd.DataFrame({"doc_id": info[0], "n": info[1], "k1": info[2], "k2": info[3], "alive": alive})

    asked = docs.mapInArrow(ask, "chunk long, bucket int, h binary, doc binary, info binary")
    # what only passes through is dealt out like the rest
    place = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("chunk"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    answered = asked.withColumn("place", place).groupBy("place").applyInPandas(lambda pdf: answer(pdf), "chunk long, doc binary, info binary")
    return answered.groupBy("chunk").applyInPandas(decide, "doc_id long, n long, k1 long, k2 long, alive boolean")


def set_chunks(docs: DataFrame) -> DataFrame:
    """(chunk, ids, sizes, sets): the documents of a chunk and their sets, end to end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, (ids, sizes, h) in enumerate(chunks_of(batches, CHUNK // 2)):
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), *(pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((ids, "<i8"), (sizes, "<i8"), (h, "<u8")))], ["chunk", "ids", "sizes", "sets"])

    return docs.mapInArrow(cut, "chunk long, ids binary, sizes binary, sets binary")


def rare_shingles(chunks: DataFrame, buckets: int) -> DataFrame:
    """(h, doc_id): each document's rarest floor(n / 5) + 1 shingles, those without other holders left out."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sets in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, n = np.unique(np.frombuffer(sets.as_buffer(), "<u8"), return_counts=True)
                bucket = (h % U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                h, n = h[order], n[order].astype(np.uint32)
                used = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), chunk)), pa.array(used.astype(np.int32)), pa.array([h[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary()), pa.array([n[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary())],
                    ["chunk", "bucket", "h", "n"],
                )

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        h = [np.frombuffer(x, "<u8") for x in pdf["h"]]
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["n"]]).astype(np.float64)
        _, inverse = np.unique(np.concatenate(h), return_inverse=True)
        total = np.bincount(inverse, n)[inverse]
        # a byte in steps of an eighth of a doubling: 0 for a single holder
        code = np.minimum(255, np.floor(8 * np.log2(total))).astype(np.uint8)
        return pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "codes": [x.tobytes() for x in np.split(code, np.cumsum([len(x) for x in h])[:-1])]})

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes, sets = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (("ids", "<i8"), ("sizes", "<i8"), ("sets", "<u8")))
                h = np.unique(sets)
                bucket = (h % U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                codes = np.empty(len(h), np.uint8)
                replies = sorted((r["bucket"], r["codes"]) for r in batch.column("replies")[k].as_py())
                codes[order] = np.frombuffer(b"".join(c for _, c in replies), np.uint8)
                code = codes[np.searchsorted(h, sets)]
                doc = np.repeat(np.arange(len(ids)), sizes)
                order = np.lexsort((sets, code, doc))
                rank = np.arange(len(sets)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                limit = (DEN - NUM) * sizes // DEN + 1
                use = (rank < limit[doc]) & (code[order] > 0)
                at = order[use]
                yield pa.RecordBatch.from_arrays([pa.array(sets[at].view(np.int64)), pa.array(ids[doc[at]])], ["h", "doc_id"])

    asked = chunks.select("chunk", "sets").mapInArrow(ask, "chunk long, bucket int, h binary, n binary")
    answered = asked.groupBy("bucket").applyInPandas(answer, "chunk long, bucket int, codes binary")
    replies = answered.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "codes")).alias("replies"))
    return chunks.join(replies, "chunk").mapInArrow(choose, "h long, doc_id long")


def intersections(a: list[np.ndarray], b: list[np.ndarray], rows: int = 1024, width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``, in blocks of rows and of shingles."""
    known, place = np.unique(np.concatenate(b), return_inverse=True)
    owner = np.repeat(np.arange(len(b)), [len(x) for x in b])
    total = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, len(a), rows):
        part = a[first : first + rows]
        flat, row = np.concatenate(part), np.repeat(np.arange(len(part), dtype=np.int32), [len(x) for x in part])
        at = np.searchsorted(known, flat)
        at[at == len(known)] = 0
        hit = known[at] == flat
        # only shingles that both sides have get a column
        used, column = np.unique(at[hit], return_inverse=True)
        row = row[hit]
        number = np.full(len(known), -1)
        number[used] = np.arange(len(used))
        there = number[place]
        other, there = owner[there >= 0], there[there >= 0]
        order, turn = np.argsort(column, kind="stable"), np.argsort(there, kind="stable")
        column, row, there, other = column[order], row[order], there[turn], other[turn]
        for start in range(0, len(used), width):
            lo, hi = np.searchsorted(column, (start, start + width))
            low, high = np.searchsorted(there, (start, start + width))
            x, y = np.zeros((len(part), width), np.float32), np.zeros((len(b), width), np.float32)
            x[row[lo:hi], column[lo:hi] - start] = 1
            y[other[low:high], there[low:high] - start] = 1
            total[first : first + rows] += x @ y.T
    return total


def close_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distances, linked) of all sets of ``a`` and all of ``b``."""
    both = intersections(a, b).astype(np.int64)
    union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b]) - both
    return 1 - both / np.maximum(union, 1), DEN * both >= NUM * union


class Region:
    """A region's documents in one task, joined by recursion into Voronoi cells."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray]):
        self.ids, self.sets, self.part = ids, sets, np.arange(len(ids))

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        node, least = forest(self.part[i], self.part[j])
        to = np.arange(len(self.ids))
        to[node] = least
        self.part = to[self.part]

    def compare(self, asks: np.ndarray, members: np.ndarray) -> None:
        """Link all pairs of these by blocks of direct comparisons."""
        for a in range(0, len(asks), BLOCK):
            for b in range(0, len(members), BLOCK):
                x, y = asks[a : a + BLOCK], members[b : b + BLOCK]
                _, near = close_pairs([self.sets[k] for k in x], [self.sets[k] for k in y])
                i, j = np.nonzero(near)
                self.unite(x[i], y[j])

    def join(self, rows: np.ndarray, asks: np.ndarray, member: np.ndarray, level: int = 0) -> None:
        """Link what asks in ``rows`` with the members there; ``asks`` and ``member`` are flags of ``rows``."""
        if not asks.any() or not member.any() or (self.part[rows] == self.part[rows[0]]).all():
            return
        if len(rows) <= LEAF:
            self.compare(rows[asks], rows[member])
            return
        inside = rows[member]
        draw = mix(self.ids[inside].view(U) * U(0x9E3779B97F4A7C15) + U(level))
        pivots = inside[np.argsort(draw, kind="stable")[: max(2, min(PIVOTS, len(inside) // EACH))]]
        d, near = close_pairs([self.sets[k] for k in rows], [self.sets[k] for k in pivots])
        i, j = np.nonzero(near)
        self.unite(rows[i], pivots[j])
        asks = asks & ~self.stops(rows, asks, member)
        own, least = d.argmin(1), d.min(1)
        for c in range(len(pivots)):
            stay = member & (own == c)
            if stay.any():
                visit = asks & (d[:, c] <= least + 2 * RADIUS + 1e-9) & (d[:, c] <= least[stay].max() + RADIUS + 1e-9)
                cell = stay | visit
                if cell.sum() > SHRINK * len(rows):
                    self.compare(rows[visit], rows[stay])
                else:
                    self.join(rows[cell], visit[cell], stay[cell], level + 1)

    def stops(self, rows: np.ndarray, asks: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Rows that need ask no more: of members one component, if the members that are quiet already lie in it."""
        part = self.part[rows]
        quiet = np.unique(part[member & ~asks])
        found, n = np.unique(part[member], return_counts=True)
        if len(quiet) > 1:
            return np.zeros(len(rows), bool)
        top = quiet[0] if len(quiet) else found[n.argmax()]
        # nobody asks a document that only visits: it stops when no other component is left to find
        return (part == top) & (member | (len(found) == 1))

    def links(self) -> pd.DataFrame:
        """(a, b): a forest of the links found."""
        other = self.part != np.arange(len(self.ids))
        return pd.DataFrame({"a": self.ids[other], "b": self.ids[self.part[other]]})


def join_regions(rows: DataFrame) -> DataFrame:
    """(a, b): forests of the links within regions that fit a task each; several share one."""
    held = rows.agg(F.sum(F.octet_length("set").cast("long"))).first()[0] or 0
    tasks = max(1, int(4 * held // FIT))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "b": []}).astype("int64")]
        for _, part in pdf.groupby("region"):
            region = Region(part["doc_id"].to_numpy(), [np.frombuffer(x, "<u8") for x in part["set"]])
            region.join(np.arange(len(part)), part["asks"].to_numpy(bool), part["member"].to_numpy(bool))
            out.append(region.links())
        return pd.concat(out)

    return rows.withColumn("task", F.pmod(F.xxhash64("region"), F.lit(tasks))).groupBy("task").applyInPandas(join, "a long, b long")


def join_blocks(rows: DataFrame) -> DataFrame:
    """(a, b): forests of the links between askers and members of each region, by blocks of both: for large regions that pivots don't split."""
    sizes = rows.groupBy("region").agg(F.ceil(F.sum(F.col("asks").cast("int")) / BLOCK).cast("int").alias("asking"), F.ceil(F.sum(F.col("member").cast("int")) / BLOCK).cast("int").alias("inside"))
    asks = rows.join(sizes.where("asking > 0 AND inside > 0"), "region")
    own = lambda c: F.pmod(F.xxhash64("doc_id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = asks.where("asks").select("region", "doc_id", "set", F.lit(True).alias("asks"), own("asking").alias("i"), every("inside").alias("j"))
    two = asks.where("member").select("region", "doc_id", "set", F.lit(False).alias("asks"), every("asking").alias("i"), own("inside").alias("j"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        region = Region(pdf["doc_id"].to_numpy(), [np.frombuffer(x, "<u8") for x in pdf["set"]])
        asks = pdf["asks"].to_numpy(bool)
        region.compare(np.flatnonzero(asks), np.flatnonzero(~asks))
        # rows are told apart here, documents in the links
        return region.links().query("a != b")

    return one.unionByName(two).groupBy("region", "i", "j").applyInPandas(join, "a long, b long")


def split_regions(rows: DataFrame, space: Workspace, level: int, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links to pivots, (node, component) by these and those of the levels ``before``, and the cells of the regions: rows as those of ``join_regions``.

    A pivot is the member of smallest hash in each slot of a region; slots are
    in proportion to its sets, two for each task they would fill, up to WIDE.
    """
    draw = F.xxhash64("doc_id", F.lit(level))
    room = rows.groupBy("region").agg(F.greatest(F.sum(F.octet_length("set").cast("long")) / FIT, F.count(F.lit(1)) / MOST).alias("tasks"))
    room = room.select("region", F.least(F.lit(WIDE), F.greatest(F.lit(8), F.ceil(2 * F.col("tasks")))).cast("int").alias("slots"))
    slot = F.pmod(draw, F.col("slots")).cast("int")
    pivots = rows.where("member").join(room, "region").groupBy("region", slot.alias("slot")).agg(F.min(F.struct(draw.alias("draw"), "doc_id")).alias("p")).select("region", F.col("p.doc_id").alias("doc_id"))
    pivots = space.table(rows.where("member").select("region", "doc_id", "set").join(pivots, ["region", "doc_id"]), "jaccard-pivots")
    salts = rows.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts"))
    salted = rows.join(salts, "region").withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.col("salts")).cast("int"))
    spread = pivots.join(salts, "region").select("region", "doc_id", "set", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def measure(docs: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(near):
            return pd.DataFrame({c: [] for c in ("region", "doc_id", "asks", "member", "pivots", "d")})
        d, _ = close_pairs(*([np.frombuffer(x, "<u8") for x in t["set"]] for t in (docs, near)))
        ids = near["doc_id"].to_numpy()
        return pd.DataFrame({"region": docs["region"].to_numpy(), "doc_id": docs["doc_id"].to_numpy(), "asks": docs["asks"].to_numpy(), "member": docs["member"].to_numpy(), "pivots": [ids] * len(docs), "d": list(d)})

    schema = "region long, doc_id long, asks boolean, member boolean, pivots array<long>, d array<double>"
    keyed = salted.select("region", "salt", "doc_id", "asks", "member", "set").groupBy("region", "salt")
    measured = space.table(keyed.cogroup(spread.groupBy("region", "salt")).applyInPandas(measure, schema), "jaccard-distances")
    pairs = F.arrays_zip("pivots", "d")
    # a link needs no rounding's help here: pairs at the very radius are found with the rest
    sure = measured.select(F.col("doc_id").alias("a"), F.explode(F.filter(pairs, lambda x: x.d <= RADIUS - 1e-9)).alias("x")).select("a", F.col("x.pivots").alias("b")).where("a <> b")
    sure = space.table(sure, "jaccard-pivot-links")
    edges = sure if before is None else sure.union(before.select("node", "component"))
    parts = space.table(connected_components(edges, space), "jaccard-parts")
    placed = measured.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id"))
    # what a member no longer asks, others must: so the component that stops is that of all members that don't ask, if there are any
    held = placed.where("member").groupBy("region", "part").agg(F.count(F.lit(1)).alias("n"), F.max(~F.col("asks")).alias("quiet"))
    most = held.groupBy("region").agg(F.max(F.struct("quiet", "n", "part")).alias("top"), F.count_if("quiet").alias("quiet"), F.count(F.lit(1)).alias("parts"))
    most = most.select("region", F.when(F.col("quiet") <= 1, F.col("top.part")).alias("top"), (F.col("parts") == 1).alias("single"))
    # nobody asks a document that only visits: it stops when no other component is left to find
    stops = F.coalesce(F.col("part") == F.col("top"), F.lit(False)) & (F.col("member") | F.col("single"))
    nearest = F.array_min("d")
    cell = F.get("pivots", (F.array_position("d", nearest) - 1).cast("int"))
    placed = placed.join(most, "region").select("region", "doc_id", "member", (F.col("asks") & ~stops).alias("asks"), cell.alias("cell"), nearest.alias("near"), pairs.alias("pairs"))
    placed = space.table(placed, "jaccard-cells")
    reach = placed.where("member").groupBy("region", "cell").agg(F.max("near").alias("reach"))
    name = F.xxhash64("region", "cell")
    stay = placed.where("member").select(name.alias("region"), "doc_id", F.lit(False).alias("asks"), F.lit(True).alias("member"))
    visit = placed.where("asks").select("region", "doc_id", F.explode(F.filter("pairs", lambda x: x.d <= F.col("near") + 2 * RADIUS + 1e-9)).alias("x")).select("region", "doc_id", F.col("x.pivots").alias("cell"), F.col("x.d").alias("d"))
    visit = visit.join(reach, ["region", "cell"]).where(F.col("d") <= F.col("reach") + RADIUS + 1e-9).select(name.alias("region"), "doc_id", F.lit(True).alias("asks"), F.lit(False).alias("member"))
    # a document that both stays and asks is one row
    cells = stay.unionByName(visit).groupBy("region", "doc_id").agg(F.max("asks").alias("asks"), F.max("member").alias("member"))
    above = placed.join(rows.groupBy("region").agg(F.max("above").alias("above")), "region").groupBy(name.alias("region")).agg(F.max("above").alias("above"))
    return sure, parts, cells.join(above, "region")


def components(df: DataFrame, text: str = "text", key: str = "doc_id", space: Workspace | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Documents link when 100 * |intersection| >= 80 * |union| of their sets of
    5-word shingles, A-Z folded; fewer words are one shingle. Null, empty and
    blank texts have no shingles and link with nothing. Rows that repeat an id
    each get a row. Other columns are ignored.
    """
    space = space or Workspace(df.sparkSession)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    known = space.table(survey(docs, max(8, size // BUCKET)), "jaccard-survey")
    classes = known.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    alive = known.where("alive").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    chunks = space.table(set_chunks(docs.join(alive, "doc_id").select("doc_id", "text")), "jaccard-sets")
    held = chunks.agg(F.sum(F.octet_length("sets").cast("long")).alias("n")).first().n or 0
    rare = space.table(rare_shingles(chunks, max(8, held // BUCKET)), "jaccard-rare")
    links = space.table(linked(rare, chunks, space), "jaccard-links")
    parts = connected_components(links, space).select(F.col("node").alias("rep"), "component")
    named = classes.join(parts, "rep", "left").select("n", "k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    return known.join(named, ["n", "k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def linked(rare: DataFrame, chunks: DataFrame, space: Workspace) -> DataFrame:
    """(a, b): links enough to give the components of all."""
    least = rare.groupBy("h").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("c")).where("b <> c").select("h", "b")
    regions = connected_components(rare.join(least, "h").select(F.col("doc_id").alias("a"), "b"), space)
    ids = regions.select(F.col("node").alias("doc_id"), F.col("component").alias("region"))

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own, sizes = (np.frombuffer(batch.column(c)[k].as_buffer(), "<i8") for c in (0, 1))
                raw, ends = batch.column(2)[k].as_py(), np.cumsum(sizes) * 8
                for first in range(0, len(own), 500):
                    here = range(first, min(first + 500, len(own)))
                    yield pa.RecordBatch.from_arrays([pa.array(own[first : first + 500]), pa.array([raw[ends[i] - sizes[i] * 8 : ends[i]] for i in here], pa.binary())], ["doc_id", "set"])

    sets = chunks.select("ids", "sizes", "sets").mapInArrow(apart, "doc_id long, set binary")
    sets = space.table(sets.join(ids, "doc_id"), "jaccard-region-sets")
    rows = sets.select("region", "doc_id", F.lit(True).alias("asks"), F.lit(True).alias("member"), "set", F.lit(None).cast("long").alias("above"))
    found, parts = [], None
    level = 0
    while True:
        sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("set").cast("long")).alias("held"), F.max("above").alias("above"))
        large = space.table(sizes.where((F.col("n") > MOST) | (F.col("held") > FIT)).select("region", "n", F.coalesce(F.col("n") > SHRINK * F.col("above"), F.lit(False)).alias("stuck")), "jaccard-large")
        if large.isEmpty():
            break
        found.append(space.table(join_regions(rows.join(large, "region", "left_anti")), "jaccard-found"))
        if not (stuck := large.where("stuck")).isEmpty():
            found.append(space.table(join_blocks(rows.join(stuck.select("region"), "region")), "jaccard-found"))
        rows = rows.drop("above").join(large.where("NOT stuck").select("region", F.col("n").alias("above")), "region")
        sure, parts, cells = split_regions(rows, space, level, parts)
        found.append(sure)
        rows = space.table(cells.join(sets.select("doc_id", "set"), "doc_id").select("region", "doc_id", "asks", "member", "set", "above"), "jaccard-level")
        level += 1
    found.append(join_regions(rows))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()
