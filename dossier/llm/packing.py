"""Packing by concatenate and cut.

First pass: documents become token ids, written once to the shared folder with
the partition they were written by and their offset within it. Second pass: a
prefix sum over the partitions' token totals turns those offsets into global
ones, and each document is cut where fixed windows end. A document crossing a
window's end leaves a boundary record in either window; no window is gathered
anywhere, so neither long documents nor hot keys matter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.workdir import Workspace

WINDOW = 2048
END_ID = 1

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Little-endian ids of texts, exactly as the tokenizer gives them.

    Where the tokenizer is byte-level BPE with merges in the order of their
    ids, texts of Latin letters, common punctuation and plain white space are
    merged by those ids, which gives the same result faster: on other
    characters two libraries could differ in what is a letter or a space.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.type = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = by_ranks(self.tokenizer)

    def encode(self, text: str) -> np.ndarray:
        if self.ranks and not _UNSURE.search(text) and not any(s in text for s in self.specials):
            return self.ranks.encode_to_numpy(text, disallowed_special=()).astype(self.type)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.type)


_UNSURE = re.compile("[^ -~\n\t\r\xa1-\u024f\u2010-\u2027\u2030-\u205e]")


def by_ranks(tokenizer):
    """The merges of a byte-level BPE tokenizer without options, as ranks; None for any other."""
    import public_tokenizers
    import tiktoken

    about = json.loads(tokenizer.to_str())
    model, split = about["model"], about["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not about["normalizer"] and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
        return None
    # each byte's stand-in: printable Latin-1 characters as themselves, the others from U+0100 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    added = {t["content"] for t in about["added_tokens"]}
    ranks = {bytes(letter[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"]["".join(m)] for m in merges]
    if sorted(ids) != ids or len(ranks) != 256 + len(ids):
        return None
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_workers: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def tokenised(df: DataFrame, tokenizer_path: str, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(part, before, n, doc_id, ids): each row's ids with the end id, and the tokens before it in its partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=encoder.type).tobytes()
        width = len(end)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                rows = batch.slice(first, 256)
                ids = [encoder.encode(t).tobytes() + end if t else end for t in rows.column(1).to_pylist()]
                sizes = np.array([len(i) // width for i in ids], dtype=np.int64)
                at = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(at), pa.array(sizes), rows.column(0), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), width, np.int32))], ["part", "before", "n", "doc_id", "ids", "width"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, "part int, before long, n long, doc_id long, ids binary, width int")


def pack(df: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, text: str = "text", key: str = "doc_id", space: Workspace | None = None) -> DataFrame:
    """Pieces of documents in sequences of ``window`` tokens; only the last sequence can be shorter.

    One row per piece, with its ids as little-endian unsigned 32-bit integers.
    Null and empty texts are one end id; repeated rows are packed each on its
    own; an empty table gives no pieces; other columns are ignored.
    """
    spark = df.sparkSession
    space = space or Workspace(spark)
    table = space.table(tokenised(df, tokenizer_path, end_id, text, key), "packing-ids")
    # one row per partition of the first pass
    totals = sorted((r.part, r.n) for r in table.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts = dict(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0), strict=False))
    base = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows = batch.slice(first, 512)
                if not rows.num_rows:
                    continue
                at = np.array([base.value[p] for p in rows.column("part").to_pylist()], dtype=np.int64) + rows.column("before").to_numpy()
                n = rows.column("n").to_numpy()
                pieces = (at + n - 1) // window - at // window + 1
                doc = np.repeat(np.arange(len(n)), pieces)
                sequence = at[doc] // window + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = np.maximum(sequence * window, at[doc])
                stop = np.minimum((sequence + 1) * window, at[doc] + n[doc])
                widths, ids = rows.column("width").to_numpy(), rows.column("ids")
                out = []
                for d, b, e in zip(doc, begin - at[doc], stop - at[doc], strict=True):
                    w = int(widths[d])
                    out.append(np.frombuffer(ids[int(d)].as_buffer(), dtype=f"<u{w}", count=int(e - b), offset=int(b) * w).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(doc)), pa.array(begin - at[doc]), pa.array(stop - begin), pa.array(out, pa.binary()), pa.array(n[doc]), pa.array(sequence), pa.array(begin - sequence * window)],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return table.mapInArrow(cut, PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
