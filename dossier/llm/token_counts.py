"""Token counts by map-side two-tier lookup.

A small table of frequent pre-token lengths is broadcast; every other
pre-token is encoded once per worker and kept in a bounded cache. No row of
the corpus is shuffled: each task counts the pre-tokens of all its texts in a
bounded table of heavy hitters, and only the heaviest of each are summed. The
table decides speed alone; every count comes from the tokenizer.

Pre-tokens: the model escapes a space as a word start and none of its pieces
holds a space or line feed after another character, so no merge crosses the
start of a space run or a line feed. Texts are cut there; texts with runs of
spaces or with U+2581 itself go to the tokenizer whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the broadcast table, each of at most MAX_CHARS characters: at most 2.5 MB.
FREQUENT = 16384
MAX_CHARS = 32
#: Pre-tokens that a task counts at once; the lighter half goes when there are more.
COUNTED = 200_000
#: Characters in a worker's cache, which is emptied when full, and in one of its entries.
CACHE, ENTRY = 8_000_000, 64

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def cut(text: str) -> list[str] | None:
    """Pre-tokens of a text; None if it must be encoded whole. A leading line feed belongs to its pre-token."""
    if not text:
        return []
    if text[0] == " " or "  " in text or "▁" in text:  # the model puts a word start before the text
        return None
    return text.replace("\n", " \n").split(" ")


class Lengths(dict):
    """Tokens of each pre-token; those missing are encoded on demand, long ones each time."""

    def __init__(self, model_path: str):
        super().__init__()
        import sentencepiece

        self.model, self.held = sentencepiece.SentencePieceProcessor(model_file=model_path), 0

    def encode(self, words: list[str]) -> list[int]:
        # the model puts a word start before the whole string: right for a word after a space, one too many after a line feed; an empty one is a lone word start
        return [len(ids) - (w[:1] == "\n") if w else 1 for w, ids in zip(words, self.model.encode(words, num_threads=1), strict=True)]

    def known(self, words: list[str]) -> None:
        """See to it that all of these are held."""
        missing = list(dict.fromkeys(w for w in words if w not in self))
        if self.held + sum(map(len, missing)) > CACHE:
            self.clear()
            self.held, missing = 0, list(dict.fromkeys(words))
        if missing:
            self.held += sum(map(len, missing))
            self.update(zip(missing, self.encode(missing), strict=True))

    def count(self, text: str, frequent: dict[str, int]) -> int:
        words = cut(text)
        if words is None:
            return len(self.model.encode(text, num_threads=1))
        total, rest = 0, []
        for n, word in zip(map(frequent.get, words), words, strict=True):
            if n is None:
                rest.append(word)
            else:
                total += n
        for at in range(0, len(rest), 10_000):  # a part's words fit the cache
            part = rest[at : at + 10_000]
            short = [w for w in part if len(w) <= ENTRY]
            self.known(short)
            total += sum(map(self.__getitem__, short))
            if len(short) < len(part):
                total += sum(self.encode([w for w in part if len(w) > ENTRY]))
        return total


_workers: dict[str, Lengths] = {}


def _lengths(model_path: str) -> Lengths:
    if model_path not in _workers:
        _workers[model_path] = Lengths(model_path)
    return _workers[model_path]


def frequent_pretokens(df: DataFrame, model_path: str, text: str = "text", size: int = FREQUENT) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of all texts.

    A task's counts can miss pre-tokens that are light in it, never heavy ones
    for good: the table of a task drops the lighter half when it is full.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0):
                seen.update(cut(value.as_py() or "") or ())
                if len(seen) > COUNTED:
                    seen = Counter(dict(seen.most_common(COUNTED // 2)))
        top = [(w, n) for w, n in seen.most_common(2 * size) if len(w) <= MAX_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    top = df.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    words = [r.word for r in top.collect()]
    return dict(zip(words, Lengths(model_path).encode(words), strict=True))


def token_counts(df: DataFrame, model_path: str, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, UTF-8 bytes, tokens, and whether they exceed ``limit``.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and keys are
    counted row by row; other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    table = spark.sparkContext.broadcast(frequent_pretokens(rows, model_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, frequent = _lengths(model_path), table.value
        for batch in batches:
            sizes, tokens = [], []
            for value in batch.column(1):
                value = value.as_py() or ""
                sizes.append(len(value) if value.isascii() else len(value.encode()))
                tokens.append(lengths.count(value, frequent))
            n = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), n, pa.array([t > limit for t in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, SCHEMA)
