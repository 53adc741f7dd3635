"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run outside ``[\\x20\\x09-\\x0D]``. All of it works on the
UTF-8 bytes: no byte of a multi-byte character equals a separator, so bytes
and characters agree on where words end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_M1 = U(0xBF58476D1CE4E5B9)
_M2 = U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; overwrites ``x``."""
    x ^= x >> U(30)
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def pair_hash(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    return mix(a * _ODD + (b ^ (b >> U(29))) * _M2 + U(salt))


def _lower_table() -> np.ndarray:
    codes = np.arange(256, dtype=np.uint8)
    codes[65:91] += 32
    return codes


_LOWER = _lower_table()
#: Of eight little-endian bytes, those of a word of that many bytes.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)
#: Bytes of a word that are hashed for all words at once; longer words are hashed one by one.
_STEPS = 8


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8), offsets


def slices(column: pa.Array, most_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``most_bytes``: (first row, end row, bytes, offsets from 0)."""
    data, offsets = buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most_bytes, side="right")) - 1
        end = min(rows, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of a run of texts: byte starts and ends, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters_only: bool = False):
        if letters_only:
            inside = _LETTER[data]
        else:
            inside = _WORD[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[edges] |= inside[edges]
        edges = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[edges] |= inside[edges]
        self.data = data
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc_of(self) -> np.ndarray:
        """For each word, the index of its text within the run."""
        return np.repeat(np.arange(len(self.bounds) - 1, dtype=np.int32), self.counts())

    def hashes(self, lower: bool = False, seed: int = 0, size: int | None = None) -> np.ndarray:
        """64-bit hashes of the words, A-Z folded to a-z if ``lower``; of their first ``size`` (1 to 8) bytes if given.

        Eight bytes at a time go through a finaliser that isn't linear in any
        ring, so words made of repeated patterns don't meet. Different seeds
        give independent hashes.
        """
        data = _LOWER[self.data] if lower else self.data
        length = self.ends - self.starts
        if size:
            length = np.minimum(length, size)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))
        h = mix(length.astype(U) * _ODD + U(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        at, left, rows = self.starts, length, slice(None)
        for step in range(_STEPS):
            h[rows] = mix(h[rows] ^ (eight[at] & _KEEP[np.minimum(left, 8)]) * _ODD)
            rows = np.flatnonzero(length > 8 * (step + 1))
            if not len(rows):
                return h
            at, left = self.starts[rows] + 8 * (step + 1), length[rows] - 8 * (step + 1)
        raw, key = data.data, seed.to_bytes(8, "little")
        for k in rows.tolist():
            h[k] = int.from_bytes(hashlib.blake2b(raw[self.starts[k] : self.ends[k]], digest_size=8, key=key).digest(), "little")
        return h

    def prefix_hashes(self, sizes: tuple[int, ...], lower: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each size (0: the whole word), (word indices, hashes of that many first bytes)."""
        found = []
        for size in sizes:
            at = np.flatnonzero(self.ends - self.starts > size)
            found.append((at, self.hashes(lower, size=size or None)[at]))
        return found

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, starts): all words, each followed by one space, and where each begins; the last start is the end."""
        length = self.ends - self.starts
        at = np.concatenate([[0], np.cumsum(length + 1)])
        kind = np.int32 if at[-1] < 1 << 31 else np.int64
        out = np.full(int(at[-1]), 32, np.uint8)
        # a word's bytes all move by the same distance
        place = np.arange(int(length.sum()), dtype=kind)
        place += np.repeat((at[:-1] - (np.cumsum(length) - length)).astype(kind), length)
        move = np.repeat((self.starts - at[:-1]).astype(kind), length)
        move += place
        out[place] = self.data[move]
        return out, at


_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def ngram_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (by doubling); runs ignore text bounds."""
    if len(words) < n:
        return np.empty(0, U)
    power, width, acc, acc_width = words, 1, None, 0
    while True:
        if n & width:
            if acc is None:
                acc, acc_width = power, width
            else:
                size = min(len(power) - acc_width, len(acc))
                acc = pair_hash(acc[:size], power[acc_width : acc_width + size], salt + 2)
                acc_width += width
        if acc_width == n:
            return acc[: len(words) - n + 1]
        power = pair_hash(power[: len(power) - width], power[width:], salt + 1)
        width *= 2
