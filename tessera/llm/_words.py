"""Whole-batch text machinery in numpy: words, word hashes and n-gram hashes straight from Arrow buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D, as in `[^\\x20\\x09-\\x0D]+`.
Hashes are polynomials modulo 2**64 over randomised byte values, finished by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20240517)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
P = U(int(_rng.integers(1 << 60, 1 << 62)) * 4 + 3)
Q = U(int(_rng.integers(1 << 60, 1 << 62)) * 4 + 3)
P_INV, Q_INV = (U(pow(int(x), -1, 1 << 64)) for x in (P, Q))
SEP = np.zeros(256, bool)
SEP[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are hashed at once, and powers of a base that a worker keeps; a longer text makes its own.
PIECE, KEPT = 1 << 19, 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2, ... (n of them) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        full = np.full(max(n, KEPT), base, U)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if n <= KEPT:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * U(0x9E3779B97F4A7C15)
    x = x ^ (x >> U(29))
    x = x * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def span_hash(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: np.uint64 = P, inverse: np.uint64 = P_INV) -> np.ndarray:
    """Hash of values[lo:hi] for each pair."""
    acc = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values)), out=acc[1:])
    return mix((acc[hi] - acc[lo]) * powers(inverse, len(values) + 1)[lo] + (hi - lo).astype(U))


@dataclass
class Block:
    """Some consecutive texts. Words first[d]:first[d+1] are those of text d."""

    row: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hash(BYTE[self.data], self.start, self.end)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an array of strings; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offs = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offs.astype(np.int64)


def blocks(texts: pa.Array, lower: bool = False, most: int = PIECE, separators: np.ndarray = SEP) -> Iterator[Block]:
    """Cuts texts into runs of whole texts of about `most` bytes; a longer text is a run of its own."""
    data, offs = raw(texts)
    row, n = 0, len(offs) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + most, "right")) - 1)
        part = data[offs[row] : offs[stop]]
        if lower:
            part = LOWER[part]
        at = offs[row : stop + 1] - offs[row]
        inside = ~separators[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[at] = True
        before = np.ones(len(part), bool)
        before[1:] = ~inside[:-1]
        after = np.ones(len(part), bool)
        after[:-1] = ~inside[1:]
        start = np.flatnonzero(inside & (before | edge[:-1]))
        end = np.flatnonzero(inside & (after | edge[1:])) + 1
        yield Block(row, part, at, start, end, np.searchsorted(start, at))
        row = stop


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words and hashes of all windows of n words that lie within one text."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    starts = np.arange(total - n + 1)
    ends_at = np.repeat(first[1:], np.diff(first))
    starts = starts[starts + n <= ends_at[: total - n + 1]]
    return starts, span_hash(hashes, starts, starts + n, Q, Q_INV)
