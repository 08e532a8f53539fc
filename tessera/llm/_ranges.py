"""Which 64-bit keys occur once, over a whole table, at the cost of a few bytes a key.

Each block of documents cuts its sorted distinct keys into ranges; rows of one range, of all blocks, meet in one task,
which merges them and tells every block what it wants to know. A key that a block has many times is one entry of it,
so a hot key costs an entry a block. Numbers travel as byte planes, least first, which leaves compressors runs of zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Ranges for each shuffle partition: a task holds one range at a time.
RANGES = 4


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, behind the number of planes."""
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8).T
    wide = int(x.max(initial=0)).bit_length() + 7 >> 3 or 1
    return bytes([wide]) + planes[:wide].tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8")[:, 0]


def shuffles(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cut(keys: np.ndarray, ranges: int, limit: int = 1 << 64) -> Iterator[tuple[int, int, int, bytes]]:
    """Sorted distinct keys below limit -> (range, lo, hi, packed gaps) of each range that has keys."""
    bounds = np.array([limit * k // ranges for k in range(1, ranges)], np.uint64)
    at = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
    for k in np.flatnonzero(at[1:] > at[:-1]).tolist():
        lo, hi = int(at[k]), int(at[k + 1])
        yield k, lo, hi, pack(np.diff(keys[lo:hi], prepend=np.uint64(0)))


def keys_of(gaps: bytes) -> np.ndarray:
    return np.cumsum(unpack(gaps), dtype=np.uint64)


def meet(rows: DataFrame, merge: Callable[[list[tuple]], Iterator[tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """rows (range, ...) -> what `merge` makes of the rows of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in grouped(batches):
            out = list(merge(held))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], arrow.names)

    return rows.repartition(shuffles(rows), "range").sortWithinPartitions("range").mapInArrow(run, schema)


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch; bytes are views of it."""
    binary = lambda c: [memoryview(x.as_buffer()) if x.is_valid else None for x in c]
    return zip(*(binary(c) if pa.types.is_binary(c.type) else c.to_pylist() for c in batch.columns), strict=True)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of sorted batches, by runs of one first column."""
    held: list[tuple] = []
    for batch in batches:
        for row in rows_of(batch):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def singles(parts: list[np.ndarray], known: list[np.ndarray]) -> list[np.ndarray]:
    """For each array of distinct sorted keys, which of them occur in no other array and are not `known` to repeat."""
    keys, again = np.concatenate(parts), np.concatenate(known)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    lone = ~again[order]
    lone[1:] &= ~same
    lone[:-1] &= ~same
    out = np.empty(len(keys), bool)
    out[order] = lone
    return np.split(out, np.cumsum([len(p) for p in parts])[:-1])


class Numbers:
    """Hands out block numbers that no other task has."""

    def __init__(self):
        from pyspark import TaskContext

        self.at = TaskContext.get().partitionId() << 28

    def next(self) -> int:
        self.at += 1
        return self.at
