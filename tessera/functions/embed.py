"""Embedding adapters: Arrow-batched, each distinct text once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pseudo_random(text: str, dim: int) -> np.ndarray:
    """A unit vector that only depends on the text: the stream is seeded by the first 8 hex digits of its md5."""
    x = np.random.RandomState(int(hashlib.md5(text.encode()).hexdigest()[:8], 16)).randn(dim).astype(np.float32)
    n = np.linalg.norm(x)
    return x / n if n > 0 else x


def embed(rows: DataFrame, text: str, dim: int = 64, column: str = "embedding", batch: Callable[[list[str]], list] | None = None, size: int = 32) -> DataFrame:
    """Adds an embedding. `batch` is a provider's call for up to `size` texts; without one vectors are pseudo-random.
    Equal texts are embedded once and joined back; null texts have no vector."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.tolist()
            if batch is None:
                yield pd.Series([pseudo_random(t, dim).tolist() for t in texts], dtype=object)
            else:
                yield pd.Series([list(v) for k in range(0, len(texts), size) for v in batch(texts[k : k + size])], dtype=object)

    known = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct().withColumn(column, run("_text"))
    return rows.join(known, F.col(text) == F.col("_text"), "left").drop("_text")


def fill(memory: DataFrame, text: str = "content", dim: int = 64, column: str = "embedding", batch: Callable[[list[str]], list] | None = None) -> DataFrame:
    """Rows without a vector get that of their text; the others keep theirs, and their texts are not embedded."""
    have, bare = memory.where(F.col(column).isNotNull()), memory.where(F.col(column).isNull()).drop(column)
    made = embed(bare, text, dim, column, batch)
    return have.unionByName(made.select(*(F.col(c).cast(t).alias(c) if c == column else F.col(c) for c, t in memory.dtypes)))
