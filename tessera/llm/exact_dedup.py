"""Exact deduplication in the manner of a grace hash join.

Before the shuffle each batch folds its own equal texts, so that a hot text crosses as a row a batch. Behind the shuffle
by text hash, each task folds its records into an open-addressing table that compares complete content. When the table's
distinct texts outgrow `budget` bytes, its entries and all later records go to spill files by the next bits of the hash,
and each file is folded in turn, recursively, in a folder that the task deletes when it ends.

Null text counts as empty. Of equal texts the row with the largest id stays; null ids are smaller than any other. Rows
that repeat both text and id count as copies, of which one is kept. Long texts are compared whole. An empty table gives
an empty result; other columns are carried by `keepers`, whatever their names, and not read. Spill files lie in the
machine's own temporary folder: they are part of one task's work, and a task that is run again makes its own.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import free_names, give_back, small_batches

BUDGET = 64 << 20
FANOUT_BITS = 4
SCHEMA = pa.schema([("h", pa.int64()), ("text", pa.large_string()), ("keep_id", pa.int64()), ("n", pa.int64())])
MISSING = -(2**63)


def as_records(batch: pa.RecordBatch) -> pa.Table:
    return pa.Table.from_batches([batch]).select(SCHEMA.names).cast(SCHEMA)


class Table:
    """Open addressing with linear probing over whole batches: each round every open record looks at its slot, and stays
    if the slot is free or holds the same text; the others move on by one."""

    def __init__(self):
        self.slots = np.full(1 << 10, -1, np.int64)
        self.hash = np.zeros(0, np.int64)
        self.keep = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.text = pa.chunked_array([], pa.large_string())
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.hash)

    def _grow(self, total: int) -> None:
        size = len(self.slots)
        while size < 2 * total:
            size *= 2
        if size > len(self.slots):
            self.slots = np.full(size, -1, np.int64)
            left, at = np.arange(len(self)), self._slot(self.hash)
            while len(left):
                free = self.slots[at] < 0
                self.slots[at[free][::-1]] = left[free][::-1]
                won = self.slots[at] == left
                left, at = left[~won], (at[~won] + 1) & (size - 1)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & (len(self.slots) - 1)

    def fold(self, records: pa.Table) -> None:
        """Adds records; equal texts become one entry with the largest keep_id and the sum of n."""
        if not records.num_rows:
            return
        base = len(self)
        self._grow(base + records.num_rows)
        texts = pa.chunked_array([*self.text.chunks, *records["text"].chunks], pa.large_string())
        h = np.concatenate([self.hash, records["h"].to_numpy()])
        left = np.arange(base, len(h))
        owner = np.arange(len(h))
        at = self._slot(h[left])
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free][::-1]] = left[free][::-1]  # the first of several takes it
            there = self.slots[at]
            same = there == left
            maybe = np.flatnonzero(~same & (h[there] == h[left]))
            if len(maybe):
                equal = pc.equal(texts.take(pa.array(there[maybe])), texts.take(pa.array(left[maybe]))).to_numpy()
                same[maybe[equal]] = True
            owner[left[same]] = there[same]
            left, at = left[~same], (at[~same] + 1) & (len(self.slots) - 1)
        own = np.unique(owner)
        to = np.searchsorted(own, owner)
        keep, n = np.full(len(own), MISSING, np.int64), np.zeros(len(own), np.int64)
        np.maximum.at(keep, to, np.concatenate([self.keep, records["keep_id"].to_numpy()]))
        np.add.at(n, to, np.concatenate([self.n, records["n"].to_numpy()]))
        used = self.slots >= 0
        self.slots[used] = np.searchsorted(own, self.slots[used])
        self.hash, self.keep, self.n = h[own], keep, n
        self.text = pa.chunked_array([texts.take(pa.array(own)).combine_chunks()], pa.large_string()) if len(own) < len(texts) else texts
        self.bytes = self.text.nbytes

    def records(self) -> pa.Table:
        return pa.table([pa.array(self.hash), self.text, pa.array(self.keep), pa.array(self.n)], schema=SCHEMA)


def grace(stream: Iterator[pa.Table], budget: int = BUDGET, level: int = 0, folder: str | None = None) -> Iterator[pa.Table]:
    """Folds a stream of records of any size; only one bucket's distinct texts are in memory at a time."""
    table = Table()
    for part in stream:
        table.fold(part)
        if table.bytes > budget and level * FANOUT_BITS < 60 and len(table) > 1:
            break
    else:
        yield table.records()
        return
    own = folder or tempfile.mkdtemp(prefix="grace-")
    try:
        here = tempfile.mkdtemp(dir=own)
        files = {}

        def spill(records: pa.Table) -> None:
            bucket = (records["h"].to_numpy().astype(np.uint64) >> np.uint64(level * FANOUT_BITS)) & np.uint64((1 << FANOUT_BITS) - 1)
            for k in np.unique(bucket):
                if k not in files:
                    files[k] = pa.ipc.new_file(os.path.join(here, str(k)), SCHEMA)
                files[k].write_table(records.filter(pa.array(bucket == k)))

        spill(table.records())
        del table
        for part in stream:
            spill(part)
        for f in files.values():
            f.close()
        for k in sorted(files):
            name = os.path.join(here, str(k))
            with pa.OSFile(name) as f:
                got = pa.ipc.open_file(f)
                yield from grace((pa.Table.from_batches([got.get_batch(i)]) for i in range(got.num_record_batches)), budget, level + 1, own)
            os.remove(name)
    finally:
        if folder is None:
            shutil.rmtree(own, ignore_errors=True)


def groups(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """rows: h, text, sha, keep_id, n. One row per distinct text: sha, keep_id, group_size."""

    def fold_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = Table()
            table.fold(as_records(b))
            yield from table.records().to_batches()
            give_back()

    def fold_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grace((as_records(b) for b in batches), budget):
            yield from t.to_batches(max_chunksize=2000)

    small_batches(rows.sparkSession)
    shape = "h long, text string, keep_id long, n long"
    folded = rows.select("h", "text", "keep_id", "n").mapInArrow(fold_batch, shape).repartition("h")
    out = folded.mapInArrow(fold_all, shape)
    return out.select(F.unhex(F.sha2("text", 256)).alias("sha"), F.col("keep_id").alias("best"), F.col("n").alias("group_size"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    found, narrow = _parts(docs, doc_id, text, budget)
    # one row per id and text goes to the join, and comes back as often as it was there
    per = narrow.groupBy("sha", "i").agg(F.count(F.lit(1)).cast("int").alias("times"))
    per = per.join(found.withColumnRenamed("sha", "_sha"), F.col("sha") == F.col("_sha")).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times"))))
    back = lambda c: F.nullif(F.col(c), F.lit(MISSING))
    return per.select(back("i").alias("doc_id"), back("best").alias("keep_id"), "group_size", ((F.col("i") == F.col("best")) & (F.col("nth") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _parts(docs: DataFrame, doc_id: str, text: str, budget: int) -> tuple[DataFrame, DataFrame]:
    body = F.coalesce(F.col(text), F.lit(""))
    ident = F.coalesce(F.col(doc_id), F.lit(MISSING)).cast("long")
    rows = docs.select(F.xxhash64(body).alias("h"), body.alias("text"), ident.alias("keep_id"), F.lit(1).cast("long").alias("n"))
    return groups(rows, budget), docs.select(ident.alias("i"), F.unhex(F.sha2(body, 256)).alias("sha"))


def keepers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """The rows of docs that stay, whole."""
    found, _ = _parts(docs, doc_id, text, budget)
    sha, i, best_sha, best = free_names(docs, "sha", "i", "best_sha", "best")
    d = docs.withColumn(sha, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))).withColumn(i, F.coalesce(F.col(doc_id), F.lit(MISSING)).cast("long"))
    found = found.select(F.col("sha").alias(best_sha), F.col("best").alias(best))
    d = d.join(found, (F.col(sha) == F.col(best_sha)) & (F.col(i) == F.col(best)))
    return d.dropDuplicates([best_sha, best]).select(*(F.col(f"`{c}`") for c in docs.columns))


def op6(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keepers(docs)


OP6_SQL = """
    WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(g.t) AS text_sha256
    FROM documents d JOIN g ON coalesce(d.text, '') = g.t"""
