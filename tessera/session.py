"""Session helpers: tables, shared scratch space, shipping the package to executors."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
ROOT = Path(__file__).resolve().parent.parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On one machine (local mode) a folder of its own
    stands in for it; a cluster without it is an error, as executors would write where no other can read."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_owners: list[list[str]] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _owners:
        _owners[-1].append(path)
    return path


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Scratch paths that are made within it, checkpoints among them, are deleted when it ends: for those who have written a plan's
    result by then. Plans that were made within it can't be run behind it."""
    mine: list[str] = []
    _owners.append(mine)
    try:
        yield
    finally:
        _owners.remove(mine)
        for path in mine:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession) -> None:
    """Batches for Python workers of BATCH bytes at most, unless the session says how large they are: two tasks' buffers of
    Spark's usual size take a good part of a small executor's memory beside its heap. Operators that use Python ask for it."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH)


def give_back() -> None:
    """For Python workers, between batches: freed memory that Arrow and the C library would keep goes back to the system. Workers
    outlive their tasks, so what a stage leaves in them is held beside the heap in the stages behind it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def checkpoint(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cuts the lineage of df: a Parquet table in the shared folder, which survives executors, read again. With `by`, the
    rows of each value of that column are files of their own, so that readers of one value skip the others."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch(spark, "table")
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._table_path = path  # for discard()
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes the files of checkpoints that nothing reads any more; other tables are left alone."""
    for t in tables:
        if path := vars(t).get("_table_path"):
            _delete(t.sparkSession, path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers that were not started with it on their path."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    to = Path(tempfile.mkdtemp(prefix="tessera-"), "tessera_pkg.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in (ROOT / "tessera").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(to))
    sc._tessera_shipped = True
