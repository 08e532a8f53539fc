"""JSON files that are one list, or an object with a list under `data`, read in ranges of bytes.

Spark's text source cuts at a separator of any kind, so it is told to cut at `}`: each task gets the records of a range of bytes,
through whatever file system Spark reads, and the last byte before each of them is known. What a task can't know is whether its range
begins inside a string, and how deep. Quotes behind an even run of backslashes turn strings on and off, so a first pass gives the
parity of each range, and its change of depth for either beginning; running totals over the ranges of a file, of which there is one for
each `spark.sql.files.maxPartitionBytes`, give each range its beginning. A second pass emits the texts of the objects that lie within a
range, and the pieces of those that don't, which are put together. Spark parses the texts.

A file that begins with `[` is a list; its objects are rows, other elements are none. A file that begins with `{` has its rows in the
list under its own key `data`; if it has no such list, it is a row itself. Empty files have no rows. Rows whose columns are all null are
skipped. Strings may hold brackets, quotes and separators. One object is the unit of memory. Where JSON is broken, rows of that file may be
lost or null, as with any reader that skips what it can't parse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.session import checkpoint, small_batches

QUOTE, SLASH, OPEN, CLOSE, LIST, END = b'"\\{}[]'
WHITE = b" \t\r\n"
#: A key before a list, at the end of what stands before the list.
KEY = re.compile(rb'"data"\s*:\s*$')
#: Levels of an object: a row itself, a row of a list, a row of the list under `data`.
SELF, BARE, WRAPPED = 0, 1, 2


def quotes(data: np.ndarray) -> np.ndarray:
    """Places of the quotes that begin or end a string: those behind an even number of backslashes."""
    at = np.flatnonzero(data == QUOTE)
    slash = data == SLASH
    if not slash.any():
        return at
    # places since the last byte that is no backslash
    last = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))
    run = np.where(at > 0, at - 1 - last[at - 1], 0)
    return at[run % 2 == 0]


def outside(data: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Places of brackets that are in no string, and whether the data ends within one."""
    q = quotes(data)
    at = np.flatnonzero((data == OPEN) | (data == CLOSE) | (data == LIST) | (data == END))
    return at[(np.searchsorted(q, at) + inside) % 2 == 0], bool(inside ^ (len(q) % 2))


def steps(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Changes of depth."""
    return np.where((data[at] == OPEN) | (data[at] == LIST), 1, -1)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bytes]]:
    """(file, start), text of runs of records of one range; each record gets its separator back."""
    for batch in batches:
        file, start = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (start[1:] != start[:-1]))) if len(file) else []
        for lo, hi in zip(cut, [*cut[1:], len(file)], strict=True):
            yield (int(file[lo]), int(start[lo])), b"}".join(x.as_buffer().to_pybytes() for x in batch.column(2).slice(lo, hi - lo)) + b"}"


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, start, parity, deep0, deep1 (changes of depth if it begins outside or inside a string), opens (its first byte)."""
    held: dict[tuple[int, int], list] = {}
    for key, text in _ranges(batches):
        data = np.frombuffer(text, np.uint8)
        s = held.setdefault(key, [False, 0, 0, ""])
        for begins in (0, 1):
            at, ends = outside(data, bool(begins) ^ s[0])
            s[1 + begins] += int(steps(data, at).sum())
        s[0] = ends ^ True  # that of the second, turned
        if not s[3]:
            s[3] = text.lstrip(WHITE + "﻿".encode())[:1].decode("latin-1")
    if held:
        rows = [(*k, *v) for k, v in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["file", "start", "parity", "deep0", "deep1", "opens"])


class _Cutter:
    """Follows one range. Objects of a level are told as (part, text), part 0: whole, 1: begins here, 2: goes on, 3: ends here.
    `under` says whether the last list of the outer object, or what stands there now, is that under `data`."""

    def __init__(self, level: int, inside: bool, depth: int, under: bool | None = None):
        self.level, self.inside, self.depth, self.under = level, inside, depth, under
        self.open = depth > level and (level != WRAPPED or bool(under))
        self.began = self.ever = False
        self.parts: list[bytes] = []
        self.before = b""

    def feed(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        data = np.frombuffer(text, np.uint8)
        at, ends = outside(data, self.inside)
        step = steps(data, at)
        depth = self.depth + np.cumsum(step)
        low = depth - (step > 0)  # the depth around a bracket's pair
        what = data[at]
        marks = ((what == OPEN) | (what == CLOSE)) & (low == self.level)
        if self.level == WRAPPED:
            marks |= ((what == LIST) | (what == OPEN)) & (low == 1)
        done = 0
        for k, around, byte in zip(at[marks].tolist(), low[marks].tolist(), what[marks].tolist(), strict=True):
            if around != self.level:
                self.under = byte == LIST and KEY.search((self.before + text[max(0, k - 256) : k])[-256:]) is not None
                self.ever |= self.under
            elif byte == OPEN:
                self.open = self.began = self.level != WRAPPED or bool(self.under)
                done = k
            elif self.open:
                yield 0 if self.began else 3, b"".join(self.parts) + text[done : k + 1]
                self.parts, self.open = [], False
        if self.open:
            self.parts.append(text[done:])
        self.before = (self.before + text[-256:])[-256:]
        self.inside, self.depth = ends, int(depth[-1]) if len(depth) else self.depth

    def rest(self) -> Iterator[tuple[int, bytes]]:
        if self.open:
            yield 1 if self.began else 2, b"".join(self.parts)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, _Cutter, bytes | None]]:
    """Key, cutter and text of each run of records, and None behind the last run of a range."""
    last, cutter = None, None
    for batch in batches:
        states = batch.select(["file", "start", "level", "inside", "depth", "under"]).to_pylist()
        at = 0
        for key, text in _ranges([batch]):
            while (states[at]["file"], states[at]["start"]) != key:
                at += 1
            if key != last:
                if cutter:
                    yield last, cutter, None
                s = states[at]
                last, cutter = key, _Cutter(s["level"], s["inside"], s["depth"], s["under"])
            yield key, cutter, text
    if cutter:
        yield last, cutter, None


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, start, last (whether what the outer object had last is the list under `data`; null if it had nothing), ever."""
    for key, cutter, text in _followed(batches):
        if text is None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([cutter.under], pa.bool_()), pa.array([cutter.ever])], ["file", "start", "last", "ever"])
        else:
            for _ in cutter.feed(text):
                pass


PIECES = "file long, start long, part int, text binary"


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, cutter, text in _followed(batches):
        rows = list(cutter.rest() if text is None else cutter.feed(text))
        for lo in range(0, len(rows), 10_000):
            part, found = zip(*rows[lo : lo + 10_000], strict=True)
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n), pa.array([key[1]] * n), pa.array(part, pa.int32()), pa.array(found, pa.binary())], ["file", "start", "part", "text"])


def texts(spark: SparkSession, path: str) -> DataFrame:
    """The texts of the rows of the files at path."""
    small_batches(spark)
    lines = spark.read.option("lineSep", "}").text(path).select(F.xxhash64(F.input_file_name()).alias("file"), F.input_file_block_start().alias("start"), F.col("value").cast("binary").alias("text"))
    order = Window.partitionBy("file").orderBy("start")
    prior, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = checkpoint(lines.mapInArrow(_summary, "file long, start long, parity boolean, deep0 long, deep1 long, opens string"))
    known = ranges.withColumn("inside", F.coalesce(F.sum(F.col("parity").cast("int")).over(prior), F.lit(0)) % 2 == 1)
    known = known.withColumn("deep", F.when(F.col("inside"), F.col("deep1")).otherwise(F.col("deep0")))
    first = F.first(F.nullif("opens", F.lit("")), True).over(every)
    level = F.when(first == "[", BARE).when(first == "{", WRAPPED)
    known = known.select("file", "start", level.alias("level"), "inside", F.coalesce(F.sum("deep").over(prior), F.lit(0)).cast("int").alias("depth"), F.lit(None).cast("boolean").alias("under"))
    known = checkpoint(known.where("level IS NOT NULL"))

    def follow(states: DataFrame, run, schema: str) -> DataFrame:  # a state is a few numbers a range of maxPartitionBytes
        return checkpoint(lines.join(F.broadcast(states), ["file", "start"]).select("file", "start", "text", "level", "inside", "depth", "under").mapInArrow(run, schema))

    outer = known.where(F.col("level") == WRAPPED)
    if not outer.isEmpty():
        lists = follow(outer, _lists, "file long, start long, last boolean, ever boolean")
        lists = lists.select("file", "start", F.last("last", True).over(prior).alias("now"), F.max("ever").over(every).alias("ever"))
        known = known.join(lists, ["file", "start"], "left").select("file", "start", F.when(~F.col("ever"), SELF).otherwise(F.col("level")).alias("level"), "inside", "depth", F.col("now").alias("under"))
    found = follow(known, _objects, PIECES)
    # of an object over several ranges: what begins, goes on and ends it
    pieces = found.where("part > 0").withColumn("nth", F.sum((F.col("part") == 1).cast("int")).over(Window.partitionBy("file").orderBy("start", F.desc("part"))))
    whole = pieces.groupBy("file", "nth").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p"), F.max("part").alias("end")).where("end = 3")
    text = lambda c: F.decode(c, "UTF-8")
    joined = whole.select(text(F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["text"]))).alias("text"))
    return found.where("part = 0").select(text(F.col("text")).alias("text")).unionByName(joined)


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    rows = texts(spark, path).select(F.from_json("text", schema).alias("r")).where("r IS NOT NULL").select("r.*")
    return rows.where(" OR ".join(f"`{c}` IS NOT NULL" for c in rows.columns))


def write(rows: DataFrame, path: str, wrapped: bool = False) -> None:
    """A folder of files, each one list of rows, or an object with the list under `data`."""
    head, tail = ("{\"data\": [", "]}") if wrapped else ("[", "]")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = False
        for batch in batches:
            if len(batch):
                first = head if not some else ","
                yield pa.RecordBatch.from_arrays([pa.array([(first if k == 0 else ",") + x for k, x in enumerate(batch.column(0).to_pylist())])], ["value"])
                some = True
        yield pa.RecordBatch.from_arrays([pa.array([tail if some else head + tail])], ["value"])

    rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("value")).mapInArrow(lists, "value string").write.text(path)
