"""Vector compression: product codes by ball k-means.

A vector becomes whole numbers, floor(256 x), and is cut into equal parts; each part position has a codebook of at most `entries`
whole-number entries. A ball is an entry with the parts that it holds, its radius the distance of the farthest. Neighbours of an
entry are those that are at most twice its radius away: no other can be as near to one of its parts. An entry that has not
moved, and whose neighbours have not, keeps its parts unseen. Of the others, a part whose entry is nearer than half the way to any
other is in the stable core and stays; else twice its distance is a ring around the entry, and only neighbours within the
ring are candidates, which are compared exactly. All of this is in whole numbers, squared, and so are the ties: a neighbour at
the rim of a ring is within it.

Spark keeps the state: each assignment is a stored table of whole numbers and codes, from which the next is made. Sums, counts and radii
of entries are added up by partitions, so the driver sees at most parts x entries rows, and codebooks travel to tasks with the
function. The first assignment has no balls and compares all entries.

Vectors that are null, or hold null or non-finite components, are dropped. Codebooks begin as the parts of the vectors with the smallest
ids (null last, ties by components). A vector of another length than the first of these, or with a component of RANGE or more
in magnitude, where squares would pass 64 bits, has null code and error and no part in any codebook; so have all if that length is not a
multiple of `parts`, or 0. Fewer vectors than entries make smaller codebooks. Repeated rows are vectors of their own; label_error is
that of equal labels, nulls together, null where no vector has an error. Other columns are not read, and an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint, discard

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components at or beyond it: squares of differences, over 512 components, fit 63 bits.
RANGE = 1 << 26
#: Up to it, sums over 64 components of products stay below 2**53.
SMALL = 1 << 22
#: Labels whose sums are broadcast at most, at 16 bytes and more each; beyond it both sides are shuffled, the sums to SPREAD parts.
LABELS, SPREAD = 100_000, 16
#: Vectors that are worked on at once.
ROWS = 1 << 14


class Book:
    """Codebooks c[part, entry, place], and of each entry the others by distance (near, gap), how many of them are its
    neighbours (reach), and whether it keeps its parts (still)."""

    def __init__(self, c: np.ndarray, before: np.ndarray | None = None, radius: np.ndarray | None = None):
        """before: the entries of the last assignment, and the squared radii of their balls then."""
        self.c = c
        parts, entries, _ = c.shape
        gap = np.stack([((x[:, None] - x[None]) ** 2).sum(2) for x in c])
        gap[:, np.arange(entries), np.arange(entries)] = -1
        self.near = np.argsort(gap, axis=2, kind="stable")[:, :, 1:]
        self.gap = np.take_along_axis(gap, self.near, 2)
        self.reach = np.full((parts, entries), entries - 1)
        self.still = np.zeros((parts, entries), bool)
        if before is None:
            return
        shift = ((c - before) ** 2).sum(2)
        for p in range(parts):
            for e in range(entries):
                # the farthest part is no farther than before and the way that the entry went, both rounded up
                r = isqrt(int(radius[p, e])) + 1 + (isqrt(int(shift[p, e])) + 1 if shift[p, e] else 0)
                self.reach[p, e] = np.searchsorted(self.gap[p, e], 4 * r * r, "right")
                self.still[p, e] = not shift[p, e] and not shift[p, self.near[p, e, : self.reach[p, e]]].any()

    def nearest(self, x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, of all entries, and its squared distance."""
        c = self.c[p]
        if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= SMALL and x.shape[1] <= 64:  # a product of matrices of doubles is exact
            f, g = x.astype(float), c.astype(float)
            d = ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)).astype(np.int64)
        else:
            d = ((x[:, None] - c[None]) ** 2).sum(2)
        best = d.argmin(1)
        return best, d[np.arange(len(x)), best]

    def again(self, x: np.ndarray, p: int, code: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, from the entries of the last assignment and the distances to them then."""
        code, d = code.astype(np.int64), d.copy()
        todo = np.flatnonzero(~self.still[p][code])
        d[todo] = ((x[todo] - self.c[p][code[todo]]) ** 2).sum(1)
        if self.gap.shape[2] == 0:
            return code, d
        todo = todo[4 * d[todo] >= self.gap[p, code[todo], 0]]  # others are in the stable core
        own = code[todo]
        order = np.argsort(own, kind="stable")
        todo, own = todo[order], own[order]
        names, first = np.unique(own, return_index=True)
        for e, lo, hi in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(own)], strict=False):
            rows = todo[lo:hi]
            ring = np.minimum(np.searchsorted(self.gap[p, e], 4 * d[rows], "right"), self.reach[p, e])
            many = ring.astype(np.int64)
            for bits in np.unique(np.frexp(many)[1]).tolist():  # rings of like width together
                some = np.flatnonzero((np.frexp(many)[1] == bits) & (many > 0))
                if len(some):
                    self._ring(x, p, e, rows[some], ring[some], code, d)
        return code, d

    def _ring(self, x: np.ndarray, p: int, e: int, rows: np.ndarray, ring: np.ndarray, code: np.ndarray, d: np.ndarray) -> None:
        others = self.near[p, e, : ring.max()]
        away = ((x[rows][:, None] - self.c[p][others][None]) ** 2).sum(2)
        away[np.arange(len(others))[None] >= ring[:, None]] = np.iinfo(np.int64).max
        least = away.min(1)
        name = np.where(away == least[:, None], others[None], len(self.c[p])).min(1)
        better = (least < d[rows]) | ((least == d[rows]) & (name < e))
        code[rows[better]], d[rows[better]] = name[better], least[better]


def whole(vector: Column, scale: int = SCALE) -> Column:
    """The vector's components times scale, rounded down; null for vectors that are dropped."""
    fit = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    # beyond RANGE, the bound itself stands for the component
    to = lambda v: F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(-float(RANGE))), F.lit(float(RANGE)))).cast("long")
    return F.when(fit, F.transform(vector, to))


def fits(x: Column, width: int) -> Column:
    return (F.size(x) == width) & F.forall(x, lambda v: F.abs(v) < RANGE)


def assign(state: DataFrame, book: Book, first: bool) -> DataFrame:
    """The state with new codes and squared distances, stored."""
    parts = len(book.c)
    kinds = [f.dataType.simpleString() for f in state.schema]
    schema = ", ".join(f"{n} {t}" for n, t in zip(["vec_id", "label", "x", "code", "d"], kinds, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                b = batch.slice(lo, ROWS)
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(b), parts, -1)
                code, d = np.empty((len(b), parts), np.uint8), np.empty((len(b), parts), np.int64)
                if not first:
                    code[:] = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(len(b), parts)
                    d[:] = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(b), parts)
                for p in range(parts):
                    own = np.ascontiguousarray(x[:, p])
                    code[:, p], d[:, p] = book.nearest(own, p) if first else book.again(own, p, code[:, p], d[:, p])
                at = pa.array(np.arange(len(b) + 1, dtype=np.int32) * parts)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([c.tobytes() for c in code], pa.binary()), pa.ListArray.from_arrays(at, pa.array(d.ravel()))], batch.schema.names)

    return checkpoint(state.mapInArrow(run, schema))


def update(state: DataFrame, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New codebooks from the parts of each entry, and the balls' squared radii around the old ones."""
    parts, entries, width = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, far = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            d = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            at = (np.arange(parts) * entries + code).ravel()
            count += np.bincount(at, minlength=len(count))
            for k in range(width):  # below 2**53 in a batch, so exact
                total[:, k] += np.bincount(at, x[:, k], len(count)).astype(np.int64)
            np.maximum.at(far, at, d)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(far[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["at", "count", "far", "total"])

    sums = state.select("x", "code", "d").mapInArrow(run, "at long, count long, far long, total array<long>")
    each = [F.sum(F.get("total", F.lit(k))).alias(f"t{k}") for k in range(width)]
    new, radius = c.copy().reshape(-1, width), np.zeros(parts * entries, np.int64)
    for at, count, far, *total in sums.groupBy("at").agg(F.sum("count"), F.max("far"), *each).collect():
        new[at], radius[at] = [t // count for t in total], far
    return new.reshape(c.shape), radius.reshape(parts, entries)


def codebook_hash(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, c.ravel().tolist())).encode()).hexdigest()


def codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, x, code, d of each kept vector (code: a byte a part; d: squared distances of parts; both null for
    vectors that can't be coded), and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte")
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), whole(F.col(vector)).alias("x")).where("x IS NOT NULL")
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    head = kept.select("vec_id", "x").orderBy(*order)
    seeds = head.limit(entries).collect()
    width = len(seeds[0].x) if seeds else 0
    coded = fits(F.col("x"), width) if width and width % parts == 0 else F.lit(False)
    none = [F.lit(None).cast("binary").alias("code"), F.lit(None).cast("array<bigint>").alias("d")]
    if any(len(s.x) != width or max(map(abs, s.x), default=RANGE) >= RANGE for s in seeds):  # some of the first can't be coded
        seeds = head.where(coded).limit(entries).collect()
    if width % parts:
        seeds = []
    if not seeds:
        return kept.select("vec_id", "label", "x", *none), np.zeros((parts, 0, 0), np.int64)
    c = np.array([s.x for s in seeds], np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()
    state = assign(kept.where(coded).select("*", *none), Book(c), True)
    for _ in range(rounds):
        new, radius = update(state, c)
        later = assign(state, Book(new, c, radius), False)
        discard(state)
        state, c = later, new
    return state.unionByName(kept.where(~coded).select("*", *none)), c


def compressed(vectors: DataFrame, **names) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept vector."""
    state, c = codes(vectors, **names)
    total = F.when(F.col("d").isNotNull(), F.aggregate("d", F.lit(0).cast("long"), lambda a, b: a + b))
    rows = state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), total.alias("error"))
    sums = checkpoint(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.count() <= LABELS:
        out = rows.join(F.broadcast(sums), same)
    else:  # a label may have a third of all rows
        sums = sums.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        out = rows.withColumn("own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SPREAD)).cast("int")).join(sums, same & (F.col("own") == F.col("part")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebook_hash(c)).alias("codebooks_sha256"))


def op11(spark, sf_dir: str) -> DataFrame:
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


def op11_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """Rows (v, part, place, x); each round a table of entries (part, e, place, c)."""
    near = lambda k: f"""a{k} AS MATERIALIZED (SELECT v, part, min(d::HUGEINT << 8 | e) AS de FROM (SELECT v, part, e, sum((x - c) * (x - c)) AS d FROM x JOIN c{k} USING (part, place) GROUP BY ALL) GROUP BY ALL)"""
    move = lambda k: f"""c{k + 1} AS MATERIALIZED (SELECT part, e, place, coalesce(n, c) AS c FROM c{k} LEFT JOIN (SELECT part, de & 255 AS e, place, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS n FROM a{k} JOIN x USING (v, part) GROUP BY ALL) USING (part, e, place))"""
    steps = ", ".join(f"{near(k)}, {move(k)}" for k in range(rounds))
    return f"""
    WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS v, vec_id, label, list_transform(embedding, lambda y: CAST(floor({SCALE} * y::DOUBLE) AS BIGINT)) AS xs FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
    u AS (SELECT v, len(xs) // {parts} AS wide, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM k),
    x AS MATERIALIZED (SELECT v, i // wide AS part, i % wide AS place, x FROM u),
    c0 AS MATERIALIZED (SELECT part, v - 1 AS e, place, x AS c FROM x WHERE v <= {entries}), {steps}, {near(rounds)},
    t AS (SELECT v, string_agg(printf('%02x', (de & 255)::INT), '' ORDER BY part) AS code, sum(de >> 8)::BIGINT AS error FROM a{rounds} GROUP BY 1),
    h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, e, place)) AS s FROM c{rounds})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM k JOIN t USING (v), h"""
