"""Exact search that passes over blocks of rows which can't hold one of the first k.

The rows of a scope are ordered by the signs of random projections, which puts vectors of like direction side by side, numbered by
ranges, and cut into blocks of SIZE. A block keeps its rows, their mean and the radius around it. By the triangle
inequality no row of a block scores more than its bound: q c + |q| r for dot products, the same of unit vectors for cosines, and
-(max(0, |q - c| - r))**2 for the negative squared distance.

A search scores the FIRST blocks of highest bound, of the scopes that a unit sees, and takes the k-th score among the rows that pass its
filters as a threshold; of the other blocks only those whose bound reaches it are scored. If fewer than k rows pass, all are. Rows
without a vector, and zero vectors, score 0; a block that has one has a bound of 0 at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import policies, vectors
from tessera.operators.search import PLACES, SALTS, UNIT_ROWS, Best, dim, numbered, ranked, top_k
from tessera.session import checkpoint, small_batches

#: Rows of a block, projections, and blocks of a unit that are scored first.
SIZE, BITS, FIRST = 256, 24, 4
#: More than sums of doubles over a vector can be off.
SLACK = 1e-7
ROW = "array<struct<memory_id:string,memory_type:string,visibility:array<string>,embedding:array<float>>>"


class Blocks(NamedTuple):
    """rows: scope_id, block, rows; meta: scope_id, block, centre, radius, flat (whether a row scores 0 whatever the query)."""

    rows: DataFrame
    meta: DataFrame
    similarity: str


def direction(vector: Column, bits: int = BITS, seed: int = 5) -> Column:
    """The signs of projections on fixed random vectors, read as a Gray code: neighbours in its order differ in one sign. -1 without a
    vector."""

    @F.pandas_udf("long")
    def code(rows: pd.Series) -> pd.Series:
        out = np.full(len(rows), -1, np.int64)
        has = np.flatnonzero(rows.map(lambda v: v is not None and len(v) > 0).to_numpy(bool))
        if len(has):
            x = np.array(rows.iloc[has].tolist(), float)
            signs = x @ np.random.default_rng(seed).standard_normal((bits, x.shape[1])).T > 0
            out[has] = np.bitwise_xor.accumulate(signs, 1) @ (1 << np.arange(bits)[::-1])
        return pd.Series(out)

    return code(vector)


def build(memory: DataFrame, similarity: str = "cosine", size: int = SIZE) -> Blocks:
    """memory: memory_id, scope_id, memory_type, visibility, embedding (all of one length, or null)."""
    if similarity not in vectors.SIMILARITIES:
        raise ValueError(f"unknown similarity {similarity!r}")
    small_batches(memory.sparkSession)
    kept = memory.select("memory_id", "scope_id", "memory_type", "visibility", "embedding", direction(F.col("embedding")).alias("code"))
    placed = numbered(kept, ["scope_id"], ["code", "memory_id"]).withColumn("block", F.floor((F.col("at") - 1) / size).cast("long"))
    row = F.struct("memory_id", "memory_type", "visibility", "embedding")
    packed = checkpoint(placed.groupBy("scope_id", "block").agg(F.collect_list(row).alias("rows")))

    @F.pandas_udf("struct<centre:array<double>,radius:double,flat:boolean>")
    def ball(lists: pd.Series) -> pd.DataFrame:
        out = []
        for xs in lists:
            have = [v for v in xs if v is not None and len(v)]
            x = np.array(have, float) if have else np.zeros((1, 1))
            norm = np.linalg.norm(x, axis=1)
            if similarity == "cosine":
                x = x / np.where(norm == 0, 1, norm)[:, None]
            c = x.mean(0)
            out.append((c.tolist(), float(np.sqrt(((x - c) ** 2).sum(1).max())), len(have) < len(xs) or bool((norm == 0).any())))
        return pd.DataFrame(out, columns=["centre", "radius", "flat"])

    meta = packed.select("scope_id", "block", ball(F.transform("rows", lambda r: r["embedding"])).alias("b")).select("scope_id", "block", "b.*")
    return Blocks(packed, checkpoint(meta), similarity)


def bound(similarity: str) -> Column:
    """The most that a row of a block (centre, radius, flat) can score for qvec."""
    q, c = F.transform("qvec", lambda x: x.cast("double")), F.col("centre")
    if similarity == "euclid":
        apart = vectors.norm(F.zip_with(q, c, lambda a, b: a - b))
        best = -F.pow(F.greatest(apart - F.col("radius") - SLACK, F.lit(0.0)), 2)
    else:
        unit = vectors.normalise(q) if similarity == "cosine" else q
        best = vectors.dot(unit, c) + vectors.norm(unit) * (F.col("radius") + SLACK) + SLACK
    return F.when(F.col("flat"), F.greatest(best, F.lit(0.0))).otherwise(best)


def search(units: DataFrame, blocks: Blocks, k: int = 50, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """units: unit, qvec, scopes (empty: all), types (empty: all), asked (null: all) -> unit, memory_id, score, rank, as
    search.search; and of each unit how many blocks its scopes have, and how many were visited."""
    dealt = blocks.meta.withColumn("_salt", F.pmod(F.xxhash64("scope_id", "block"), F.lit(SALTS)))
    parts = units.select("unit", "qvec", "scopes").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = F.col("_part") == F.col("_salt")
    some = parts.where(F.size("scopes") > 0).withColumn("_scope", F.explode(F.array_distinct("scopes"))).join(dealt, (F.col("_scope") == F.col("scope_id")) & same).drop("_scope")
    met = some.unionByName(parts.where(F.size("scopes") == 0).join(dealt, same))
    every = checkpoint(met.select("unit", "scope_id", "block", F.coalesce(bound(blocks.similarity), F.lit(float("inf"))).alias("bound")))
    begin = checkpoint(top_k(every, ["unit"], first, [F.col("bound").desc(), F.col("scope_id"), F.col("block")], "nth").select("unit", "scope_id", "block"))

    def scored(visits: DataFrame) -> DataFrame:
        rows = visits.join(blocks.rows, ["scope_id", "block"]).join(units.select("unit", "qvec", "types", "asked"), "unit").select("unit", "qvec", "types", "asked", F.inline("rows"))
        ok = ((F.size("types") == 0) | F.array_contains("types", F.col("memory_type"))) & policies.readable(F.col("visibility"), F.col("asked"))
        score = F.round(F.coalesce(vectors.SIMILARITIES[blocks.similarity](F.col("qvec"), F.col("embedding")), F.lit(0.0)), PLACES)
        return ranked(rows.where(ok).select("unit", "memory_id", score.alias("score")), ["unit"], k)

    early = checkpoint(scored(begin))
    least = early.where(F.col("rank") == k).select("unit", F.col("score").alias("least"))
    later = every.join(begin, ["unit", "scope_id", "block"], "left_anti").join(least, "unit", "left")
    later = checkpoint(later.where(F.col("least").isNull() | (F.col("bound") + 10.0**-PLACES >= F.col("least"))).select("unit", "scope_id", "block", "least"))
    late = met_in_blocks(later, units, blocks, k)
    visited = begin.select("unit").union(later.select("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("visited"))
    report = every.groupBy("unit").agg(F.count(F.lit(1)).alias("blocks")).join(visited, "unit")
    return ranked(early.drop("rank").unionByName(late), ["unit"], k), report


def met_in_blocks(visits: DataFrame, units: DataFrame, blocks: Blocks, k: int) -> DataFrame:
    """visits: unit, scope_id, block, least (the unit's k-th score so far, or null) -> unit, memory_id, score of the rows of the blocks
    that may still be among the first k.

    The units that visit a block come as lists of about UNIT_ROWS, which meet its rows in one matrix product; rows below `least`
    don't leave it."""
    lists = max(1, -(-units.count() // UNIT_ROWS))
    asking = units.select("unit", "qvec", dim(F.col("qvec")).alias("dim"), F.to_json(F.struct("types", "asked"), {"ignoreNullFields": "false"}).alias("kind"))
    who = visits.join(asking, "unit").withColumn("list", F.pmod(F.xxhash64("unit"), F.lit(lists)))
    who = who.groupBy("scope_id", "block", "list", "dim").agg(F.collect_list(F.struct("unit", "qvec", "kind", "least")).alias("units"))
    kept = F.transform("rows", lambda r: F.struct(r["memory_id"].alias("id"), r["embedding"].alias("v"), dim(r["embedding"]).alias("dim"), F.to_json(F.struct(r["memory_type"].alias("memory_type"), r["visibility"].alias("visibility")), {"ignoreNullFields": "false"}).alias("kind")))
    met = who.join(blocks.rows.select("scope_id", "block", kept.alias("rows")), ["scope_id", "block"]).select("dim", "units", "rows")
    similarity = blocks.similarity

    def packed(rows: pa.StructArray, ident: str, vector: str, size: int) -> dict:
        kinds = rows.field("kind").dictionary_encode()
        x = rows.field(vector).flatten().to_numpy(zero_copy_only=False).astype("<f8") if size > 0 else np.zeros(0)
        return {"ids": rows.field(ident).to_pylist(), "dim": size, "x": x.tobytes(), "kinds": kinds.dictionary.to_pylist(), "kind": kinds.indices.to_numpy().astype("<i4").tobytes()}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field(c).type.value_type.field(f).type for c, f in (("units", "unit"), ("rows", "id"))]
            for at in range(batch.num_rows):
                # take gives lists that begin at their own first value
                asked, rows = (v.take(pa.array(range(len(v)))) for v in (batch.column(c)[at].values for c in ("units", "rows")))
                best = Best(packed(asked, "unit", "qvec", batch.column("dim")[at].as_py()), k, similarity)
                best.least = np.array([-np.inf if x is None else np.inf if np.isnan(x) else x for x in asked.field("least").to_pylist()])
                dims = rows.field("dim").to_numpy(zero_copy_only=False)
                for size in np.unique(dims):
                    best.add(packed(rows.filter(pa.array(dims == size)), "id", "v", int(size)))
                yield from best.told(types)

    small_batches(units.sparkSession)
    return met.mapInArrow(meet, f"unit {units.schema['unit'].dataType.simpleString()}, memory_id string, score double")
