"""The shared pool by blocks against the pairs of `candidates`, scored one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import search

MEMORY = "memory_id string, scope_id string, memory_type string, visibility array<string>, created_at timestamp, ttl int, embedding array<float>"
BUCKETS = "bucket string, scope string, types array<string>, asked array<string>"
RANK, K = 4, 9


def tables(spark):
    rng = np.random.default_rng(5)
    vec = lambda dim=6: [float(np.float32(x)) for x in rng.integers(-2, 3, dim)]  # noqa: E731  small integers: ties and zero vectors
    odd = [None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [1.0, 2.0, 1.0, 1.0, None, 1.0], vec(5), vec(3), [float("nan")] * 6, [float("inf")] + [1.0] * 5, [1e30] * 6, [1e-30] * 6]
    pick = lambda xs: xs[rng.integers(len(xs))]
    rows = [(f"m{k:04d}", pick(["a", "b", "c", None]), pick(["x", "y", None]), pick([["u"], ["v", "u"], [None], [], None]), None, None, odd[k % 30] if k % 30 < len(odd) else vec()) for k in range(900)]
    rows += [r[:6] + (vec(),) for r in rows[20:60]]  # an id twice
    sizes = {"one": 1, "two": 2, "null": 2, "short": 2, "three": 3, "many": 40, "none": 5}
    buckets = [(b, pick(["a", "b", "c"]) if b != "none" else "zz", pick([["x"], ["x", "y"], []]), pick([["u"], ["v", None], [], None])) for b in sizes]
    members = [(b, at, vec(3) if b == "short" and at else [1.0, None, 2.0, 0.0, 1.0, 1.0] if b == "null" and at == 0 else vec()) for b, n in sizes.items() for at in range(n)]
    members = spark.createDataFrame(members, "bucket string, member_ord int, qvec array<double>").coalesce(1)  # moments are added in one order
    return spark.createDataFrame(buckets, BUCKETS), members, spark.createDataFrame(rows, MEMORY).repartition(3)


def pairs(buckets, members, memory, mode):
    n = members.groupBy("bucket").agg(F.count("*").alias("n"))
    rows = search.candidates(buckets.join(n, "bucket").select(F.col("bucket").alias("unit"), F.array("scope").alias("scopes"), "types", "asked", "n"), memory)
    who = members if mode == "balanced" else members.where("member_ord = 0")
    who = who.select(F.col("bucket").alias("unit"), "qvec")
    cut = lambda c: F.slice(c, 1, RANK)
    small = rows.where("n < 3").join(who, "unit").select("unit", "memory_id", vectors.cosine_eps(vectors.normalise(cut("qvec")), cut("embedding")).alias("score"))
    bases = search.bucket_bases(members.join(n.where("n >= 3"), "bucket"), RANK).withColumnRenamed("bucket", "unit")
    onto = lambda v: F.transform("basis", lambda x: vectors.dot(x, v))
    large = rows.where("n >= 3").join(bases, "unit").withColumn("z", onto(F.col("embedding")))
    if mode == "balanced":
        own = bases.join(who, "unit").select("unit", onto(vectors.normalise(F.col("qvec"))).alias("own"))
        large = large.drop("lead", "size").join(own.select("unit", F.col("own").alias("lead"), vectors.norm(F.col("own")).alias("size")), "unit")
    large = large.select("unit", "memory_id", (vectors.dot(F.col("lead"), F.col("z")) / ((F.col("size") + 1e-8) * (vectors.norm(F.col("z")) + 1e-8))).alias("score"))
    s = F.col("score")
    scored = small.unionByName(large).groupBy("unit", "memory_id").agg(F.max("score").alias("score"))
    scored = scored.withColumn("score", F.when(F.isnan(s) | s.isNull() | (F.abs(s) == float("inf")), 0.0).otherwise(F.round(s, search.PLACES)))
    return search.ranked(scored, ["unit"], K).withColumnRenamed("unit", "bucket")


@pytest.mark.parametrize("mode", ["parity", "balanced"])
def test_as_pairs(spark, mode, monkeypatch):
    monkeypatch.setattr(search, "UNIT_ROWS", 16)
    monkeypatch.setattr(search, "MEMORY_ROWS", 32)
    buckets, members, memory = tables(spark)
    told = lambda df: sorted((r["bucket"], r["rank"], r["memory_id"], repr(r["score"] + 0.0)) for r in df.collect())
    want = told(pairs(buckets, members, memory, mode))
    met, made = search.blocks_met, []
    monkeypatch.setattr(search, "blocks_met", lambda *a: made.append(met(*a)) or made[-1])
    got = told(search.pool(buckets, members, memory, F.current_timestamp(), K, RANK, mode))
    assert got == want
    assert len({r[0] for r in got}) > 4 and len(got) > 40
    assert len(made) == 1  # scored by blocks


def test_pairs_do_not_become_rows(spark, monkeypatch):
    """Only a task's best rows of each bucket leave the step that scores; pairs joined one by one, all 14,000 did."""
    memory = spark.range(7000).selectExpr("cast(id as string) memory_id", "'s' scope_id", "'t' memory_type", "array('v') visibility", "cast(null as timestamp) created_at", "cast(null as int) ttl", "array(cast(id as float), 1f) embedding")
    members = spark.range(8).selectExpr("if(id < 1, 'a', 'b') bucket", "cast(greatest(id - 1, 0) as int) member_ord", "array(1d, cast(id as double)) qvec")
    buckets = spark.sql("SELECT b AS bucket, 's' AS scope, array('t') AS types, array('v') AS asked FROM VALUES ('a'), ('b') AS t(b)")
    met, made = search.blocks_met, []
    monkeypatch.setattr(search, "blocks_met", lambda *a: made.append(met(*a)) or made[-1])
    assert search.pool(buckets, members, memory, F.current_timestamp(), 3).count() == 6
    assert [m.count() <= 2 * 3 * search.SALTS for m in made] == [True]
