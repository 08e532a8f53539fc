"""Pruned search against search.search, and how much it passes over."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import pruned, search

UNITS = "unit string, qvec array<float>, scopes array<string>, types array<string>, asked array<string>"
MEMORY = "memory_id string, scope_id string, memory_type string, visibility array<string>, embedding array<float>"


def world(spark, n=3000, width=16, clusters=40, near=0.05, seed=4):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((clusters, width))
    x = centres[r.integers(0, clusters, n)] + near * r.standard_normal((n, width))
    rows = [(f"m{k:05d}", f"s{k % 3}" if k % 50 else "lonely", ["a", "b"][k % 2], [["team"], ["public"], []][k % 3], None if k % 97 == 0 else [0.0] * width if k % 101 == 0 else x[k].tolist()) for k in range(n)]
    asked = [(f"u{k}", (centres[k % clusters] + near * r.standard_normal(width)).tolist(), [["s0"], ["s1", "s2", "s1"], [], ["lonely"], ["nowhere"]][k % 5], [[], ["a"]][k % 2], [None, ["team"]][k // 2 % 2]) for k in range(40)]
    asked += [("zero", [0.0] * width, [], [], None), ("minus", (-centres[0]).tolist(), ["lonely"], [], None)]
    return spark.createDataFrame(asked, UNITS), spark.createDataFrame(rows, MEMORY).repartition(3)


@pytest.mark.parametrize("similarity", ["cosine", "dot", "euclid"])
def test_equals_search(spark, similarity):
    units, memory = world(spark)
    got, report = pruned.search(units, pruned.build(memory, similarity, 32), 10, 3)
    want = search.search(units, memory, 10, similarity)
    plain = lambda df: sorted((r.unit, r.rank, r.memory_id, r.score) for r in df.collect())
    assert plain(got) == plain(want)
    seen = report.agg(F.sum("visited").alias("v"), F.sum("blocks").alias("b")).first()
    assert seen.v < seen.b


def test_most_blocks_are_passed_over(spark):
    units, memory = world(spark, clusters=60, near=0.01)
    units = units.where("unit <> 'zero'").withColumn("scopes", F.array().cast("array<string>")).withColumn("types", F.array().cast("array<string>")).withColumn("asked", F.lit(None).cast("array<string>"))
    _, report = pruned.search(units, pruned.build(memory.where("embedding IS NOT NULL").withColumn("scope_id", F.lit("s")), "cosine", 16), 5, 3)
    assert report.agg(F.sum("visited") / F.sum("blocks")).first()[0] < 0.25


def test_empty(spark):
    units, memory = world(spark, 10)
    assert pruned.search(units, pruned.build(memory.limit(0)), 3)[0].count() == 0
    assert pruned.search(units, pruned.build(memory.withColumn("embedding", F.lit(None).cast("array<float>"))), 3)[0].where("score <> 0").count() == 0


def test_open_units_meet_parts(spark):
    units, memory = world(spark, 50)
    plan = search.candidates(units, memory)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_late_visits_send_best_rows_only(spark):
    """Of the blocks behind the first, a unit's rows below its threshold don't leave the step that scores them."""
    from tessera.operators.pruned import met_in_blocks

    memory = spark.range(3000).selectExpr("cast(id as string) memory_id", "'s' scope_id", "'t' memory_type", "array('v') visibility", "array(cast(id as float), 1f) embedding")
    units = spark.createDataFrame([("u", [0.0, 1.0], ["s"], ["t"], ["v"]), ("w", [1.0, 0.0], ["s"], [], None)], "unit string, qvec array<double>, scopes array<string>, types array<string>, asked array<string>")
    blocks = pruned.build(memory)
    visits = units.select("unit").crossJoin(blocks.meta.select("scope_id", "block")).withColumn("least", F.when(F.col("unit") == "u", 0.5))
    got = [tuple(r) for r in met_in_blocks(visits, units, blocks, 5).collect()]
    assert sorted(m for u, m, _ in got if u == "u") == ["0", "1"]  # 1 / sqrt(1 + 1) is above 0.5, 1 / sqrt(4 + 1) is not
    assert len([m for u, m, _ in got if u == "w"]) == 5 * blocks.meta.count()
