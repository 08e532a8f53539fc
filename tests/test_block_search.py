"""Search by blocks against the pairs of `candidates`, scored one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import search

MEMORY = "memory_id string, scope_id string, memory_type string, visibility array<string>, embedding array<float>"
UNITS = "unit string, qvec array<double>, scopes array<string>, types array<string>, asked array<string>"


def tables(spark):
    rng = np.random.default_rng(3)
    vec = lambda dim=6: [float(np.float32(x)) for x in rng.integers(-2, 3, dim)]  # noqa: E731  small integers: ties and zero vectors
    odd = [None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], vec(4), [float("nan")] * 6, [float("inf")] + [1.0] * 5]
    pick = lambda xs: xs[rng.integers(len(xs))]
    rows = [(f"m{k:04d}", pick(["a", "b", "c", None]), pick(["x", "y", None]), pick([["u"], ["v", "u"], [None], [], None]), odd[k % 25] if k % 25 < len(odd) else vec()) for k in range(700)]
    units = [(f"u{k:03d}", odd[k % 40] if k % 40 in (0, 2, 3) else vec(), pick([["a"], ["b", "a", "b"], [], ["c", None], ["zz"]]), pick([["x"], ["x", "y"], []]), pick([["u"], ["v", None], [], None])) for k in range(90)]
    return spark.createDataFrame(units, UNITS), spark.createDataFrame(rows, MEMORY).repartition(3)


@pytest.mark.parametrize("similarity", sorted(vectors.SIMILARITIES))
def test_as_pairs(spark, similarity, monkeypatch):
    monkeypatch.setattr(search, "UNIT_ROWS", 16)
    monkeypatch.setattr(search, "MEMORY_ROWS", 32)
    units, memory = tables(spark)
    score = F.round(F.coalesce(vectors.SIMILARITIES[similarity](F.col("qvec"), F.col("embedding")), F.lit(0.0)), search.PLACES)
    want = search.ranked(search.candidates(units, memory).select("unit", "memory_id", score.alias("score")), ["unit"], 7)
    got = search.search(units, memory, 7, similarity)
    told = lambda df: sorted((r["unit"], r["rank"], r["memory_id"], repr(r["score"] + 0.0)) for r in df.collect())
    assert told(got) == told(want)
    assert got.count() > 300


def test_pairs_do_not_become_rows(spark):
    """Only a task's best rows of each unit leave the step that scores; pairs joined one by one, all 70,000 did."""
    memory = spark.range(7000).selectExpr("cast(id as string) memory_id", "'s' scope_id", "'t' memory_type", "array('v') visibility", "array(cast(id as float), 1f) embedding")
    units = spark.range(10).selectExpr("cast(id as string) unit", "array(1d, cast(id as double)) qvec", "array('s') scopes", "array('t') types", "array('v') asked")
    met = search.blocks_met(search.unit_blocks(units), search.row_blocks(memory), units.schema["unit"].dataType, memory.schema["memory_id"].dataType, 3, "cosine")
    assert met.count() <= 10 * 3 * search.SALTS
