"""Gold rows of a request: the first five of its scopes and label."""

from pyspark.sql import functions as F

from tessera.operators import routing, search
from tessera.plans import retrieval_queries, views

DATA = "/root/testdata/sf0.01"


def test_gold_as_all_pairs(spark):
    r, m = routing.keyed(views.requests(spark, DATA)), views.memory(spark, DATA)
    pairs = r.select("request_id", "label", F.explode("all_scopes").alias("scope_id")).join(m.select("memory_id", "label", "scope_id"), ["label", "scope_id"])
    want = search.top_k(pairs, ["request_id"], 5, [F.col("memory_id")], "g").select("request_id", "memory_id")
    got = retrieval_queries.gold(spark, DATA)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_gold_joins_first_rows_only(spark):
    """Before, each request was joined with every row of its scopes and label."""
    plan = retrieval_queries.gold(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Window [") for line in plan.splitlines()) == 2
