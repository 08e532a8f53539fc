"""Rerank scores of rows whose time lies so far ahead that their recency is infinite."""

from pyspark.sql import functions as F

from tessera.functions import features

INF = float("inf")


def test_recency_counts_for_roles_that_weigh_it(spark):
    rows = spark.createDataFrame([(r, 0.5, INF, 0.9, 0.6) for r in ("planner", "solver", "verifier", "critic")], "role string, summary double, recency double, authority double, provenance double")
    got = {r["role"]: r["s"] for r in rows.select("role", features.rerank_score(F.col("role")).alias("s")).collect()}
    assert got == {"planner": INF, "solver": 0.5 * 0.5 + 0.2 * 0.9, "verifier": INF, "critic": INF}


def test_rounded_as_sql(spark):
    import duckdb

    xs = [0.1234567894999, -0.1234567895001, 2.746765959080352e31, 5.5313073868858155e31, 4.130316656623577e224, 1e300, 0.0, INF, -INF]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 9)", [x]).fetchone()[0] for x in xs]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double")
    assert [r["y"] for r in rows.select("k", features.rounded(F.col("x"), 9).alias("y")).orderBy("k").collect()] == want
