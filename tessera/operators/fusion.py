"""Rank fusion of a shared and a private list per request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def _joined(shared: DataFrame, private: DataFrame, by: str) -> DataFrame:
    s = shared.select(F.col(by).alias("_k1"), F.col("memory_id").alias("_m1"), F.col("rank").alias("shared_rank"), F.col("score").alias("shared_score"))
    p = private.select(F.col(by).alias("_k2"), F.col("memory_id").alias("_m2"), F.col("rank").alias("private_rank"), F.col("score").alias("private_score"))
    j = s.join(p, (F.col("_k1") == F.col("_k2")) & (F.col("_m1") == F.col("_m2")), "full_outer")
    origin = F.when(F.col("_m1").isNull(), "private").when(F.col("_m2").isNull(), "shared").otherwise("both")
    return j.select(F.coalesce("_k1", "_k2").alias(by), F.coalesce("_m1", "_m2").alias("memory_id"), origin.alias("origin"), "shared_rank", "private_rank", "shared_score", "private_score")


def _rank(rows: DataFrame, by: str, k: int | None) -> DataFrame:
    order = [F.col("score").desc(), F.col("shared_rank").asc_nulls_last(), F.col("private_rank").asc_nulls_last(), F.col("memory_id")]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return rows if k is None else rows.where(F.col("rank") <= k)


def reciprocal_rank(shared: DataFrame, private: DataFrame, by: str = "request_id", k: int | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (rrf_k + rank) over the lists; at ties the shared list's order, then the private one's."""
    part = lambda c: F.coalesce(1 / (F.lit(float(rrf_k)) + F.col(c)), F.lit(0.0))
    return _rank(_joined(shared, private, by).withColumn("score", F.round(part("shared_rank") + part("private_rank"), 12)), by, k)


def score_weighted(shared: DataFrame, private: DataFrame, by: str = "request_id", k: int | None = None, weight: float = 0.7) -> DataFrame:
    """Shared rows keep their score; private rows that aren't shared come in at a discount."""
    return _rank(_joined(shared, private, by).withColumn("score", F.coalesce(F.col("shared_score"), F.col("private_score") * weight)), by, k)


def counts(fused: DataFrame, by: str = "request_id") -> DataFrame:
    """Rows by origin; what is in both counts on each side."""
    return fused.groupBy(by).agg(F.count_if(F.col("origin") != "private").alias("shared"), F.count_if(F.col("origin") != "shared").alias("private"))
