"""Retrieval metrics as one grouped plan: recall and reciprocal rank at k, savings, false merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint


def per_request(results: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """request_id, n_gold, hits, recall, rr of requests that have gold rows. Repeated rows count once."""
    top = results.where((F.col("rank") <= k) & F.col("memory_id").isNotNull()).groupBy("request_id", "memory_id").agg(F.min("rank").alias("rank"))
    want = gold.select("request_id", "memory_id").distinct()
    j = want.join(top, ["request_id", "memory_id"], "left")
    per = j.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_gold"), F.count("rank").alias("hits"), F.min("rank").alias("best"))
    return per.select("request_id", "n_gold", "hits", (F.col("hits") / F.col("n_gold")).alias("recall"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("rr"))


def means(per: DataFrame) -> DataFrame:
    return per.agg(F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"), F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"), F.count(F.lit(1)).alias("evaluated"))


def savings(requests: int | object, first_stage: object):
    """Share of first-stage searches that sharing saved; none is 0."""
    r = F.col(requests) if isinstance(requests, str) else F.lit(requests)
    f = F.col(first_stage) if isinstance(first_stage, str) else F.lit(first_stage)
    return F.when(r > 0, F.greatest((r - f) / r, F.lit(0.0))).otherwise(0.0)


def false_merges(results: DataFrame, conflicts: DataFrame) -> DataFrame:
    """conflicts, merged, rate: requests that must not share, and how many of them did."""
    per = results.groupBy("request_id").agg(F.first("bucket").alias("bucket"), F.first("mode").alias("mode"))
    j = per.join(conflicts.select("request_id").distinct(), "request_id", "left_semi")
    shared = F.col("bucket").isNotNull() | ~F.contains("mode", F.lit("independent"))
    a = j.agg(F.count(F.lit(1)).alias("conflicts"), F.count_if(shared).alias("merged"))
    return a.withColumn("rate", F.when(F.col("conflicts") > 0, F.col("merged") / F.col("conflicts")).otherwise(0.0))


def rates(results: DataFrame) -> DataFrame:
    """requests, shown, duplicate_rate (rows whose entry was shown before), reuse_rate (entries of a bucket that several of its
    members use), trigger_rate (requests that fell back)."""
    per = results.groupBy("request_id").agg(F.bool_or("fallback").alias("fired"))
    fired = per.agg(F.count(F.lit(1)).alias("requests"), F.count_if("fired").alias("fired"), F.lit(1).alias("one"))
    each = results.where("memory_id IS NOT NULL").groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"))
    shown = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shown"), F.count(F.lit(1)).alias("kinds"), F.lit(1).alias("one"))
    used = results.where("bucket IS NOT NULL AND memory_id IS NOT NULL").groupBy("bucket", "memory_id").agg(F.count(F.lit(1)).alias("n"))
    used = used.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("n") > 1).alias("twice"), F.lit(1).alias("one"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return fired.join(shown, "one").join(used, "one").select("requests", "shown", F.when(F.col("shown") > 0, 1 - F.col("kinds") / F.col("shown")).otherwise(0.0).alias("duplicate_rate"), rate("twice", "pairs").alias("reuse_rate"), rate("fired", "requests").alias("trigger_rate"))


def report(results: DataFrame, gold: DataFrame, conflicts: DataFrame, k: int = 10) -> DataFrame:
    """One row: recall, mrr, evaluated, requests, first_stage, savings, conflicts, merged, rate."""
    from tessera.operators.retrieval import counters

    c = counters(results).select("requests", "first_stage")
    return means(per_request(results, gold, k)).join(c).withColumn("savings", savings("requests", "first_stage")).join(false_merges(results, conflicts))


def compare(runs: dict[str, DataFrame], gold: DataFrame, conflicts: DataFrame, k: int = 10) -> DataFrame:
    """A row for each variant. What all of them are held against is worked out once."""
    gold, conflicts = checkpoint(gold), checkpoint(conflicts)
    out = None
    for name, results in runs.items():
        one = report(results, gold, conflicts, k).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def macro(cases: DataFrame) -> DataFrame:
    """variant, case, recall, mrr, savings, conflicts, merged -> means over cases; false merges are pooled."""
    a = cases.groupBy("variant").agg(F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), F.avg("savings").alias("savings"), F.sum("conflicts").alias("conflicts"), F.sum("merged").alias("merged"))
    return a.withColumn("rate", F.when(F.col("conflicts") > 0, F.col("merged") / F.col("conflicts")).otherwise(0.0))


def clearance_merges(members: DataFrame) -> DataFrame:
    """episode, bucket, clearance -> episode, false_merge: any bucket with several clearances."""
    per = members.groupBy("episode", "bucket").agg((F.count_distinct("clearance") > 1).alias("mixed"))
    return per.groupBy("episode").agg(F.bool_or("mixed").alias("false_merge"))


def table_text(report: DataFrame) -> str:
    """A Markdown table of a small report."""
    cols = report.columns
    rows = [[f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in report.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [cols, ["---"] * len(cols), *rows])
