"""The retrieval pipeline: route, first stage, personalise, private fallback, fuse.

Variants: a1 searches for every request on its own; a3 and a4 route by scope alone and search with the mean vector, a3
without rerank and fallback; a5 routes by scope, types and policy and searches a shared pool.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import features
from tessera.operators import fusion, routing, search
from tessera.session import checkpoint

VARIANTS = {"a1": "a1", "independent": "a1", "a3": "a3", "a4": "a4", "a5": "a5", "full": "a5"}


@dataclass(frozen=True)
class Config:
    shared_top_k: int = 50
    rerank_top_k: int = 20
    fallback_threshold: int = 5
    max_private: int = 20
    svd_rank: int = 64
    pool_mode: str = "parity"
    fix_keyword: bool = False
    min_score: float | None = None
    enable_rerank: bool = True
    enable_fallback: bool = True


    @classmethod
    def read(cls, settings: dict | None = None, env: dict | None = None) -> Config:
        """Settings by name, as a YAML file has them, overridden by TESSERA_<NAME> in the environment; unknown names are errors."""
        kinds = {f.name: f.default for f in fields(cls)}
        found = dict(settings or {})
        found |= {k: v for k in kinds if (v := (os.environ if env is None else env).get(f"TESSERA_{k.upper()}")) is not None}
        if unknown := set(found) - set(kinds):
            raise ValueError(f"unknown settings {sorted(unknown)}")
        flag = lambda v: v if isinstance(v, bool) else str(v).lower() in ("1", "true", "yes")
        cast = lambda k, v: flag(v) if isinstance(kinds[k], bool) else float(v) if k == "min_score" else type(kinds[k])(v)
        return cls(**{k: None if v is None else cast(k, v) for k, v in found.items()})


PROFILE = ("memory_id", "content", "confidence", "created_at", "source", "parent_event", "prov_agent", "prov_at", "version")


def personalise(pool: DataFrame, requests: DataFrame, memory: DataFrame, as_of: Column, config: Config = Config(), rerank: bool = True) -> DataFrame:
    """pool: request_id, memory_id, score, pool_rank. With rerank, the first rerank_top_k by rerank score stay and
    are ordered by the mean of both scores; without, the first of the pool stay."""
    top = config.rerank_top_k
    if not rerank:
        rows = pool.where(F.col("pool_rank") <= top)
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("score").desc(), "pool_rank"))).select("request_id", "memory_id", "score", "rank")
    wanted = PROFILE if config.fix_keyword else [c for c in PROFILE if c != "content"]  # texts are read for a weight above 0 only
    rows = pool.join(memory.select(*wanted), "memory_id").join(requests.select("request_id", "role", "query"), "request_id")
    rows = features.with_features(rows, as_of, "query" if config.fix_keyword else None).withColumn("rerank", features.rounded(features.rerank_score(F.col("role"), config.fix_keyword), search.PLACES))
    rows = search.top_k(rows, ["request_id"], top, [F.col("rerank").desc(), F.col("pool_rank")], "rerank_rank")
    rows = rows.withColumn("score", features.rounded(0.5 * F.col("score") + 0.5 * F.col("rerank"), search.PLACES))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("score").desc(), "rerank_rank")))
    return rows.select("request_id", "memory_id", "score", "rank")


def triggers(requests: DataFrame, shared: DataFrame, min_count: int = 5, min_score: float = 0.3) -> DataFrame:
    """request_id, n, by_count, by_score, either."""
    per = shared.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("rank") <= 5, F.col("score"))).alias("top5"))
    rows = requests.select("request_id").join(per, "request_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.withColumn("by_count", F.col("n") < min_count).withColumn("by_score", (F.col("n") == 0) | (F.col("top5") < min_score))
    return rows.select("request_id", "n", "by_count", "by_score", (F.col("by_count") | F.col("by_score")).alias("either"))


def private_search(requests: DataFrame, memory: DataFrame, k: int = 20) -> DataFrame:
    """The first k rows of each private scope and memory type, lists one after another, each row once, the first k in all."""
    cells = requests.select("request_id", "qvec", F.col("policy.visibility").alias("asked"), "types", F.posexplode("private").alias("scope_pos", "scope"))
    cells = cells.select("request_id", "qvec", "asked", "scope_pos", "scope", F.posexplode("types").alias("type_pos", "type"))
    cells = cells.withColumn("unit", F.concat_ws("|", "request_id", "scope_pos", "type_pos"))
    u = cells.select("unit", "qvec", F.array("scope").alias("scopes"), F.array("type").alias("types"), "asked")
    found = search.search(u, memory, k).join(cells.select("unit", "request_id", "scope_pos", "type_pos"), "unit")
    first = Window.partitionBy("request_id", "memory_id").orderBy("scope_pos", "type_pos", "rank")
    found = found.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    rows = found.withColumn("at", F.row_number().over(Window.partitionBy("request_id").orderBy("scope_pos", "type_pos", "rank"))).where(F.col("at") <= k)
    return rows.select("request_id", "memory_id", "score", F.col("at").alias("rank"))


def first_stage(routed: DataFrame, requests: DataFrame, memory: DataFrame, as_of: Column, variant: str, config: Config) -> DataFrame:
    """request_id, memory_id, score, pool_rank of the shared buckets."""
    shared = routed.where("mode = 'shared'")
    members = shared.join(requests.select("request_id", "qvec"), "request_id")
    lead = shared.where("member_ord = 0").select("bucket", "scope", "types", "asked")
    if variant == "a5":
        rows = search.pool(lead, members.select("bucket", "member_ord", "qvec"), memory, as_of, config.shared_top_k, config.svd_rank, config.pool_mode)
    else:
        mean = search.mean_vectors(members.select("bucket", "qvec"))
        u = lead.join(mean, "bucket").select(F.col("bucket").alias("unit"), "qvec", F.array("scope").alias("scopes"), "types", "asked")
        rows = search.search(u, memory, config.shared_top_k).withColumnRenamed("unit", "bucket")
    return rows.select("bucket", "memory_id", "score", F.col("rank").alias("pool_rank")).join(shared.select("bucket", "request_id"), "bucket").drop("bucket")


def alone(requests: DataFrame, memory: DataFrame, k: int) -> DataFrame:
    """First stage of independent requests over all of their scopes."""
    keyed = routing.keyed(requests)
    u = search.units(keyed, F.col("all_scopes"), F.col("policy.visibility"))
    return search.search(u, memory, k).select(F.col("unit").alias("request_id"), "memory_id", "score", F.col("rank").alias("pool_rank"))


def route(requests: DataFrame, variant: str) -> DataFrame:
    if variant == "a5":
        return routing.hierarchical(requests)
    routed = routing.scope_only(requests)
    return routed if variant != "a1" else routed.withColumn("mode", F.lit("independent"))


def retrieve(requests: DataFrame, memory: DataFrame, as_of: Column, variant: str = "a5", config: Config = Config()) -> DataFrame:
    """request_id, ord, mode, bucket, memory_id, score, rank, origin, fallback; requests without a result have one row of
    nulls. Ordered by rank inside a request; use ord to order requests."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    variant = VARIANTS[variant]
    # a batch's routing and lists are small and read several times
    routed = checkpoint(route(requests, variant))
    solo = requests.join(routed.where("mode = 'independent'").select("request_id"), "request_id", "left_semi")
    shared = personalise(first_stage(routed, requests, memory, as_of, variant, config), requests, memory, as_of, config, config.enable_rerank and variant != "a3") if variant != "a1" else None
    own = personalise(alone(solo, memory, config.shared_top_k), requests, memory, as_of, config, config.enable_rerank)
    lists = checkpoint(own if shared is None else shared.unionByName(own))
    modes = routed.select("request_id", "mode", "bucket", "member_ord")
    if variant in ("a1", "a3") or not config.enable_fallback:
        fired = requests.select("request_id", F.lit(False).alias("fallback"))
        private = lists.limit(0)
    else:
        t = triggers(requests, lists, config.fallback_threshold, config.min_score if config.min_score is not None else 0.3)
        fired = t.select("request_id", F.col("by_count" if config.min_score is None else "either").alias("fallback"))
        asking = requests.join(fired.where("fallback").select("request_id"), "request_id", "left_semi")
        private = private_search(asking, memory, config.max_private)
    fused = fusion.reciprocal_rank(lists, private, k=config.rerank_top_k)
    out = requests.select("request_id", "ord").join(modes, "request_id").join(fired, "request_id").join(fused.select("request_id", "memory_id", "score", "rank", "origin"), "request_id", "left")
    return out.select("request_id", "ord", F.concat_ws("_", F.lit(variant), "mode").alias("mode"), F.when(F.col("mode") == "shared", F.col("bucket")).alias("bucket"), "memory_id", "score", "rank", "origin", "fallback")


def counters(results: DataFrame) -> DataFrame:
    """What a run did: requests, shared buckets, independents, first-stage searches, fallbacks."""
    per = results.groupBy("request_id").agg(F.first("bucket").alias("bucket"), F.first("fallback").alias("fallback"))
    return per.agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("bucket").alias("shared_buckets"), F.count_if(F.col("bucket").isNull()).alias("independent"), (F.count_distinct("bucket") + F.count_if(F.col("bucket").isNull())).alias("first_stage"), F.count_if("fallback").alias("fallbacks"))
