"""Four small retrieval cases whose outcome is known: full, partial and no overlap, and a policy conflict.

They are a self-test of a configuration: each is a memory and a batch of requests, and a variant's run over it is judged
like any other. Vectors are of the caller's embedder, or pseudo-random.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import embed
from tessera.operators import evaluation, retrieval
from tessera.session import checkpoint

TEAM, STRICT = (["team"], 1, ["quarantine", "audit_hold"], False), (["restricted"], 5, ["quarantine", "audit_hold"], True)
AT = "2025-01-01 00:00:00"
REQUEST = "ord int, request_id string, role string, query string, private array<string>, shared array<string>, workspace array<string>, governed array<string>, types array<string>, policy struct<visibility:array<string>,clearance:int,zones:array<string>,audit:boolean>, priority int"
MEMORY = "memory_id string, scope_id string, content string, visibility array<string>, confidence double"


@dataclass(frozen=True)
class Case:
    name: str
    memory: list[tuple]
    requests: list[tuple]
    gold: dict[str, str]
    conflicts: tuple[str, ...] = ()


def case(name: str, gold: list[tuple[str, str, str]], asked: list[tuple[str, str, str, str, str, tuple]], distract: tuple[str, ...], conflicts: tuple[str, ...] = ()) -> Case:
    """gold: id, scope, visibility; asked: agent, role, scope list (shared or private), scope, gold id, policy; a distractor for each
    scope named."""
    memory = [(f"{name}_{i}", s, f"{name} {i} evidence.", [v], 0.95) for i, s, v in gold] + [(f"{name}_off{k}", s, f"{name} distractor {k}", ["team"], 0.25) for k, s in enumerate(distract)]
    requests = [(k, f"{name}_{agent}", role, f"{name} {want} evidence", *([scope] if kind == side else [] for side in ("private", "shared")), [], [], ["semantic"], policy, 0) for k, (agent, role, kind, scope, want, policy) in enumerate(asked)]
    return Case(name, memory, requests, {f"{name}_{a[0]}": f"{name}_{a[4]}" for a in asked}, tuple(f"{name}_{c}" for c in conflicts))


def suite() -> list[Case]:
    s1, s2, s4, own = "task/s1/shared", "task/s2/shared", "task/s4/shared", "agent/private_s2/private"
    third = lambda a: f"task/s3/{a}/shared"
    trio = (("planner", "planner"), ("solver", "solver"), ("critic", "critic"))
    return [
        case("S1", [("g", s1, "team")], [(a, r, "shared", s1, "g", TEAM) for a, r in trio], (s1,)),
        case("S2", [("g", s2, "team"), ("p", own, "team")], [("planner", "planner", "shared", s2, "g", TEAM), ("solver", "solver", "shared", s2, "g", TEAM), ("private", "solver", "private", own, "p", TEAM)], (s2, own)),
        case("S3", [(f"g{k}", third(a), "team") for k, (a, _) in enumerate(trio)], [(a, r, "shared", third(a), f"g{k}", TEAM) for k, (a, r) in enumerate(trio)], tuple(third(a) for a, _ in trio)),
        case("S4", [("g", s4, "team"), ("r", s4, "restricted")], [("planner", "planner", "shared", s4, "g", TEAM), ("solver", "solver", "shared", s4, "g", TEAM), ("verifier", "verifier", "shared", s4, "r", STRICT)], (s4,), ("verifier",)),
    ]


def tables(spark: SparkSession, c: Case, dim: int = 64) -> tuple[DataFrame, DataFrame]:
    at = F.lit(AT).cast("timestamp")
    m = embed.embed(spark.createDataFrame(c.memory, MEMORY), "content", dim)
    m = m.withColumns({"memory_type": F.lit("semantic"), "created_at": at, "ttl": F.lit(None).cast("int"), "source": F.lit("unknown"), "parent_event": F.lit(""), "prov_agent": F.lit(""), "prov_at": F.lit(None).cast("timestamp"), "version": F.lit(1)})
    return m, embed.embed(spark.createDataFrame(c.requests, REQUEST), "query", dim, "qvec")


def evaluate(spark: SparkSession, variants=("a1", "a3", "a4", "a5"), k: int = 3, cases: list[Case] | None = None) -> DataFrame:
    """variant, case and the measures of each run; `evaluation.macro` sums them up by variant."""
    out = None
    for c in cases or suite():
        memory, requests = (checkpoint(t) for t in tables(spark, c))
        gold = spark.createDataFrame(list(c.gold.items()), "request_id string, memory_id string")
        marks = spark.createDataFrame([(x,) for x in c.conflicts], "request_id string")
        for v in variants:
            results = checkpoint(retrieval.retrieve(requests, memory, F.lit(AT).cast("timestamp"), v, retrieval.Config(fallback_threshold=2)))
            one = evaluation.report(results, gold, marks, k).withColumns({"variant": F.lit(v), "case": F.lit(c.name)})
            out = one if out is None else out.unionByName(one)
    return out
