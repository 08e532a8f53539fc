"""The facade: agents, requests, memory, retrieval and evaluation over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation, memory, retrieval, routing, search

# Scopes and memory types that a role starts with.
ROLE_TYPES = {"planner": ("semantic", "episodic", "working"), "solver": ("semantic", "episodic", "artifact"), "verifier": ("artifact", "episodic", "semantic"), "critic": ("episodic", "semantic")}


@dataclass
class Engine:
    """Plans that send rows to Python, or store tables on their way, bound the session's Arrow batches (`session.small_batches`), unless
    the session says how large they are."""

    spark: SparkSession
    memory: DataFrame
    config: retrieval.Config = retrieval.Config()
    agents: dict[str, dict] = field(default_factory=dict)

    def create_agent(self, agent_id: str, role: str = "custom", scopes: tuple[str, ...] = ("default",), types: tuple[str, ...] = (), visibility: tuple[str, ...] = ("team",), clearance: int = 3) -> dict:
        a = {"agent_id": agent_id, "role": role, "scopes": list(scopes), "types": list(types or ROLE_TYPES.get(role, ("semantic",))), "visibility": list(visibility), "clearance": clearance}
        self.agents[agent_id] = a
        return a

    def requests(self, asked: list[tuple[str, str, list[float]]]) -> DataFrame:
        """(agent_id, query, vector) of one batch; unknown agents are custom ones. No private scope unless the agent names it."""
        rows = []
        for k, (agent, query, vec) in enumerate(asked):
            a = self.agents.get(agent) or self.create_agent(agent)
            private = [s for s in a["scopes"] if s.endswith("/private")]
            rows.append((k, f"req_{agent}_{k}", agent, a["role"], query, vec, private, [s for s in a["scopes"] if s not in private], [], [], a["types"], (a["visibility"], a["clearance"], ["quarantine", "audit_hold"], False), 0))
        return self.spark.createDataFrame(rows, "ord int, request_id string, agent_id string, role string, query string, qvec array<double>, private array<string>, shared array<string>, workspace array<string>, governed array<string>, types array<string>, policy struct<visibility:array<string>,clearance:int,zones:array<string>,audit:boolean>, priority int")

    def warnings(self, requests: DataFrame) -> DataFrame:
        """request_id and what is wrong with it: empty query, no scopes."""
        empty = F.when(F.trim("query") == "", "empty query")
        none = F.when(F.size(F.concat("private", "shared", "workspace", "governed")) == 0, "no scopes")
        return requests.select("request_id", F.array_compact(F.array(empty, none)).alias("warnings"))

    def find(self, text: str, scopes: list[str] = (), types: list[str] = (), k: int = 20, embedder: Callable[[str], list[float]] | None = None) -> DataFrame:
        """The rows that are nearest to a text. Without an embedder the vector is zero, so every row scores 0 and ids decide."""
        return self.search(embedder(text) if embedder else [0.0], scopes, types, k)

    def search(self, vec: list[float], scopes: list[str] = (), types: list[str] = (), k: int = 50) -> DataFrame:
        u = self.spark.createDataFrame([("q", vec, list(scopes), list(types), None)], "unit string, qvec array<double>, scopes array<string>, types array<string>, asked array<string>")
        return search.search(u, self.memory, k).drop("unit")

    def retrieve(self, requests: DataFrame, as_of: str, variant: str = "a5") -> DataFrame:
        return retrieval.retrieve(requests, self.memory, F.lit(as_of).cast("timestamp"), variant, self.config)

    def route(self, requests: DataFrame) -> DataFrame:
        return routing.hierarchical(requests)

    def evaluate(self, requests: DataFrame, gold: DataFrame, conflicts: DataFrame, as_of: str, variants=("a1", "a3", "a4", "a5"), k: int = 10) -> DataFrame:
        return evaluation.compare({v: self.retrieve(requests, as_of, v) for v in variants}, gold, conflicts, k)

    def add(self, rows: DataFrame) -> None:
        self.memory = memory.upsert(self.memory.withColumn("_v", F.lit(0)), rows.withColumn("_v", F.lit(1)), "_v").drop("_v")

    def delete(self, ids: DataFrame) -> None:
        self.memory = memory.delete(self.memory, ids)

    def stats(self) -> DataFrame:
        return memory.statistics(self.memory)

    def tool_rows(self, results: DataFrame, k: int = 10) -> DataFrame:
        """What a tool call shows: the first rows with their text cut at 200 characters and the score at three places."""
        r = results.where(F.col("rank") <= k).join(self.memory.select("memory_id", "content", "scope_id", "memory_type"), "memory_id")
        return r.select("request_id", "rank", "memory_id", "scope_id", "memory_type", F.substring("content", 1, 200).alias("content"), F.format_string("%.3f", "score").alias("score"))
