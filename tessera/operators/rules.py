"""Invariants as data-quality queries: each rule gives issue rows; a report is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Slots of artifacts.
SLOTS = ("plan", "query_intent", "scratch", "conclusion", "audit_report")


def issues(rows: DataFrame, rule: str, severity: str, key: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), key.cast("string").alias("key"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def trace_rules(artifacts: DataFrame, nodes: DataFrame, graphs: DataFrame, key: list[str]) -> DataFrame:
    """Rules of an artifact trace. artifacts: key, memory_id, slot, layer, visibility, topo_index, parents, node, pos;
    graphs: key, graph_type."""
    ident = F.col("memory_id")
    dup = artifacts.groupBy(*key, "memory_id").count().where("count > 1")
    slot = artifacts.where(~F.coalesce(F.col("slot").isin(*SLOTS), F.lit(False)))
    back = artifacts.withColumn("_last", F.lag("topo_index").over(Window.partitionBy(*key).orderBy("pos"))).where("topo_index < _last")
    owner = artifacts.where(F.startswith("layer", F.lit("task_shared")) & (F.col("visibility") == "owner"))
    ids = artifacts.select(*key, F.col("memory_id").alias("parent")).distinct()
    dangling = artifacts.select(*key, "memory_id", F.explode("parents").alias("parent")).join(ids, [*key, "parent"], "left_anti")
    done = artifacts.where("slot = 'conclusion'").select(*key, "node").distinct()
    open_ = nodes.where("node_type = 'SOLVER'").join(done, [*key, "node"], "left_anti")
    audit = artifacts.where("slot = 'audit_report'").select(*key).distinct().withColumn("has", F.lit(True))
    g = graphs.join(audit, key, "left")
    k = F.concat_ws(":", *(F.col(x).cast("string") for x in key))
    return union(
        issues(dup, "unique_id", "error", ident), issues(slot, "slot", "error", ident), issues(back, "stream_order", "error", ident), issues(owner, "shared_not_owner", "error", ident), issues(dangling, "parent_exists", "error", ident),
        issues(open_, "solver_conclusion", "error", F.concat_ws(":", k, F.col("node").cast("string"))), issues(g.where("graph_type = 'POLICY_ISOLATED' AND has IS NULL"), "audit_missing", "error", k), issues(g.where("graph_type <> 'POLICY_ISOLATED' AND has"), "audit_unexpected", "warning", k),
    )


def audit_rules(artifacts: DataFrame, agents: DataFrame, key: list[str], mandatory: dict[str, Column]) -> DataFrame:
    """Rules over written episodes: ids unique over all episodes, clearances in range and reachable, mandatory fields."""
    ident = F.col("memory_id")
    twice = artifacts.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    range_ = artifacts.where("required_clearance NOT BETWEEN 0 AND 3")
    best = agents.groupBy(*key).agg(F.max("clearance").alias("clearance"))
    sealed = artifacts.join(best, key).where("required_clearance > clearance")
    missing = [issues(artifacts.where(c.isNull()), f"has_{name}", "error", ident) for name, c in mandatory.items()]
    return union(issues(twice, "unique_everywhere", "error", ident), issues(range_, "clearance_range", "error", ident), issues(sealed, "clearance_reachable", "warning", ident), *missing)


# Visibilities and roles that an agent may have.
VISIBILITY = ("owner", "team", "session", "public", "restricted")
ROLES = ("planner", "solver", "verifier", "custom")


def audit_episodes(rows: DataFrame, version: str = "1.0.0") -> DataFrame:
    """Rules over episodes as they are written, nested. All but two look at one episode at a time, so they are columns; ids that
    several episodes have and items with several questions or answers are aggregates. An empty result is a clean batch."""
    from tessera.operators.episodes import NODE_SLOTS
    from tessera.operators.graphs import GRAPH_TYPES

    e, nodes, agents, requests = F.col("memory_entries"), F.col("nodes"), F.col("agents"), F.col("retrieval_requests")
    known = F.transform(e, lambda x: x["memory_id"])
    any_ = lambda xs, f: F.coalesce(F.exists(xs, lambda x: F.coalesce(f(x), F.lit(False))), F.lit(False))
    isolated = F.col("graph_type") == "POLICY_ISOLATED"
    lacks = lambda x: any_(x, lambda i: ~F.array_contains(known, i))
    solver_hop = F.coalesce(F.array_max(F.transform(F.filter(nodes, lambda n: n["node_type"] == "SOLVER"), lambda n: F.coalesce(n["hop_index"], F.lit(0)))), F.lit(0))
    want = F.create_map(*[x for t, ss in NODE_SLOTS.items() for x in (F.lit(t), F.sort_array(F.array(*map(F.lit, ss))))])
    slots = lambda n: F.sort_array(F.array_distinct(F.transform(F.filter(e, lambda x: x["slot"].isNotNull() & (x["source_node_id"] == n["node_id"])), lambda x: x["slot"])))
    has_audit = any_(e, lambda x: x["slot"] == "audit_report")
    part = lambda n: F.sort_array(F.coalesce(n["produced_artifact_ids"], F.array().cast("array<string>")))
    checks = [
        ("enum", "error", ~(F.col("graph_type").isin(*GRAPH_TYPES) & F.col("reasoning_path_type").isin("GoT", "CoT", "ToT") & F.col("rho_subset").isin("S1", "S2", "S3", "S4"))),
        ("hop_count", "warning", (F.col("graph_type") == "LINEAR") & (solver_hop != F.col("hop_count"))),
        ("conflict", "error", isolated != F.coalesce("policy_conflict", F.lit(False))), ("s4_missing", "warning", isolated & ~F.coalesce("s4_eligible", F.lit(False))),
        ("node_type", "error", any_(nodes, lambda n: ~n["node_type"].isin("PLANNER", "SOLVER", "VERIFIER"))),
        ("unique_id", "error", F.size(F.array_distinct(known)) < F.size(known)), ("parent", "error", any_(e, lambda x: lacks(x["parent_artifact_ids"]))),
        ("shared_owner", "error", any_(e, lambda x: F.startswith(x["scope_layer"], F.lit("task_shared_")) & (x["visibility"] == "owner"))),
        ("agent_policy", "error", any_(agents, lambda a: a["policy"]["clearance"].isNull() | any_(a["policy"]["visibility"], lambda v: ~v.isin(*VISIBILITY)))), ("agent_role", "warning", any_(agents, lambda a: ~a["role"].isin(*ROLES))),
        ("query_empty", "warning", any_(requests, lambda r: F.coalesce(r["query"], F.lit("")) == "")), ("scope_lists", "error", any_(requests, lambda r: r["private"].isNull() | r["shared"].isNull() | r["workspace"].isNull() | r["governed"].isNull())),
        ("slots", "error", any_(nodes, lambda n: slots(n) != F.coalesce(F.element_at(want, n["node_type"]), F.array().cast("array<string>")))),
        ("metadata", "error", any_(e, lambda x: x["slot"].isNotNull() & (x["scope_layer"].isNull() | x["source_node_id"].isNull() | x["topo_index"].isNull() | x["required_clearance"].isNull() | x["is_gold_evidence"].isNull()))),
        ("version", "error", ~F.col("meta.schema_version").eqNullSafe(F.lit(version))),
        ("produced", "error", any_(nodes, lambda n: (F.sort_array(F.coalesce(F.map_values(n["produced_by_slot"]), F.array().cast("array<string>"))) != part(n)) | lacks(n["produced_artifact_ids"]))),
        ("clearance", "error", any_(e, lambda x: ~x["required_clearance"].between(0, 3))), ("audit", "error", has_audit != isolated),
        ("gold", "error", any_(F.col("ground_truth"), lambda g: ~F.array_contains(known, g["memory_id"]))),
        ("created_at", "error", (F.coalesce("meta.created_at", F.lit("")) != "") & ~F.contains("meta.created_at", F.lit("T"))), ("rollout", "error", F.coalesce("meta.rollout_llm", F.lit("")) == ""),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, c in checks]))
    own = rows.select("episode_id", F.explode(found).alias("f")).select("f.rule", "f.severity", F.col("episode_id").alias("key"))
    ids = rows.select("episode_id", F.explode(F.array_distinct(known)).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    told = rows.groupBy("original_id").agg(F.count_distinct(F.struct(F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit("")))).alias("n")).where("n > 1")
    return union(own, issues(ids, "unique_everywhere", "error", F.col("id")), issues(told, "divergent", "error", F.col("original_id")))


def batch_rules(episodes: DataFrame) -> DataFrame:
    """episodes: original_id, split, rho, label, s4, graph_type. Leakage between splits, placement of S4, label against rho."""
    from tessera.operators.graphs import label

    splits = episodes.groupBy("original_id").agg(F.collect_set("split").alias("s"))
    pair = lambda a, b: F.array_contains("s", a) & F.array_contains("s", b)
    leaks = [issues(splits.where(pair(a, b)), f"leak_{a}_{b}", "error", F.col("original_id")) for a, b in (("train", "test"), ("dev", "test"), ("train", "dev"))]
    return union(*leaks, issues(episodes.where("s4 AND split <> 'test'"), "s4_only_test", "error", F.col("original_id")), issues(episodes.where(label(F.col("rho")) != F.col("label")), "label_matches_rho", "error", F.col("original_id")))


def coverage(episodes: DataFrame, want=("S1", "S2", "S3")) -> DataFrame:
    """Labels of `want` without an episode; empty is good."""
    have = episodes.select("label").distinct()
    return episodes.sparkSession.createDataFrame([(w,) for w in want], "label string").join(have, "label", "left_anti")


def mean_of(rho: str) -> Column:
    """The mean of values of four decimals, to four decimals, from whole numbers, so that ties don't depend on the order of additions."""
    return F.bround(F.sum(F.round(F.col(rho) * 10000).cast("long")) / F.count(rho)) / 10000


def statistics(episodes: DataFrame) -> DataFrame:
    """label, n and moments of rho; the deviation is that of the population."""
    return episodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), mean_of("rho").alias("mean"), F.bround(F.stddev_pop("rho"), 4).alias("std"), F.min("rho").alias("low"), F.max("rho").alias("high"))


def stratified(rows: DataFrame, by: str | None, ident: str, ratio: float, seed: str) -> DataFrame:
    """The first max(1, floor(n * ratio)) of each stratum, or of all rows without one, in an order that only depends on seed and
    id; no stratum is ever in one task."""
    from tessera.operators.search import numbered

    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(ident).cast("string")))
    at = numbered(rows.withColumn("_order", order), [by] if by else [], ["_order", ident], "_at")
    return at.where(F.col("_at") <= F.greatest(F.lit(1), F.floor(F.col("n") * ratio))).drop("n", "_at", "_order")


def exclusive_draw(rows: DataFrame, n: int, ident: str = "episode_id", stratum: str = "label", seed: int = 42) -> DataFrame:
    """n rows, as many of each stratum as there are turns: each stratum is shuffled by a hash of seed and id, and strata take turns,
    in their order; one that has no rows left is passed over, so the others make up for it. What is drawn belongs to no stratum any more:
    `without` the drawn ids is an anti-join. Rows of a null stratum are one stratum; of equal ids all are rows."""
    from tessera.operators.search import numbered

    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string")))
    own = F.to_json(F.struct(F.col(stratum).alias("s")))  # a key that is never null
    nth = numbered(rows.withColumn("_order", order).withColumn("_own", own), ["_own"], ["_order", ident], "_nth").drop("n", "_order")
    return numbered(nth.withColumn("_all", F.lit(0)), ["_all"], ["_nth", "_own"], "_turn").where(F.col("_turn") <= n).drop("n", "_nth", "_own", "_all", "_turn")


def registry(rows: DataFrame, dev: DataFrame, ident: str, rest: str = "train") -> DataFrame:
    """ident, split: dev for those that were drawn, else `rest`."""
    return rows.join(dev.select(F.col(ident).alias("_dev")).distinct(), F.col(ident) == F.col("_dev"), "left").select(ident, F.when(F.col("_dev").isNotNull(), "dev").otherwise(rest).alias("split"))


def contract(rows: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Artifacts whose metadata, a map, lacks keys that it must have: memory_id, missing."""
    from tessera.operators.episodes import META_KEYS

    missing = F.array_except(F.array(*map(F.lit, META_KEYS)), F.coalesce(F.map_keys(metadata), F.array().cast("array<string>")))
    return rows.select("memory_id", F.sort_array(missing).alias("missing")).where(F.size("missing") > 0)


def slot_sets(artifacts: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """Nodes whose slots are not exactly those that their type writes: key, node, slots, expected."""
    from tessera.operators.episodes import NODE_SLOTS

    want = F.create_map(*[x for t, ss in NODE_SLOTS.items() for x in (F.lit(t), F.sort_array(F.array(*map(F.lit, ss))))])
    have = artifacts.groupBy(*key, "node").agg(F.sort_array(F.collect_set("slot")).alias("slots"))
    rows = nodes.join(have, [*key, "node"], "left").withColumn("slots", F.coalesce("slots", F.array().cast("array<string>"))).withColumn("expected", F.element_at(want, F.col("node_type")))
    return rows.where("slots <> expected").select(*key, "node", "slots", "expected")


def policy_rules(episodes: DataFrame, agents: DataFrame, memory: DataFrame, key: list[str], keyed: bool = False) -> DataFrame:
    """Rules of episodes before they are written; with keyed, each issue carries its episode's key too. episodes: key, graph_type, s4, hops, rho, answer; agents: key, agent, role, scopes,
    clearance, restricted_scope; memory: key, memory_id, layer, required_clearance, content, embedding."""
    also = key if keyed else []
    k = F.concat_ws(":", *(F.col(x).cast("string") for x in key))

    def broken(rows: DataFrame, ident: Column, *checks: tuple[str, Column], severity: str = "error") -> DataFrame:  # one pass over rows
        found = F.array_compact(F.array(*[F.when(c, F.lit(rule)) for rule, c in checks]))
        return rows.select(*also, ident.cast("string").alias("key"), F.explode(found).alias("rule")).select(*also, "rule", F.lit(severity).alias("severity"), "key")

    sealed = F.array_contains("scopes", F.col("restricted_scope"))
    verifier = F.col("role") == "verifier"
    per = agents.groupBy(*key).agg(F.bool_or(verifier).alias("has_verifier"), F.count(F.lit(1)).alias("agents"))
    layers = memory.groupBy(*key).agg(F.bool_or(F.startswith("layer", F.lit("workspace_semantic"))).alias("workspace"))
    ep = episodes.join(per, key, "left").join(layers, key, "left").withColumn("has_verifier", F.coalesce("has_verifier", F.lit(False)))
    isolated = F.col("graph_type") == "POLICY_ISOLATED"
    open_layers = F.startswith("layer", F.lit("workspace_semantic")) | (F.col("layer") == "task_shared_episodic")
    leaks = memory.where(open_layers).join(episodes.select(*key, F.trim("answer").alias("answer")).where(F.char_length("answer") >= 2), key)
    return union(
        broken(
            ep, k, ("workspace_empty", ~F.coalesce("workspace", F.lit(False))), ("verifier_missing", (F.col("s4") | isolated) & ~F.col("has_verifier")), ("verifier_unexpected", F.col("has_verifier") & ~isolated),
            ("rho_range", ~F.col("rho").between(0, 1)), ("agent_count", F.coalesce("agents", F.lit(0)) < F.col("hops") + 1),
        ),
        broken(
            agents, F.col("agent"), ("agent_scopes", F.size("scopes") == 0), ("verifier_scope", verifier & ~sealed), ("other_scope", ~verifier & sealed), ("agent_clearance", F.col("clearance") != F.when(verifier, 2).otherwise(1)),
        ),
        broken(memory, F.col("memory_id"), ("restricted_clearance", (F.col("layer") == "restricted") & (F.col("required_clearance") != 2)), ("embedding_null", F.col("embedding").isNotNull())),
        broken(memory.groupBy(*key, "memory_id").count(), F.col("memory_id"), ("unique_id", F.col("count") > 1)),
        broken(leaks, F.col("memory_id"), ("answer_leak", F.contains("content", F.col("answer"))), severity="warning"),
    )


def quality_gate(episodes: DataFrame, s1: float = 0.6, s2: float = 0.4) -> DataFrame:
    """episodes: label, rho, n_gold. rule, severity, key: episodes without ground truth; a small S3 share; label means out of band."""
    a = episodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("rho").alias("mean"), F.count_if(F.coalesce("n_gold", F.lit(0)) == 0).alias("bare"))
    total = F.sum("n").over(Window.partitionBy())
    a = a.withColumn("share", F.col("n") / total)
    inside = F.when(F.col("label") == "S1", F.col("mean") > s1).when(F.col("label") == "S2", (F.col("mean") > s2) & (F.col("mean") <= s1)).when(F.col("label") == "S3", F.col("mean") <= s2).otherwise(True)
    few = a.agg(F.coalesce(F.max(F.when(F.col("label") == "S3", F.col("share"))), F.lit(0.0)).alias("share"), F.count(F.lit(1)).alias("labels")).where("labels > 0 AND share <= 0.05")
    return union(issues(a.where("bare > 0"), "ground_truth", "error", F.col("label")), issues(few, "s3_share", "warning", F.lit("S3")), issues(a.where(~inside), "rho_band", "warning", F.col("label")))
