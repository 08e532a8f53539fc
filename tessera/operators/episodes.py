"""Episode construction: memory layers, agents and requests, ground truth, template artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Artifact slots, the layer, type and visibility that each is written with.
SLOTS = (
    ("plan", "task_shared_episodic", "episodic", "team"),
    ("query_intent", "agent_private", "working", "owner"),
    ("scratch", "agent_private", "working", "owner"),
    ("conclusion", "task_shared_episodic", "episodic", "team"),
    ("audit_report", "governed_restricted", "artifact", "restricted"),
)
# What each node type writes, in order.
NODE_SLOTS = {"PLANNER": ("query_intent", "scratch", "plan"), "SOLVER": ("query_intent", "scratch", "conclusion"), "VERIFIER": ("query_intent", "scratch", "audit_report")}
# Keys that the metadata of every artifact must have.
META_KEYS = ("slot", "scope_layer", "source_node_id", "hop_index", "topo_index", "parent_artifact_ids", "required_clearance", "is_gold_evidence", "dataset", "episode_id")
EPOCH = 1735689600


def scope_id(layer: Column, dataset: Column, episode: Column, node: Column) -> Column:
    return (
        F.when(layer == "workspace_semantic", F.concat(F.lit("workspace/"), dataset, F.lit("/semantic")))
        .when(layer == "task_shared_episodic", F.concat(F.lit("task/"), episode, F.lit("/shared")))
        .when(layer == "agent_private", F.concat(F.lit("task/"), episode, F.lit("/"), node, F.lit("/private")))
        .otherwise(F.concat(F.lit("task/"), episode, F.lit("/restricted")))
    )


def slot_table(nodes: DataFrame) -> DataFrame:
    spark = nodes.sparkSession
    layer = {s: (a, b, c) for s, a, b, c in SLOTS}
    rows = [(t, p, s, *layer[s]) for t, slots in NODE_SLOTS.items() for p, s in enumerate(slots)]
    return spark.createDataFrame(rows, "node_type string, slot_pos int, slot string, layer string, memory_type string, visibility string")


def artifacts(nodes: DataFrame, edges: DataFrame, key: list[str], topo: Column, dataset: Column) -> DataFrame:
    """nodes: key, node, node_type, hop, order (place in topological order), text. Three artifacts a node: one row each with its
    id, layer, scope, topo_index, parents (plan or conclusion of the parent nodes) and timestamp."""
    rows = nodes.join(F.broadcast(slot_table(nodes)), "node_type")
    episode = F.concat_ws("_", *(F.col(k).cast("string") for k in key))
    ident = lambda slot, node: F.concat_ws(":", episode, node, slot)
    kind = nodes.select(*key, F.col("node").alias("src"), F.col("node_type").alias("src_type"))
    parents = edges.join(kind, [*key, "src"]).select(*key, F.col("dst").alias("node"), ident(F.when(F.col("src_type") == "PLANNER", "plan").otherwise("conclusion"), F.col("src").cast("string")).alias("pid"))
    parents = parents.groupBy(*key, "node").agg(F.sort_array(F.collect_set("pid")).alias("parents"))
    rows = rows.join(parents, [*key, "node"], "left")
    index = (topo * 3 + F.col("slot_pos")).cast("int")
    return rows.select(
        *key, "node", "node_type", "slot", ident(F.col("slot"), F.col("node").cast("string")).alias("memory_id"), "layer", "memory_type", "visibility", scope_id(F.col("layer"), dataset, episode, F.col("node").cast("string")).alias("scope_id"),
        index.alias("topo_index"), F.coalesce("parents", F.array().cast("array<string>")).alias("parents"), F.timestamp_seconds(F.lit(EPOCH) + index).alias("created_at"),
        F.when(F.col("slot") == "audit_report", 3).otherwise(0).alias("required_clearance"), "text",
    )


def consumers(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, memory_id, consumed_by: ids of the artifacts that have it as parent."""
    return rows.select(*key, F.explode("parents").alias("parent"), "memory_id").groupBy(*key, F.col("parent").alias("of")).agg(F.sort_array(F.collect_set("memory_id")).alias("consumed_by")).withColumnRenamed("of", "memory_id")


def workspace_layer(items: DataFrame, dataset: str) -> DataFrame:
    """Gold and distractor paragraphs of raw items as public semantic rows."""
    part = lambda c, gold: items.select("original_id", F.explode(c).alias("p")).select("original_id", F.col("p.paragraph_id").alias("pid"), F.col("p.text").alias("content"), F.lit(1.0 if gold else 0.5).alias("confidence"), F.lit(gold).alias("is_gold"), F.col("p.hop_index").alias("hop"))
    both = part("supporting_paragraphs", True).unionByName(part("distractor_paragraphs", False))
    return both.select("*", F.lit(f"workspace/{dataset}/semantic").alias("scope_id"), F.lit("semantic").alias("memory_type"), F.array(F.lit("public")).alias("visibility"), F.lit("workspace_semantic").alias("layer"))


def task_shared_layer(solvers: DataFrame, items: DataFrame) -> DataFrame:
    """One team row for each solver whose hop has an item; of several items of a hop the first counts."""
    ex = items.select("original_id", F.posexplode("task_shared_items").alias("pos", "t"))
    first = ex.groupBy("original_id", F.col("t.hop_index").alias("hop")).agg(F.min_by("t", "pos").alias("t"))
    return solvers.join(first, ["original_id", "hop"]).select("original_id", "node", "hop", F.col("t.text").alias("content"), F.lit(1.0).alias("confidence"), F.lit("task_shared_episodic").alias("layer"), F.array(F.lit("team")).alias("visibility"))


def ground_truth(gold: DataFrame, access: DataFrame, agents: DataFrame, key: list[str]) -> DataFrame:
    """gold: key, memory_id, source_node (null: workspace) -> key, memory_id, required_by: agents whose accessible nodes
    hold the source; all agents for workspace rows."""
    by_node = gold.where("source_node IS NOT NULL").join(access.select(*key, "agent", F.col("reachable").alias("source_node")), [*key, "source_node"])
    everyone = gold.where("source_node IS NULL").join(agents.select(*key, "agent"), key)
    rows = by_node.select(*key, "memory_id", "agent").unionByName(everyone.select(*key, "memory_id", "agent"))
    return rows.groupBy(*key, "memory_id").agg(F.sort_array(F.collect_set("agent")).alias("required_by"))


def agents(nodes: DataFrame, key: list[str], dataset: Column) -> DataFrame:
    """key, agent, role, scopes, visibility, clearance, audit of each node's agent."""
    role = F.lower("node_type")
    episode = F.concat_ws("_", *(F.col(k).cast("string") for k in key))
    scope = lambda layer: scope_id(F.lit(layer), dataset, episode, F.col("node").cast("string"))
    verifier = role == "verifier"
    base = F.array(scope("workspace_semantic"), scope("task_shared_episodic"), scope("agent_private"))
    return nodes.select(
        *key, F.concat_ws("_", role, F.col("node").cast("string")).alias("agent"), role.alias("role"), F.when(verifier, F.array_append(base, scope("governed_restricted"))).otherwise(base).alias("scopes"),
        F.when(verifier, F.array(F.lit("team"), F.lit("restricted"))).otherwise(F.array(F.lit("team"), F.lit("public"))).alias("visibility"), F.when(verifier, 2).otherwise(1).alias("clearance"), verifier.alias("audit"),
    )


def episode_id(dataset: str, split: str, item: Column, kind: Column) -> Column:
    from tessera.functions.texts import slug

    return slug(F.concat_ws("_", F.lit(dataset), F.lit(split), item, kind))
