"""Episodes from items: graphs, memory layers, agents, requests, ground truth, checks, and the nested rows that are written.

An episode is an item under a graph type. All that depends on (graph_type, hops) alone - nodes, closure, overlap, who
needs a node - is worked out once for each such pair and joined; nothing is closed per episode. Episodes that break a rule go
to a quarantine table with the rules they break, instead of being dropped without a trace.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import templates as T
from tessera.functions import texts
from tessera.operators import episodes as E
from tessera.operators import graphs, rules
from tessera.session import checkpoint
from tessera.sources import readers

KEY = ["episode_id"]
TEMPLATE = ["graph_type", "hops"]
VERSION = "1.0.0"
# Memory types that a node's agent may read.
TYPES = {"PLANNER": ("episodic", "semantic"), "SOLVER": ("episodic", "semantic", "artifact"), "VERIFIER": ("episodic", "semantic")}
ZONES = ("quarantine", "audit_hold")
# What a verifier asks for, by data set and kind; the first is for all others.
CREDIBILITY = "Verify the credibility of each hop's supporting evidence and temporal consistency of the reasoning chain."
VERIFY = {
    "musique": CREDIBILITY,
    "hotpotqa": CREDIBILITY,
    "2wikimhqa_bridge": CREDIBILITY,
    "2wikimhqa_comparison": "Verify that the comparison evidence for both entities is authoritative and non-conflicting.",
    "2wikimhqa_bridge-comparison": "Verify the logical consistency of the reasoning steps and completeness of the evidence.",
    "2wikimhqa_bridge_comparison": "Verify the logical consistency of the reasoning steps and completeness of the evidence.",
    "gsm8k": "Verify that each step's numeric result is consistent with the gold intermediate values.",
    "math_algebra": "Verify equation transformations across steps and numeric self-consistency.",
    "math_geometry": "Verify the correctness of geometric relations and property citations.",
    "math_number_theory": "Verify the application of divisibility, congruence and similar properties.",
    "math_counting_and_probability": "Verify sample-space completeness and probability calculation correctness.",
    "math_intermediate_algebra": "Verify algebraic transformations and equation-solving consistency.",
    "math_prealgebra": "Verify basic arithmetic and quantitative relationships.",
    "math_precalculus": "Verify applications of functions, limits and trigonometric identities.",
}
# Fixed value: what a planner asks before a problem of mathematics.
PLAN_MATH = "Plan the solution steps for the problem: "


@dataclass(frozen=True)
class Parts:
    """The tables of a batch of episodes, by episode_id."""

    episodes: DataFrame
    nodes: DataFrame
    edges: DataFrame
    memory: DataFrame
    agents: DataFrame
    requests: DataFrame
    gold: DataFrame


def targets(items: DataFrame, split: Column, kinds=graphs.GRAPH_TYPES) -> DataFrame:
    """Every item under every graph type, with episode_id, hops and s4."""
    rows = items.withColumn("split", split).withColumn("graph_type", F.explode(F.array(*map(F.lit, kinds)))).withColumn("hops", F.greatest(F.coalesce("hop_count", F.lit(2)), F.lit(2)))
    ident = F.concat_ws("_", *(texts.slug(F.col(c)) for c in ("dataset", "split", "original_id")), F.col("graph_type"))
    return rows.withColumn("episode_id", ident).withColumn("s4", F.col("graph_type") == "POLICY_ISOLATED")


def reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_type, hops, node, accessible (itself and what is above it, in order), needed_by (the nodes that can access it)."""
    own = nodes.select(*TEMPLATE, "node", F.col("node").alias("other"))
    up = graphs.ancestors(edges, TEMPLATE).select(*TEMPLATE, "node", F.col("ancestor").alias("other"))
    both = checkpoint(own.unionByName(up).distinct())
    down = both.groupBy(*TEMPLATE, "other").agg(F.sort_array(F.collect_list("node")).alias("needed_by")).withColumnRenamed("other", "node")
    return both.groupBy(*TEMPLATE, "node").agg(F.sort_array(F.collect_list("other")).alias("accessible")).join(down, [*TEMPLATE, "node"])


def query(node_type: Column, hop: Column) -> Column:
    """What a node's agent asks: the question, the hop's sub-question or step (the last for hops beyond), or a check."""
    question, math = F.coalesce("question", F.lit("")), F.col("dataset") == "math"
    nth = lambda c: F.get(c, F.least(F.coalesce(hop, F.lit(1)), F.size(c)) - 1)
    step = nth(F.col("solution_steps"))
    head = texts.first_sentence(step)
    solver = F.when(math & (F.size("solution_steps") > 0), F.when(head != "", head).otherwise(step)).when(F.size("sub_questions") > 0, nth(F.col("sub_questions"))).otherwise(question)
    known = F.create_map(*[F.lit(x) for kv in VERIFY.items() for x in kv])
    kind = F.when(F.col("dataset") == "2wikimhqa", F.concat(F.lit("2wikimhqa_"), "qa_type")).when(math, F.concat(F.lit("math_"), "math_category"))
    verifier = F.coalesce(F.element_at(known, F.coalesce(kind, F.lit(""))), F.element_at(known, F.col("dataset")), F.lit(CREDIBILITY))
    return F.when(node_type == "PLANNER", F.when(math, F.concat(F.lit(PLAN_MATH), question)).otherwise(question)).when(node_type == "SOLVER", solver).otherwise(verifier)


def agents_of(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Agents and their requests, one of each for every node."""
    verifier = F.col("node_type") == "VERIFIER"
    scope = lambda layer: E.scope_id(F.lit(layer), F.col("dataset"), F.col("episode_id"), F.col("node"))
    base = F.array(scope("workspace_semantic"), scope("task_shared_episodic"), scope("agent_private"))
    strings = lambda xs: F.array(*map(F.lit, xs))
    types = F.when(F.col("node_type") == "SOLVER", strings(TYPES["SOLVER"])).otherwise(strings(TYPES["PLANNER"]))
    policy = F.struct(F.when(verifier, strings(("team", "restricted"))).otherwise(strings(("team", "public"))).alias("visibility"), F.when(verifier, 2).otherwise(1).alias("clearance"), strings(ZONES).alias("zones"), verifier.alias("audit"))
    rows = nodes.select(
        *KEY, F.concat_ws("_", "episode_id", "node").alias("agent"), F.lower("node_type").alias("role"), "node", "hop", "node_ord", "accessible", F.when(verifier, F.array_append(base, scope("restricted"))).otherwise(base).alias("scopes"),
        types.alias("types"), policy.alias("policy"), policy["clearance"].alias("clearance"), scope("restricted").alias("restricted_scope"), query(F.col("node_type"), F.col("hop")).alias("query"), verifier.alias("_v"),
        scope("agent_private").alias("_private"), scope("task_shared_episodic").alias("_shared"), scope("workspace_semantic").alias("_workspace"),
    )
    none = F.array().cast("array<string>")
    requests = rows.select(*KEY, F.concat(F.lit("req_"), "agent").alias("request_id"), "agent", "role", "query", F.array("_private").alias("private"), F.array("_shared").alias("shared"), F.array("_workspace").alias("workspace"), F.when(F.col("_v"), F.array("restricted_scope")).otherwise(none).alias("governed"), "types", "policy", F.lit(0).alias("priority"))
    return rows.drop("query", "_v", "_private", "_shared", "_workspace"), requests


def memory_of(episodes: DataFrame, nodes: DataFrame, restricted: DataFrame | None) -> DataFrame:
    """The layers of each episode: paragraphs, what solvers share, a private placeholder for each node, and for
    policy-isolated graphs the restricted records of the item (original_id, content, confidence, source, metadata)."""
    columns = ["episode_id", "graph_type", "hops", "dataset", "layer", "place", "memory_type", "content", "visibility", "confidence", "source", "writer", "tags", "clearance", "gold", "source_node", "paragraph", "hop"]
    tags = lambda *xs: F.array(*[F.lit(x) for x in xs], F.col("dataset"))
    text = lambda x: F.lit(x).cast("string")

    def paragraphs(column: str, gold: bool) -> DataFrame:
        p = episodes.select(*KEY, *TEMPLATE, "dataset", F.posexplode(column).alias("k", "p"))
        return p.select(*KEY, *TEMPLATE, "dataset", F.lit("workspace_semantic").alias("layer"), F.concat(F.lit("g" if gold else "d"), F.col("k").cast("string")).alias("place"), F.lit("semantic").alias("memory_type"), F.coalesce("p.text", F.lit("")).alias("content"), F.lit("public").alias("visibility"), F.lit(1.0 if gold else 0.5).alias("confidence"), F.col("p.paragraph_id").alias("source"), text(None).alias("writer"), tags("workspace", "semantic").alias("tags"), F.lit(0).alias("clearance"), F.lit(gold).alias("gold"), text(None).alias("source_node"), F.col("p.paragraph_id").alias("paragraph"), (F.col("p.hop_index") if gold else F.lit(None)).cast("int").alias("hop"))

    agent = F.concat_ws("_", "episode_id", "node")
    item = F.get(F.filter("task_shared_items", lambda x: x["hop_index"] == F.col("hop")), F.lit(0))
    shared = nodes.where("node_type = 'SOLVER' AND hop IS NOT NULL").withColumn("item", item).withColumn("told", F.trim("item.text")).where("told <> ''")
    shared = shared.select(*KEY, *TEMPLATE, "dataset", F.lit("task_shared_episodic").alias("layer"), F.col("node").alias("place"), F.lit("episodic").alias("memory_type"), F.col("told").alias("content"), F.lit("team").alias("visibility"), F.lit(1.0).alias("confidence"), F.coalesce("item.source_paragraph_id", F.concat(F.lit("hop_"), F.col("hop").cast("string"))).alias("source"), agent.alias("writer"), F.array(F.lit("task_shared"), F.lit("episodic"), F.col("dataset"), F.concat(F.lit("hop_"), F.col("hop").cast("string"))).alias("tags"), F.lit(0).alias("clearance"), F.lit(True).alias("gold"), F.col("node").alias("source_node"), F.coalesce("item.source_paragraph_id", F.concat(F.lit("hop_"), F.col("hop").cast("string"))).alias("paragraph"), "hop")
    private = nodes.select(*KEY, *TEMPLATE, "dataset", F.lit("agent_private").alias("layer"), F.col("node").alias("place"), F.lit("episodic").alias("memory_type"), F.concat(F.lit("[placeholder: "), agent, F.lit("_private_reasoning]")).alias("content"), F.lit("owner").alias("visibility"), F.lit(0.0).alias("confidence"), F.lit("placeholder").alias("source"), agent.alias("writer"), tags("agent_private", "placeholder").alias("tags"), F.lit(0).alias("clearance"), F.lit(False).alias("gold"), F.col("node").alias("source_node"), text(None).alias("paragraph"), F.lit(None).cast("int").alias("hop"))
    parts = [paragraphs("supporting_paragraphs", True), paragraphs("distractor_paragraphs", False), shared, private]
    if restricted is not None:
        r = restricted.groupBy("original_id").agg(F.array_sort(F.collect_list(F.struct("source", "content", "confidence", F.array_sort(F.map_entries("metadata")).alias("more")))).alias("rs"))
        sealed = episodes.where("s4").join(r, "original_id").select(*KEY, *TEMPLATE, "dataset", F.posexplode("rs").alias("k", "r")).withColumn("more", F.map_from_entries("r.more"))
        extra = lambda k, default: F.coalesce(F.element_at("more", k), default)
        parts.append(sealed.select(*KEY, *TEMPLATE, "dataset", F.lit("restricted").alias("layer"), F.concat(F.lit("r"), F.col("k").cast("string")).alias("place"), F.lit("episodic").alias("memory_type"), F.coalesce("r.content", F.lit("")).alias("content"), F.lit("restricted").alias("visibility"), F.coalesce("r.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("r.source", F.lit("")).alias("source"), extra("writer_agent_id", F.lit("verifier")).alias("writer"), tags("restricted").alias("tags"), extra("required_clearance", F.lit("2")).cast("int").alias("clearance"), F.lit(False).alias("gold"), extra("source_node_id", F.lit("verifier")).alias("source_node"), extra("source_paragraph_id", F.col("r.source")).alias("paragraph"), F.lit(None).cast("int").alias("hop")))
    rows = rules.union(*(p.select(*columns) for p in parts))
    return rows.withColumn("memory_id", F.concat_ws(":", "episode_id", "layer", "place")).withColumn("scope_id", E.scope_id(F.col("layer"), F.col("dataset"), F.col("episode_id"), F.col("source_node")))


def ground_truth(memory: DataFrame, nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Gold rows and the agents that need them: all for paragraphs, else those that can access the row's node."""
    everyone = nodes.groupBy(*TEMPLATE).agg(F.sort_array(F.collect_list("node")).alias("all"))
    some = reached.select(*TEMPLATE, F.col("node").alias("source_node"), "needed_by")
    rows = memory.where("gold AND layer IN ('workspace_semantic', 'task_shared_episodic')").join(everyone, TEMPLATE).join(some, [*TEMPLATE, "source_node"], "left")
    who = F.when(F.col("layer") == "workspace_semantic", F.col("all")).otherwise(F.coalesce("needed_by", F.array().cast("array<string>")))
    return rows.select(*KEY, "memory_id", "layer", "hop", F.transform(who, lambda n: F.concat_ws("_", "episode_id", n)).alias("required_by"), F.lit("shared_required").alias("evidence_type"))


def build(items: DataFrame, split: Column, kinds=graphs.GRAPH_TYPES, restricted: DataFrame | None = None, store: bool = False, reasoning: str = "GoT") -> Parts:
    """All parts of all episodes, unchecked. Paths of reasoning other than GoT have one kind of graph each. With `store`, memory, agents and requests are made once, as tables; that is for those who
    read them more than once. Episodes always are."""
    keep = checkpoint if store else lambda rows: rows
    if reasoning not in graphs.REASONING:
        raise ValueError(f"unknown path of reasoning {reasoning!r}")
    one = graphs.REASONING[reasoning]
    ep = targets(items, split, kinds if one is None else (one,)).withColumn("reasoning", F.lit(reasoning))
    t_nodes, t_edges = (checkpoint(t) for t in graphs.templates_of(ep))
    reached = checkpoint(reach(t_nodes, t_edges))
    rho = checkpoint(graphs.rho_v3(t_nodes, t_edges, TEMPLATE))
    ep = checkpoint(ep.join(rho, TEMPLATE).withColumn("label", graphs.label(F.col("rho"))))
    nodes = ep.join(t_nodes, TEMPLATE).join(reached.select(*TEMPLATE, "node", "accessible"), [*TEMPLATE, "node"])
    agents, requests = (keep(t) for t in agents_of(nodes))
    memory = keep(memory_of(ep, nodes, restricted))
    edges = ep.select(*KEY, *TEMPLATE).join(t_edges, TEMPLATE).select(*KEY, "src", "dst", "edge_type")
    return Parts(ep, nodes.select(*KEY, *TEMPLATE, "node", "node_type", "hop", "node_ord", "accessible"), edges, memory, agents, requests, ground_truth(memory, t_nodes, reached))


def check(parts: Parts) -> tuple[DataFrame, DataFrame]:
    """Issues of each episode, and the quarantine: episode_id and the rules that it breaks; warnings don't count."""
    e = parts.episodes.select(*KEY, "graph_type", "s4", "hops", "rho", "answer")
    a = parts.agents.select(*KEY, "agent", "role", "scopes", "clearance", "restricted_scope")
    m = parts.memory.select(*KEY, "memory_id", "layer", F.col("clearance").alias("required_clearance"), "content", F.lit(None).cast("array<float>").alias("embedding"))
    found = rules.policy_rules(e, a, m, KEY, keyed=True)
    bad = found.where("severity = 'error'").groupBy(*KEY).agg(F.sort_array(F.collect_set("rule")).alias("rules"))
    return found, bad


def without(parts: Parts, bad: DataFrame) -> Parts:
    """The parts of episodes that are not in quarantine."""
    ids = bad.select(*KEY)
    return Parts(*(getattr(parts, f).join(ids, KEY, "left_anti") for f in Parts.__dataclass_fields__))


def artifacts(parts: Parts) -> DataFrame:
    """What each node writes, three rows a node, with template texts: first the planner's, then the solvers' so that a node's
    parents precede it, by level and place in the graph, then the verifier's, which has every conclusion as a parent. A
    conclusion is gold if the item tells what its hop found. Levels are worked out once for each template."""
    known = parts.episodes.select(*TEMPLATE).distinct()
    t_nodes, t_edges = (checkpoint(t) for t in graphs.templates_of(known))
    kind = F.when(F.col("node_type") == "PLANNER", 0).when(F.col("node_type") == "SOLVER", 1).otherwise(2)
    level = graphs.levels(t_nodes, t_edges, TEMPLATE).join(t_nodes.select(*TEMPLATE, "node", "node_type", "node_ord"), [*TEMPLATE, "node"])
    at = F.row_number().over(Window.partitionBy(*TEMPLATE).orderBy(kind, "level", "node_ord")) - 1
    level = checkpoint(level.select(*TEMPLATE, "node", "node_type", at.alias("at")))
    solvers = level.where("node_type = 'SOLVER'").groupBy(*TEMPLATE).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"]).alias("solvers"))
    item = parts.episodes.select(*KEY, *TEMPLATE, "dataset", "question", "sub_questions", "task_shared_items", "supporting_paragraphs", "hop_count").join(solvers, TEMPLATE, "left")
    nodes = parts.nodes.join(level.select(*TEMPLATE, "node", "at"), [*TEMPLATE, "node"]).join(parts.episodes.select(*KEY, "dataset"), KEY).withColumn("text", F.lit(""))
    rows = E.artifacts(nodes, parts.edges, KEY, F.col("at"), F.col("dataset")).drop("text").join(parts.nodes.select(*KEY, "node", "hop"), [*KEY, "node"]).join(item, KEY)
    found = T.gold(F.col("task_shared_items"), F.col("supporting_paragraphs"), F.col("hop"))
    said = F.transform("solvers", lambda n: T.conclusion(T.gold(F.col("task_shared_items"), F.col("supporting_paragraphs"), F.regexp_extract(n, "([0-9]+)", 1).cast("int")), n, F.regexp_extract(n, "([0-9]+)", 1)))
    asked = T.ask(F.col("sub_questions"), F.col("hop"), F.coalesce("question", F.lit("")))
    slot = F.col("slot")
    text = F.when(slot == "plan", T.plan(F.coalesce("question", F.lit("")), F.col("sub_questions"), F.col("hop_count"))).when(slot == "conclusion", T.conclusion(found, F.col("node"), F.col("hop"))).when(slot == "audit_report", T.audit(F.col("dataset"), said))
    text = text.otherwise(T.artifact(F.col("node_type"), slot, F.coalesce("question", F.lit("")), F.col("node"), F.col("hop"), asked))
    concluded = F.transform("solvers", lambda n: F.concat_ws(":", "episode_id", n, F.lit("conclusion")))
    gold = (slot == "conclusion") & (F.coalesce(found, F.lit("")) != "")
    return rows.withColumns({"text": text, "gold": gold, "confidence": F.when(gold, 1.0).otherwise(0.8), "parents": F.when(F.col("node_type") == "VERIFIER", concluded).otherwise(F.col("parents"))}).drop(*TEMPLATE, "question", "sub_questions", "task_shared_items", "supporting_paragraphs", "hop_count", "solvers")


def nested(parts: Parts, made: DataFrame | None = None, created_at: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One row an episode, as it is written. `made`, artifacts, stand among the entries, and nodes carry the ids of theirs;
    embeddings are never written."""
    gather = lambda rows, order, *fields: rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("xs"))
    nodes, produced = parts.nodes, F.array().cast("array<struct<slot:string,id:string>>")
    none = F.lit(None)
    memory = parts.memory.withColumns({"slot": none.cast("string"), "topo_index": none.cast("int"), "parents": none.cast("array<string>")})
    if made is not None:
        own = made.groupBy(*KEY, "node").agg(F.array_sort(F.collect_list(F.struct("topo_index", "slot", F.col("memory_id").alias("id")))).alias("made"))
        nodes = nodes.join(own, [*KEY, "node"], "left")
        produced = F.coalesce(F.transform("made", lambda x: F.struct(x["slot"].alias("slot"), x["id"].alias("id"))), produced)
        more = made.select(*KEY, "memory_id", "scope_id", "memory_type", F.col("text").alias("content"), "visibility", "confidence", F.lit("template:v1").alias("source"), F.concat_ws("_", "episode_id", "node").alias("writer"), F.array(F.lit("rollout"), F.col("slot"), F.col("dataset")).alias("tags"), "layer", F.col("required_clearance").alias("clearance"), "gold", F.col("node").alias("source_node"), none.cast("string").alias("paragraph"), "hop", "slot", "topo_index", "parents")
        memory = memory.select(*more.columns).unionByName(more)
    nodes = gather(nodes.withColumn("produced", produced), "node_ord", F.col("node").alias("node_id"), "node_type", F.col("hop").alias("hop_index"), "produced")
    # arrays of maps can't be sorted, so nodes get theirs afterwards
    nodes = nodes.select(*KEY, F.transform("xs", lambda x: F.struct(x["node_id"].alias("node_id"), x["node_type"].alias("node_type"), F.lower(x["node_type"]).alias("agent_role"), x["hop_index"].alias("hop_index"), F.transform(x["produced"], lambda p: p["id"]).alias("produced_artifact_ids"), F.map_from_entries(x["produced"]).alias("produced_by_slot"))).alias("nodes"))
    edges = gather(parts.edges, "src", "dst", "edge_type").select(*KEY, F.transform("xs", lambda x: F.struct(x["src"].alias("from_node"), x["dst"].alias("to_node"), x["edge_type"].alias("edge_type"))).alias("edges"))
    agents = gather(parts.agents, "node_ord", "agent", "role", "node", "scopes", "types", "policy", "accessible")
    agents = agents.select(*KEY, F.transform("xs", lambda x: F.struct(x["agent"].alias("agent_id"), x["role"].alias("role"), x["node"].alias("name"), x["scopes"].alias("allowed_scopes"), x["types"].alias("allowed_memory_types"), x["policy"].alias("policy"), x["accessible"].alias("accessible_ancestor_node_ids"))).alias("agents"))
    entries = gather(memory, "memory_id", "scope_id", "memory_type", "content", "visibility", "confidence", "source", "writer", "tags", F.col("layer").alias("scope_layer"), F.col("clearance").alias("required_clearance"), F.col("gold").alias("is_gold_evidence"), F.col("source_node").alias("source_node_id"), F.col("paragraph").alias("source_paragraph_id"), F.col("hop").alias("hop_index"), "slot", "topo_index", F.col("parents").alias("parent_artifact_ids"))
    requests = gather(parts.requests, "request_id", F.col("agent").alias("agent_id"), "role", "query", "private", "shared", "workspace", "governed", "types", "policy", "priority")
    gold = gather(parts.gold, "memory_id", F.col("layer").alias("scope_layer"), F.col("hop").alias("hop_index"), F.col("required_by").alias("required_by_agent_ids"), "evidence_type")
    out = parts.episodes.select(*KEY, "dataset", "split", "original_id", "hop_count", "graph_type", F.col("reasoning").alias("reasoning_path_type"), "rho", F.col("label").alias("rho_subset"), F.col("s4").alias("policy_conflict"), F.col("s4").alias("s4_eligible"), "question", "answer")
    for more, name in ((nodes, "nodes"), (edges, "edges"), (agents, "agents"), (entries, "memory_entries"), (requests, "retrieval_requests"), (gold, "ground_truth")):
        out = out.join(more.withColumnRenamed("xs", name), KEY, "left")
    return out.withColumn("meta", F.struct(F.lit(VERSION).alias("schema_version"), F.lit(created_at).alias("created_at"), F.col("reasoning_path_type").alias("reasoning_path_type"), F.lit("template" if made is not None else None).cast("string").alias("rollout_llm")))


def write(rows: DataFrame, path: str, append: bool = False, s4_shard: bool = True, compression: str | None = None) -> DataFrame:
    """Nested episodes as JSON lines by dataset, split and shard; returns those that no shard takes: policy-isolated ones outside
    the test split. Without s4_shard every episode goes to the shard of its label. An episode repeats its names in every part, so
    gzip leaves little of it; a compressed file is read by one task, and no file is larger than what one task wrote."""
    flat = rows.withColumns({"s4": F.col("s4_eligible") if s4_shard else F.lit(False), "label": F.col("rho_subset")})
    readers.write_episodes(flat, path, append, compression)
    return readers.misplaced(flat).select("episode_id", F.lit("s4_only_test").alias("rule"))


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """Episodes as they were written; a folder that isn't there has none. Unknown labels count as S3, unknown graphs as LINEAR, unknown
    paths of reasoning as GoT."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    known = lambda c, xs, default: F.when(F.col(c).isin(*xs), F.col(c)).otherwise(default)
    rows = spark.read.schema(schema).json(path)
    return rows.withColumns({"graph_type": known("graph_type", graphs.GRAPH_TYPES, "LINEAR"), "rho_subset": known("rho_subset", ("S1", "S2", "S3", "S4"), "S3"), "reasoning_path_type": known("reasoning_path_type", ("GoT", "CoT", "ToT"), "GoT")})


def report(parts: Parts) -> DataFrame:
    """grain (all, subset, graph_type, hops, s4, gold), key, n and moments of rho of each; gold counts episodes with gold rows."""
    gold = parts.memory.where("gold").select(*KEY).distinct().withColumn("has", F.lit(True))
    e = parts.episodes.select(*KEY, "label", "graph_type", "hop_count", "rho", "s4").join(gold, KEY, "left")
    keys = F.array(
        F.struct(F.lit("all").alias("grain"), F.lit("").alias("key")), F.struct(F.lit("subset").alias("grain"), F.col("label").alias("key")), F.struct(F.lit("graph_type").alias("grain"), F.col("graph_type").alias("key")),
        F.struct(F.lit("hops").alias("grain"), F.col("hop_count").cast("string").alias("key")), F.struct(F.lit("s4").alias("grain"), F.col("s4").cast("string").alias("key")), F.struct(F.lit("gold").alias("grain"), F.coalesce("has", F.lit(False)).cast("string").alias("key")),
    )
    rows = e.select("rho", F.explode(keys).alias("g")).groupBy("g.grain", "g.key")
    return rows.agg(F.count(F.lit(1)).alias("n"), rules.mean_of("rho").alias("mean"), F.bround(F.stddev_pop("rho"), 4).alias("std"), F.min("rho").alias("low"), F.max("rho").alias("high"))
