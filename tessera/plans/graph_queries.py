"""Queries over reasoning graphs, episodes, quality rules, splits and text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import texts
from tessera.operators import episodes, graphs, rules, search
from tessera.plans import views
from tessera.plans.registry import query
from tessera.session import table

C = views.with_views(views.CHAIN_SQL)
CR = C.replace("WITH", "WITH RECURSIVE", 1)


def chain_graph(spark, sf):
    """Conversations as graphs: nodes and edges by episode, node names as text."""
    c = views.chain(spark, sf)
    kind = F.when(F.col("role") == "planner", "PLANNER").when(F.col("role") == "solver", "SOLVER").otherwise("VERIFIER")
    nodes = c.select("episode", F.col("node").cast("string").alias("node"), kind.alias("node_type"), F.col("node").alias("turn"), "text")
    edges = c.where("parent IS NOT NULL").select("episode", F.col("parent").cast("string").alias("src"), F.col("node").cast("string").alias("dst"))
    return nodes, edges


#: An episode's graph: its type by conversation, its hops by its turns, two at least.
EPISODES_SQL = """ep AS (SELECT conv_id AS episode, (['LINEAR', 'FORK', 'MERGE', 'FORK_MERGE', 'INDEPENDENT', 'POLICY_ISOLATED'])[conv_id % 6 + 1] AS graph_type, greatest(2, count(*))::INT AS hops,
    CASE WHEN conv_id % 10 < 7 THEN 'train' WHEN conv_id % 10 < 8 THEN 'dev' ELSE 'test' END AS split FROM conversations GROUP BY conv_id)"""
#: Nodes and edges of the templates of ep's (graph_type, hops), by the templates' rules.
TEMPLATES_SQL = """tk AS (SELECT DISTINCT graph_type, hops, greatest(hops, CASE graph_type WHEN 'MERGE' THEN 3 ELSE 2 END) AS g FROM ep), ks AS (SELECT *, unnest(range(1, g + 1)) AS k, CASE WHEN g = 2 THEN 1 ELSE 2 END AS fork FROM tk), ab AS (SELECT unnest(['a', 'b']) AS x),
    te AS (SELECT graph_type, hops, CASE k WHEN 1 THEN 'planner' ELSE 'solver_' || (k - 1) END AS src, 'solver_' || k AS dst, 'DEPENDS_ON' AS edge_type FROM ks WHERE graph_type IN ('LINEAR', 'POLICY_ISOLATED')
      UNION ALL SELECT graph_type, hops, CASE k WHEN 1 THEN 'planner' ELSE 'solver_' || (k - 1) || x END, 'solver_' || k || x, 'DEPENDS_ON' FROM ks, ab WHERE graph_type = 'INDEPENDENT'
      UNION ALL SELECT graph_type, hops, CASE WHEN k <= 2 THEN 'planner' ELSE 'solver_' || (k - 1) END, 'solver_' || k, CASE k WHEN 3 THEN 'AGGREGATES' ELSE 'DEPENDS_ON' END FROM ks WHERE graph_type = 'MERGE'
      UNION ALL SELECT graph_type, hops, 'solver_1', 'solver_3', 'AGGREGATES' FROM tk WHERE graph_type = 'MERGE'
      UNION ALL SELECT graph_type, hops, 'planner', 'solver_1', 'DEPENDS_ON' FROM tk WHERE graph_type LIKE 'FORK%' AND g > 2
      UNION ALL SELECT graph_type, hops, CASE fork WHEN 1 THEN 'planner' ELSE 'solver_1' END, 'solver_' || k || x, 'DEPENDS_ON' FROM ks, ab WHERE graph_type LIKE 'FORK%' AND k = fork
      UNION ALL SELECT graph_type, hops, 'solver_' || fork || x, 'solver_' || k, 'AGGREGATES' FROM ks, ab WHERE graph_type = 'FORK_MERGE' AND k = fork + 1
      UNION ALL SELECT graph_type, hops, 'solver_' || (k - 1) || CASE WHEN graph_type = 'FORK' AND k = 3 THEN 'a' ELSE '' END, 'solver_' || k, 'DEPENDS_ON' FROM ks WHERE graph_type = 'FORK' AND k > 2 OR graph_type = 'FORK_MERGE' AND k > fork + 1),
    tn AS (SELECT graph_type, hops, 'planner' AS node, 'PLANNER' AS node_type, NULL::INT AS hop FROM tk UNION ALL SELECT DISTINCT graph_type, hops, dst, 'SOLVER', regexp_extract(dst, '[0-9]+')::INT FROM te UNION ALL SELECT graph_type, hops, 'verifier', 'VERIFIER', NULL FROM tk WHERE graph_type = 'POLICY_ISOLATED')"""


def episode_graphs(spark, sf):
    """Episodes with their graph_type and hops, and nodes and edges of each such template."""
    kinds = F.element_at(F.array(*map(F.lit, graphs.GRAPH_TYPES)), (F.col("conv_id") % 6 + 1).cast("int"))
    r = F.col("conv_id") % 10
    ep = table(spark, sf, "conversations").groupBy("conv_id").agg(F.greatest(F.lit(2), F.count(F.lit(1))).cast("int").alias("hops"))
    ep = ep.select(F.col("conv_id").alias("episode"), kinds.alias("graph_type"), "hops", F.when(r < 7, "train").when(r < 8, "dev").otherwise("test").alias("split"))
    return ep, *graphs.templates_of(ep)


TEMPLATE = ["graph_type", "hops"]


@query("q43_ancestors_closure", f"{CR}, up AS (SELECT episode, node, parent AS ancestor, 1 AS distance FROM v_chain WHERE parent IS NOT NULL UNION ALL SELECT u.episode, u.node, c.parent, u.distance + 1 FROM up u JOIN v_chain c ON c.episode = u.episode AND c.node = u.ancestor WHERE c.parent IS NOT NULL) SELECT episode, node, ancestor, min(distance)::INT AS distance FROM up GROUP BY ALL")
def q43(spark, sf):
    _, edges = chain_graph(spark, sf)
    return graphs.ancestors(edges, ["episode"]).select("episode", F.col("node").cast("long").alias("node"), F.col("ancestor").cast("long").alias("ancestor"), "distance")


@query("q44_dag_check", f"""{C}, p AS (SELECT episode, node, role, parent, count(*) OVER (PARTITION BY episode) AS k, episode % 7 = 3 AS bent FROM v_chain)
    SELECT episode, NOT bool_or(bent) AS is_dag, count(*) FILTER (role = 'solver' AND parent IS NULL AND NOT bent) AS orphan_solvers, count(*) FILTER (role = 'verifier' AND (k > 1 OR bent)) AS bound_verifiers FROM p GROUP BY 1""")
def q44(spark, sf):
    """Every seventh conversation is bent to a circle on purpose: its last turn leads to its first."""
    nodes, edges = chain_graph(spark, sf)
    bent = nodes.where("episode % 7 = 3").groupBy("episode").agg(F.max_by("node", "turn").alias("src"), F.min_by("node", "turn").alias("dst"))
    return graphs.check(nodes, edges.unionByName(bent), ["episode"])


@query("q45_topo_levels", f"{C} SELECT episode, node, (row_number() OVER (PARTITION BY episode ORDER BY node) - 1)::INT AS level FROM v_chain")
def q45(spark, sf):
    nodes, edges = chain_graph(spark, sf)
    return graphs.levels(nodes, edges, ["episode"]).select("episode", F.col("node").cast("long").alias("node"), "level")


RHO_CTES = f"""{TEMPLATES_SQL}, cl AS (SELECT graph_type, hops, dst AS node, src AS anc FROM te UNION SELECT c.graph_type, c.hops, c.node, e.src FROM cl c JOIN te e ON e.graph_type = c.graph_type AND e.hops = c.hops AND e.dst = c.anc),
    so AS (SELECT graph_type, hops, node FROM tn WHERE node_type = 'SOLVER'), ac AS (SELECT c.graph_type, c.hops, c.node, c.anc AS item FROM cl c JOIN so USING (graph_type, hops, node) JOIN so s2 ON s2.graph_type = c.graph_type AND s2.hops = c.hops AND s2.node = c.anc
      UNION SELECT graph_type, hops, node, node FROM so UNION SELECT graph_type, hops, node, '#plan' FROM so),
    st AS (SELECT graph_type, hops, node, list(item) AS items FROM ac GROUP BY ALL),
    pr AS (SELECT a.graph_type, a.hops, len(list_intersect(a.items, b.items))::DOUBLE / len(list_distinct(list_concat(a.items, b.items))) AS iou FROM st a JOIN st b ON a.graph_type = b.graph_type AND a.hops = b.hops AND a.node < b.node),
    rh AS (SELECT graph_type, hops, round_even(avg(iou), 4) AS rho FROM pr GROUP BY ALL), er AS (SELECT ep.*, rho, CASE WHEN rho > 0.6 THEN 'S1' WHEN rho > 0.4 THEN 'S2' ELSE 'S3' END AS label FROM ep JOIN rh USING (graph_type, hops))"""
RHO_SQL = f"WITH RECURSIVE {EPISODES_SQL}, {RHO_CTES}"


@query("q46_rho_v3", f"{RHO_SQL} SELECT episode, graph_type, hops, rho FROM er")
def q46(spark, sf):
    ep, n, e = episode_graphs(spark, sf)
    return ep.join(graphs.rho_v3(n, e, TEMPLATE), TEMPLATE).select("episode", "graph_type", "hops", "rho")


@query("q47_rho_static", f"""{RHO_SQL}, sl AS (SELECT c.graph_type, c.hops, c.node, c.anc AS m FROM cl c JOIN so USING (graph_type, hops, node) JOIN so s2 ON s2.graph_type = c.graph_type AND s2.hops = c.hops AND s2.node = c.anc),
    pm AS (SELECT graph_type, hops, m, count(DISTINCT node) AS seen FROM sl GROUP BY ALL), ns AS (SELECT graph_type, hops, count(*) AS k FROM so GROUP BY ALL), rs AS (SELECT graph_type, hops, round_even(count(*) FILTER (seen = k)::DOUBLE / count(*), 4) AS r FROM pm JOIN ns USING (graph_type, hops) GROUP BY ALL)
    SELECT episode, graph_type, hops, coalesce(r, 0) AS rho FROM ep LEFT JOIN rs USING (graph_type, hops)""")
def q47(spark, sf):
    """What a solver sees: the shared rows of the solvers above it."""
    ep, n, e = episode_graphs(spark, sf)
    solvers = n.where("node_type = 'SOLVER'").select(*TEMPLATE, "node")
    up = graphs.ancestors(e, TEMPLATE).join(solvers, [*TEMPLATE, "node"]).join(solvers.withColumnRenamed("node", "ancestor"), [*TEMPLATE, "ancestor"], "left_semi")
    return ep.join(graphs.rho_static(up.select(*TEMPLATE, "node", F.col("ancestor").alias("memory_id")), n, TEMPLATE), TEMPLATE).select("episode", "graph_type", "hops", "rho")


@query("q48_subset_label_stats", f"{RHO_SQL} SELECT label, count(*) AS n, round_even(sum(round(rho * 10000)::BIGINT)::DOUBLE / count(*), 0) / 10000 AS mean, round_even(stddev_pop(rho), 4) AS std, min(rho) AS low, max(rho) AS high FROM er GROUP BY 1")
def q48(spark, sf):
    return rules.statistics(q46(spark, sf).withColumn("label", graphs.label(F.col("rho"))))


@query("q49_layer_union", f"{C}, l AS (SELECT episode, node, 0 AS ord, 'workspace_semantic' AS layer, 'workspace/chat/semantic' AS scope_id FROM v_chain WHERE role = 'planner' UNION ALL SELECT episode, node, 1, 'task_shared_episodic', 'task/' || episode || '/shared' FROM v_chain WHERE role = 'solver' UNION ALL SELECT episode, node, 2, 'agent_private', 'task/' || episode || '/' || node || '/private' FROM v_chain UNION ALL SELECT episode, node, 3, 'governed_restricted', 'task/' || episode || '/restricted' FROM v_chain WHERE role = 'verifier') SELECT * FROM l")
def q49(spark, sf):
    c = views.chain(spark, sf)
    layers = (("workspace_semantic", "planner"), ("task_shared_episodic", "solver"), ("agent_private", None), ("governed_restricted", "verifier"))
    part = lambda k, layer, role: (c if role is None else c.where(F.col("role") == role)).select("episode", "node", F.lit(k).alias("ord"), F.lit(layer).alias("layer"), episodes.scope_id(F.lit(layer), F.lit("chat"), F.col("episode").cast("string"), F.col("node").cast("string")).alias("scope_id"))
    return rules.union(*(part(k, *x) for k, x in enumerate(layers)))


@query("q50_ground_truth_assign", f"""{C}, a AS (SELECT x.episode, x.role || '_' || x.node AS agent, y.node AS reach FROM v_chain x JOIN v_chain y ON x.episode = y.episode AND y.node <= x.node),
    g AS (SELECT episode, node, CASE WHEN role = 'planner' THEN NULL ELSE node END AS src FROM v_chain WHERE role <> 'verifier'),
    r AS (SELECT g.episode, g.node, a.agent FROM g JOIN a ON a.episode = g.episode AND a.reach = g.src UNION SELECT g.episode, g.node, c.role || '_' || c.node FROM g JOIN v_chain c ON c.episode = g.episode WHERE g.src IS NULL)
    SELECT episode, node, string_agg(agent, ',' ORDER BY agent) AS required_by FROM r GROUP BY ALL""")
def q50(spark, sf):
    c = views.chain(spark, sf).withColumn("agent", F.concat_ws("_", "role", F.col("node").cast("string")))
    access = c.select("episode", "agent", "node").join(c.select("episode", F.col("node").alias("reachable")), "episode").where("reachable <= node")
    gold = c.where("role <> 'verifier'").select("episode", F.col("node").alias("memory_id"), F.when(F.col("role") != "planner", F.col("node")).alias("source_node"))
    return episodes.ground_truth(gold, access, c, ["episode"]).select("episode", F.col("memory_id").alias("node"), F.array_join("required_by", ",").alias("required_by"))


SLOTS_SQL = "sl(node_type, slot_pos, slot, layer) AS (VALUES " + ", ".join(f"('{t}', {p}, '{s}', '{dict((x[0], x[1]) for x in episodes.SLOTS)[s]}')" for t, ss in episodes.NODE_SLOTS.items() for p, s in enumerate(ss)) + ")"
ARTIFACTS_SQL = f"""{C}, {SLOTS_SQL}, cn AS (SELECT *, upper(role) AS node_type, row_number() OVER (PARTITION BY episode ORDER BY node) - 1 AS lev FROM v_chain),
    ar AS (SELECT c.episode, c.node, c.node_type, slot, c.episode || ':' || c.node || ':' || slot AS memory_id, layer, (c.lev * 3 + slot_pos)::INT AS topo_index, CASE WHEN c.parent IS NULL THEN '' ELSE c.episode || ':' || c.parent || ':' || CASE p.node_type WHEN 'PLANNER' THEN 'plan' ELSE 'conclusion' END END AS parents
      FROM cn c JOIN sl ON sl.node_type = c.node_type LEFT JOIN cn p ON p.episode = c.episode AND p.node = c.parent)"""


def chain_artifacts(spark, sf):
    nodes, edges = chain_graph(spark, sf)
    order = F.row_number().over(Window.partitionBy("episode").orderBy("turn")) - 1
    return nodes, edges, episodes.artifacts(nodes.withColumn("lev", order), edges, ["episode"], F.col("lev"), F.lit("chat"))


@query("q51_artifacts_emit", f"{ARTIFACTS_SQL} SELECT episode, node::VARCHAR AS node, slot, memory_id, layer, topo_index, parents FROM ar")
def q51(spark, sf):
    return chain_artifacts(spark, sf)[2].select("episode", "node", "slot", "memory_id", "layer", "topo_index", F.array_join("parents", ",").alias("parents"))


@query("q52_trace_rules", f"""{ARTIFACTS_SQL}, br AS (SELECT episode, node, CASE WHEN topo_index % 19 = 7 THEN 'draft' ELSE slot END AS slot, CASE WHEN topo_index % 11 = 3 THEN 'nowhere' ELSE parents END AS parents, CASE WHEN episode % 7 = 2 AND slot = 'scratch' THEN 'twice:' || episode ELSE memory_id END AS memory_id, layer,
      CASE WHEN topo_index % 23 = 2 THEN 'owner' ELSE 'team' END AS visibility, topo_index, CASE WHEN episode % 8 = 1 THEN -topo_index ELSE topo_index END AS pos FROM ar WHERE NOT (slot = 'conclusion' AND episode % 5 = 0)),
    i AS (SELECT 'parent_exists' AS rule, 'error' AS severity, memory_id AS key FROM br b WHERE parents <> '' AND NOT EXISTS (SELECT 1 FROM br x WHERE x.episode = b.episode AND x.memory_id = b.parents)
      UNION ALL SELECT 'unique_id', 'error', memory_id FROM br GROUP BY episode, memory_id HAVING count(*) > 1
      UNION ALL SELECT 'slot', 'error', memory_id FROM br WHERE slot = 'draft'
      UNION ALL SELECT 'stream_order', 'error', memory_id FROM (SELECT *, lag(topo_index) OVER (PARTITION BY episode ORDER BY pos) AS was FROM br) WHERE topo_index < was
      UNION ALL SELECT 'shared_not_owner', 'error', memory_id FROM br WHERE layer LIKE 'task_shared%' AND visibility = 'owner'
      UNION ALL SELECT 'solver_conclusion', 'error', episode || ':' || node FROM cn WHERE node_type = 'SOLVER' AND NOT EXISTS (SELECT 1 FROM br WHERE br.episode = cn.episode AND br.node = cn.node AND br.slot = 'conclusion')
      UNION ALL SELECT 'audit_missing', 'error', episode::VARCHAR FROM (SELECT DISTINCT episode FROM v_chain) e WHERE episode % 6 = 5 AND NOT EXISTS (SELECT 1 FROM br WHERE br.episode = e.episode AND slot = 'audit_report')
      UNION ALL SELECT 'audit_unexpected', 'warning', episode::VARCHAR FROM (SELECT DISTINCT episode FROM v_chain) e WHERE episode % 6 <> 5 AND EXISTS (SELECT 1 FROM br WHERE br.episode = e.episode AND slot = 'audit_report'))
    SELECT * FROM i""")
def q52(spark, sf):
    """Rows are broken on purpose, for each of the eight rules."""
    nodes, _, a = chain_artifacts(spark, sf)
    t = F.col("topo_index")
    a = a.where("NOT (slot = 'conclusion' AND episode % 5 = 0)").withColumns({
        "parents": F.when(t % 11 == 3, F.array(F.lit("nowhere"))).otherwise(F.col("parents")),
        "memory_id": F.when((F.col("episode") % 7 == 2) & (F.col("slot") == "scratch"), F.concat(F.lit("twice:"), "episode")).otherwise(F.col("memory_id")),
        "visibility": F.when(t % 23 == 2, "owner").otherwise("team"), "pos": F.when(F.col("episode") % 8 == 1, -t).otherwise(t), "slot": F.when(t % 19 == 7, "draft").otherwise(F.col("slot")),
    })
    g = nodes.select("episode").distinct().withColumn("graph_type", F.when(F.col("episode") % 6 == 5, "POLICY_ISOLATED").otherwise("LINEAR"))
    return rules.trace_rules(a, nodes, g, ["episode"])


@query("q53_audit_rules", f"""{ARTIFACTS_SQL}, b AS (SELECT episode, CASE WHEN topo_index % 13 = 5 THEN 'same' ELSE memory_id END AS memory_id, CASE WHEN slot = 'audit_report' THEN 3 WHEN topo_index % 17 = 4 THEN 4 ELSE 0 END AS need, CASE WHEN topo_index % 7 <> 6 THEN layer END AS layer FROM ar),
    mx AS (SELECT episode, max(CASE WHEN node_type = 'VERIFIER' THEN 2 ELSE 1 END) AS c FROM cn GROUP BY 1)
    SELECT 'unique_everywhere' AS rule, 'error' AS severity, memory_id AS key FROM b GROUP BY memory_id HAVING count(*) > 1 UNION ALL SELECT 'clearance_range', 'error', memory_id FROM b WHERE need NOT BETWEEN 0 AND 3
    UNION ALL SELECT 'clearance_reachable', 'warning', memory_id FROM b JOIN mx USING (episode) WHERE need > c UNION ALL SELECT 'has_layer', 'error', memory_id FROM b WHERE layer IS NULL""")
def q53(spark, sf):
    nodes, _, a = chain_artifacts(spark, sf)
    t = F.col("topo_index")
    a = a.withColumns({"memory_id": F.when(t % 13 == 5, "same").otherwise(F.col("memory_id")), "required_clearance": F.when(F.col("slot") == "audit_report", 3).when(t % 17 == 4, 4).otherwise(0), "layer": F.when(t % 7 != 6, F.col("layer"))})
    return rules.audit_rules(a, episodes.agents(nodes, ["episode"], F.lit("chat")), ["episode"], {"layer": F.col("layer")})


BATCH_SQL = f"{RHO_SQL}, ba AS (SELECT episode // 3 AS original_id, split, rho, CASE WHEN episode % 9 = 0 THEN 'S9' ELSE label END AS label, graph_type = 'POLICY_ISOLATED' AS s4 FROM er), sp AS (SELECT original_id, list(DISTINCT split) AS s FROM ba GROUP BY 1)"


@query("q54_batch_rules", f"""{BATCH_SQL} SELECT 'leak_' || a || '_' || b AS rule, 'error' AS severity, original_id::VARCHAR AS key FROM sp, (VALUES ('train', 'test'), ('dev', 'test'), ('train', 'dev')) v(a, b) WHERE list_contains(s, a) AND list_contains(s, b)
    UNION ALL SELECT 's4_only_test', 'error', original_id::VARCHAR FROM ba WHERE s4 AND split <> 'test' UNION ALL SELECT 'label_matches_rho', 'error', original_id::VARCHAR FROM ba WHERE label = 'S9'""")
def q54(spark, sf):
    ep, n, e = episode_graphs(spark, sf)
    r = ep.join(graphs.rho_v3(n, e, TEMPLATE), TEMPLATE)
    b = r.select(F.floor(F.col("episode") / 3).alias("original_id"), "split", "rho", F.when(F.col("episode") % 9 == 0, "S9").otherwise(graphs.label(F.col("rho"))).alias("label"), (F.col("graph_type") == "POLICY_ISOLATED").alias("s4"), "graph_type")
    return rules.batch_rules(b)


@query("q55_stratified_dev_split", "WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS n, count(*) OVER (PARTITION BY source) AS k FROM documents) SELECT doc_id, source FROM d WHERE n <= greatest(1, floor(k * 0.1))")
def q55(spark, sf):
    return rules.stratified(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 0.1, "42")


@query("q56_leakage_check", "WITH s AS (SELECT md5(coalesce(text, '')) AS key, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents) SELECT key, count(*) AS rows, count(DISTINCT split) AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def q56(spark, sf):
    """Texts that train and test rows share, over all documents; copies leak."""
    d = table(spark, sf, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))
    return d.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("split").alias("splits")).where("splits > 1")


@query("q57_step_split", """WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 10) AS a, list_filter(list_transform(string_split_regex(text, '\\.\\s+'), lambda x: trim(x)), lambda x: x <> '') AS b, regexp_extract_all(text, '\\d+(?:\\.\\d+)?') AS nums FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(a) >= 2 THEN a ELSE b END AS steps, nums FROM d) SELECT doc_id, len(steps)::INT AS n_steps, len(nums)::INT AS n_numbers, coalesce(CASE WHEN len(nums) > 0 THEN list_position(list_transform(steps, lambda x: contains(x, nums[1])), true) ELSE 0 END, 0)::BIGINT AS first_step FROM s""")
def q57(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", texts.math_steps(F.col("text")).alias("steps"), F.regexp_extract_all("text", F.lit(texts.NUMBER), F.lit(0)).alias("nums"))
    first = F.when(F.size("nums") > 0, texts.first_step_with(F.col("steps"), F.get("nums", F.lit(0)))).otherwise(0)
    return d.select("doc_id", F.size("steps").alias("n_steps"), F.size("nums").alias("n_numbers"), first.cast("long").alias("first_step"))


PREFIX_SQL = "CASE role " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.ROLE_PREFIX.items()) + " ELSE '' END"


@query("q58_normalise_query", f"""WITH q AS (SELECT doc_id, (['planner', 'solver', 'verifier', 'critic', 'custom'])[doc_id % 5 + 1] AS role, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS t, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS task FROM documents),
    p AS (SELECT doc_id, task, CASE WHEN starts_with(t, {PREFIX_SQL}) THEN t ELSE {PREFIX_SQL} || t END AS o FROM q) SELECT doc_id, md5(CASE WHEN task = '' THEN o ELSE '[Task: ' || task || '] ' || o END) AS query_md5 FROM p""")
def q58(spark, sf):
    role = F.element_at(F.array(*map(F.lit, ("planner", "solver", "verifier", "critic", "custom"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.md5(texts.normalise_query(F.col("text"), role, F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(""))).alias("query_md5"))


W = "list_distinct(list_filter(string_split_regex(lower({0}), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))"


@query("q59_keyword_overlap", f"""WITH q AS (SELECT item_id, unnest({W.format('text')}) AS w, len({W.format('text')}) AS n FROM benchmark), d AS (SELECT doc_id, unnest({W.format('text')}) AS w FROM documents),
    j AS (SELECT item_id, n, doc_id, count(*) AS hits FROM q JOIN d USING (w) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rank FROM j) SELECT item_id, doc_id, rank, round(hits::DOUBLE / n, 6) AS overlap FROM r WHERE rank <= 5""")
def q59(spark, sf):
    """O-63 over all documents: benchmark items as queries, the best five."""
    q = table(spark, sf, "benchmark").select("item_id", texts.words(F.col("text")).alias("ws"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), texts.words(F.col("text")).alias("ws"))
    r = search.best_overlaps(d, q)
    return r.select("item_id", F.col("id").alias("doc_id"), "rank", F.round(F.col("hits") / F.col("n"), 6).alias("overlap"))


@query("q64_consumer_index", f"{ARTIFACTS_SQL} SELECT parents AS memory_id, count(*) AS consumers, min(memory_id) AS first FROM ar WHERE parents <> '' GROUP BY 1")
def q64(spark, sf):
    """O-112."""
    return episodes.consumers(chain_artifacts(spark, sf)[2], ["episode"]).select("memory_id", F.size("consumed_by").cast("long").alias("consumers"), F.element_at("consumed_by", 1).alias("first"))


@query("q65_agents", f"{C} SELECT episode, role || '_' || node AS agent, CASE WHEN role = 'verifier' THEN 'restricted,team' ELSE 'public,team' END AS visibility, CASE WHEN role = 'verifier' THEN 2 ELSE 1 END AS clearance, role = 'verifier' AS audit FROM v_chain")
def q65(spark, sf):
    """O-102."""
    nodes, _ = chain_graph(spark, sf)
    return episodes.agents(nodes, ["episode"], F.lit("chat")).select("episode", "agent", F.array_join(F.sort_array("visibility"), ",").alias("visibility"), "clearance", "audit")


POLICY_SQL = f"""{C}, ag AS (SELECT episode, node, text, role || '_' || node AS agent, role = 'verifier' AS v, CASE WHEN node % 4 = 3 THEN 3 WHEN role = 'verifier' THEN 2 ELSE 1 END AS clearance, episode % 7 = 1 AND node % 3 = 0 AS bare,
        CASE WHEN role = 'verifier' THEN episode % 5 <> 2 ELSE episode % 5 = 3 AND node % 2 = 0 END AS sealed FROM v_chain),
    ep AS (SELECT episode, episode % 6 = 5 AS isolated, episode % 8 = 0 AS s4, bool_or(v) AS hv, count(*) AS n, count(*) - 1 + CASE WHEN episode % 4 = 1 THEN 1 ELSE 0 END AS hops, CASE WHEN episode % 9 = 4 THEN 1.25 ELSE (episode % 9)::DOUBLE / 10 END AS rho,
        CASE WHEN episode % 3 = 0 THEN trim(substr(arg_min(text, node), 1, 10)) ELSE '' END AS answer FROM ag GROUP BY episode),
    ly AS (SELECT episode, node, text, unnest(CASE role WHEN 'planner' THEN ['workspace_semantic', 'agent_private'] WHEN 'solver' THEN ['task_shared_episodic', 'agent_private'] ELSE ['agent_private', 'restricted'] END) AS layer FROM v_chain),
    me AS (SELECT *, CASE WHEN episode % 11 = 6 THEN episode || ':' || node ELSE episode || ':' || node || ':' || layer END AS mid FROM ly)
    SELECT 'agent_clearance' AS rule, 'error' AS severity, agent AS key FROM ag WHERE clearance <> CASE WHEN v THEN 2 ELSE 1 END UNION ALL SELECT 'agent_scopes', 'error', agent FROM ag WHERE bare
    UNION ALL SELECT 'verifier_scope', 'error', agent FROM ag WHERE v AND (bare OR NOT sealed) UNION ALL SELECT 'other_scope', 'error', agent FROM ag WHERE NOT v AND NOT bare AND sealed
    UNION ALL SELECT 'verifier_missing', 'error', episode::VARCHAR FROM ep WHERE (isolated OR s4) AND NOT hv UNION ALL SELECT 'verifier_unexpected', 'error', episode::VARCHAR FROM ep WHERE NOT isolated AND hv
    UNION ALL SELECT 'workspace_empty', 'error', episode::VARCHAR FROM ep WHERE episode NOT IN (SELECT episode FROM ly WHERE layer = 'workspace_semantic') UNION ALL SELECT 'agent_count', 'error', episode::VARCHAR FROM ep WHERE n < hops + 1
    UNION ALL SELECT 'rho_range', 'error', episode::VARCHAR FROM ep WHERE NOT rho BETWEEN 0 AND 1 UNION ALL SELECT 'restricted_clearance', 'error', mid FROM me WHERE layer = 'restricted' AND episode % 3 = 1
    UNION ALL SELECT 'unique_id', 'error', mid FROM me GROUP BY episode, mid HAVING count(*) > 1 UNION ALL SELECT 'embedding_null', 'error', mid FROM me WHERE layer = 'agent_private' AND node % 5 = 4
    UNION ALL SELECT 'answer_leak', 'warning', mid FROM me JOIN ep USING (episode) WHERE layer IN ('workspace_semantic', 'task_shared_episodic') AND length(answer) >= 2 AND contains(text, answer)"""


@query("q70_policy_rules", POLICY_SQL)
def q70(spark, sf):
    """O-106 over conversations as episodes; each of the thirteen rules is broken on purpose somewhere."""
    nodes, _ = chain_graph(spark, sf)
    at, turn = F.col("episode"), F.col("turn")
    a = episodes.agents(nodes, ["episode"], F.lit("chat")).join(nodes.select("episode", F.concat_ws("_", F.lower("node_type"), "node").alias("agent"), "turn"), ["episode", "agent"])
    a = a.withColumn("restricted_scope", episodes.scope_id(F.lit("governed_restricted"), F.lit("chat"), at.cast("string"), F.lit("")))
    wrong = (F.col("role") != "verifier") & (at % 5 == 3) & (turn % 2 == 0)
    scopes = F.when(wrong, F.array_append("scopes", F.col("restricted_scope"))).when((F.col("role") == "verifier") & (at % 5 == 2), F.array_remove("scopes", F.col("restricted_scope"))).otherwise(F.col("scopes"))
    a = a.withColumn("scopes", F.when((at % 7 == 1) & (turn % 3 == 0), F.array().cast("array<string>")).otherwise(scopes)).withColumn("clearance", F.when(turn % 4 == 3, 3).otherwise(F.col("clearance")))
    m = q49(spark, sf).join(nodes.select("episode", F.col("turn").alias("node"), "text"), ["episode", "node"]).withColumn("layer", F.when(F.col("layer") == "governed_restricted", "restricted").otherwise(F.col("layer")))
    short = F.concat_ws(":", "episode", "node")
    m = m.select(
        "episode", F.when(at % 11 == 6, short).otherwise(F.concat_ws(":", short, "layer")).alias("memory_id"), "layer", F.when(F.col("layer") != "restricted", 0).when(at % 3 == 1, 1).otherwise(2).alias("required_clearance"),
        F.col("text").alias("content"), F.when((F.col("layer") == "agent_private") & (F.col("node") % 5 == 4), F.array(F.lit(1.0).cast("float"))).alias("embedding"),
    )
    e = nodes.groupBy("episode").agg(F.count(F.lit(1)).alias("n"), F.min_by("text", "turn").alias("text"))
    e = e.select(
        "episode", F.when(at % 6 == 5, "POLICY_ISOLATED").otherwise("LINEAR").alias("graph_type"), (at % 8 == 0).alias("s4"), (F.col("n") - 1 + F.when(at % 4 == 1, 1).otherwise(0)).alias("hops"),
        F.when(at % 9 == 4, 1.25).otherwise((at % 9).cast("double") / 10).alias("rho"), F.when(at % 3 == 0, F.trim(F.substring("text", 1, 10))).otherwise("").alias("answer"),
    )
    return rules.policy_rules(e, a, m, ["episode"])


@query("q71_quality_gate", f"""{RHO_SQL}, g AS (SELECT label, count(*) AS n, avg(rho) AS mean, count(*) FILTER (episode % 31 = 0) AS bare FROM er GROUP BY 1), t AS (SELECT sum(n) AS total, coalesce(max(n) FILTER (label = 'S3'), 0) AS s3 FROM g)
    SELECT 'ground_truth' AS rule, 'error' AS severity, label AS key FROM g WHERE bare > 0 UNION ALL SELECT 's3_share', 'warning', 'S3' FROM t WHERE s3::DOUBLE / total <= 0.05
    UNION ALL SELECT 'rho_band', 'warning', label FROM g WHERE NOT CASE label WHEN 'S1' THEN mean > 0.6 WHEN 'S2' THEN mean > 0.4 AND mean <= 0.6 ELSE mean <= 0.4 END""")
def q71(spark, sf):
    """O-86; every 31st episode lacks ground truth on purpose."""
    return rules.quality_gate(q46(spark, sf).select(graphs.label(F.col("rho")).alias("label"), "rho", F.when(F.col("episode") % 31 == 0, 0).otherwise(1).alias("n_gold")))


@query("q72_template_texts", """SELECT conv_id, turn, md5(CASE role WHEN 'user' THEN '[query_intent] node=' || turn || ' hop=' || turn || chr(10) || 'I must answer: ' || trim(text) || chr(10) || 'I need to retrieve: facts that resolve this sub-question, plus any upstream conclusions from my ancestors.'
    WHEN 'assistant' THEN '[query_intent] node=verifier' || chr(10) || 'I must check provenance and cross-conclusion consistency.' || chr(10) || 'I need to retrieve: restricted audit traces and all task_shared conclusions.'
    ELSE '[query_intent] node=planner' || chr(10) || 'I must decompose: ' || trim(text) || chr(10) || 'I need to retrieve: high-level topical context to decide the hop structure.' END) AS text_md5 FROM conversations""")
def q72(spark, sf):
    """O-110 for every turn."""
    from tessera.functions import templates

    kind = F.when(F.col("role") == "user", "SOLVER").when(F.col("role") == "assistant", "VERIFIER").otherwise("PLANNER")
    t = table(spark, sf, "conversations")
    return t.select("conv_id", "turn", F.md5(templates.artifact(kind, F.lit("query_intent"), F.col("text"), F.col("turn"), F.col("turn"), F.trim("text"))).alias("text_md5"))


@query("q92_triple_questions", "SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 0 THEN 'What is the (' || text || ') and #9 of ' || role || '?' WHEN turn % 3 = 1 THEN '>> (' || text || ')' ELSE role || ' #1' END) AS question_md5 FROM conversations")
def q92(spark, sf):
    """Steps written as triples, as questions; every turn is what the step before concluded."""
    t, r = table(spark, sf, "conversations"), F.col("turn") % 3
    step = F.when(r == 0, F.concat("role", F.lit(" >> #1 and #9"))).when(r == 1, ">> #1").otherwise(F.concat("role", F.lit(" #1")))
    return t.select("conv_id", "turn", F.md5(texts.humanise(step, F.array("text"))).alias("question_md5"))


@query("q93_templated_queries", """WITH d AS (SELECT doc_id, (['planner', 'solver', 'verifier', 'critic', 'custom'])[doc_id % 5 + 1] AS role, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS q, coalesce(source, '') AS source FROM documents)
    SELECT doc_id, md5(CASE role WHEN 'planner' THEN 'Plan ' || q || ' for ' || source WHEN 'solver' THEN q ELSE '[' || role || '] ' || q END) AS query_md5 FROM d""")
def q93(spark, sf):
    """O-128: white space, then a template by role; one that names an unknown field leaves the query."""
    role = F.element_at(F.array(*map(F.lit, ("planner", "solver", "verifier", "critic", "custom"))), (F.col("doc_id") % 5 + 1).cast("int"))
    known = {"planner": "Plan {query} for {source}", "solver": "Solve {nothing}"}
    made = texts.chained(F.col("text"), texts.collapse, lambda q: texts.templated(q, role, known, "[{role}] {query}", source=F.col("source")))
    return table(spark, sf, "documents").select("doc_id", F.md5(made).alias("query_md5"))
