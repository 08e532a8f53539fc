"""Queries over whole episodes, their requests and reports, splits, merge controls, and scopes and slices as tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tessera.functions import texts
from tessera.operators import assembly, episodes, evaluation, graphs, rollout, routing, rules, scopes
from tessera.operators.graphs import GRAPH_TYPES
from tessera.plans import views
from tessera.plans.graph_queries import ARTIFACTS_SQL, RHO_CTES, RHO_SQL, chain_artifacts, chain_graph, q46
from tessera.plans.registry import query
from tessera.plans.retrieval_queries import run, variant_sql
from tessera.plans.routing_queries import SCOPE_TREE_SQL, SCOPES_SQL, TYPES_SQL, R, scope_tree
from tessera.session import checkpoint, scratch, table
from tessera.sources import normalise, readers

SPLIT_SQL = "CASE WHEN conv_id % 10 < 7 THEN 'train' WHEN conv_id % 10 < 8 THEN 'dev' ELSE 'test' END"
#: Conversations as items; every eleventh has lost its paragraphs, which no episode may.
ITEMS_SQL = f"""it AS (SELECT conv_id, list(text ORDER BY turn) AS ts, coalesce(list(text ORDER BY turn) FILTER (role = 'user'), []) AS us, count(*) AS turns, count(*) FILTER (role = 'user') AS u, conv_id % 11 = 4 AS bare, {SPLIT_SQL} AS split FROM conversations GROUP BY conv_id),
    ep AS (SELECT *, greatest(2, u)::INT AS hops, graph_type = 'POLICY_ISOLATED' AS s4, 'hotpotqa_' || split || '_' || conv_id || '_' || graph_type AS episode_id FROM it, (SELECT unnest([{", ".join(f"'{g}'" for g in GRAPH_TYPES)}]) AS graph_type))"""
FLOW_SQL = f"""WITH RECURSIVE {ITEMS_SQL}, {RHO_CTES},
    nc AS (SELECT graph_type, hops, count(*) AS nodes FROM tn GROUP BY ALL), ec AS (SELECT graph_type, hops, count(*) AS edges FROM te GROUP BY ALL),
    nb AS (SELECT tn.graph_type, tn.hops, tn.node, tn.hop, 1 + count(cl.node) AS needed FROM tn LEFT JOIN cl ON cl.graph_type = tn.graph_type AND cl.hops = tn.hops AND cl.anc = tn.node WHERE tn.node_type = 'SOLVER' GROUP BY ALL),
    sh AS (SELECT er.episode_id, nb.node, nb.hop, nb.needed FROM er JOIN nb USING (graph_type, hops) WHERE nb.hop <= er.u AND trim(split_part(er.us[nb.hop], '.', 1)) <> ''), sc AS (SELECT episode_id, count(*) AS shared, sum(needed) AS needed FROM sh GROUP BY 1)"""


def items(spark, sf):
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    bare = F.col("conv_id") % 11 == 4
    para = lambda x, gold, hop: normalise.paragraph(normalise.pid(x["turn"]), x["text"], F.concat(F.lit("p"), x["turn"].cast("string")), F.lit(gold), hop)
    t = t.withColumns({"users": F.filter("ts", lambda x: x["role"] == "user"), "others": F.filter("ts", lambda x: x["role"] != "user")})
    none = F.array().cast(f"array<{normalise.PARAGRAPH}>")
    return normalise.item(
        t, original_id=F.col("conv_id"), question=F.get("ts", F.lit(0))["text"], answer=F.element_at("ts", -1)["text"], hop_count=F.greatest(F.size("users"), F.lit(2)), sub_questions=F.transform("users", lambda x: x["text"]),
        supporting_paragraphs=F.when(bare, none).otherwise(F.transform("users", lambda x, k: para(x, True, k + 1)).cast(f"array<{normalise.PARAGRAPH}>")), distractor_paragraphs=F.when(bare, none).otherwise(F.transform("others", lambda x: para(x, False, F.lit(None))).cast(f"array<{normalise.PARAGRAPH}>")),
        task_shared_items=F.transform("users", lambda x, k: F.struct((k + 1).cast("int").alias("hop_index"), texts.first_sentence(x["text"]).alias("text"), normalise.pid(x["turn"]).alias("source_paragraph_id"))), dataset=F.lit("hotpotqa"), qa_type=F.lit("bridge"),
    )


def built(spark, sf, store=False):
    i = checkpoint(items(spark, sf))
    r = F.col("original_id").cast("long") % 10
    sealed = readers.restricted_entries(i, "qa").select("original_id", F.inline("entries")).select("original_id", "content", "confidence", "source", F.create_map(F.lit("entry_kind"), "kind").alias("metadata"))
    return assembly.build(i, F.when(r < 7, "train").when(r < 8, "dev").otherwise("test"), restricted=sealed, store=store)


@query("q75_episode_build", f"""{FLOW_SQL} SELECT episode_id, er.hops, nodes AS n_nodes, edges AS n_edges, (CASE WHEN bare THEN 0 ELSE turns END + coalesce(shared, 0) + nodes + CASE WHEN s4 AND NOT bare THEN turns ELSE 0 END)::BIGINT AS n_memory, nodes AS n_agents,
    (CASE WHEN bare THEN 0 ELSE u END + coalesce(shared, 0))::BIGINT AS n_gold, (CASE WHEN bare THEN 0 ELSE u END * nodes + coalesce(needed, 0))::BIGINT AS n_required, rho, label, CASE WHEN bare THEN 'workspace_empty' ELSE '' END AS rules
    FROM er JOIN nc USING (graph_type, hops) JOIN ec USING (graph_type, hops) LEFT JOIN sc USING (episode_id)""")
def q75(spark, sf):
    """O-105, O-115, O-150: every conversation under every graph type, assembled and checked; episodes that break a rule name it."""
    p = built(spark, sf, store=True)
    _, bad = assembly.check(p)
    n = lambda rows, name: rows.groupBy("episode_id").agg(F.count(F.lit(1)).alias(name))
    gold = p.gold.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_gold"), F.sum(F.size("required_by")).alias("n_required"))
    out = p.episodes.select("episode_id", "hops", "rho", "label")
    for more in (n(p.nodes, "n_nodes"), n(p.edges, "n_edges"), n(p.memory, "n_memory"), n(p.agents, "n_agents"), gold, bad):
        out = out.join(more, "episode_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("episode_id", "hops", *(zero(c) for c in ("n_nodes", "n_edges", "n_memory", "n_agents", "n_gold", "n_required")), "rho", "label", F.coalesce(F.array_join("rules", ","), F.lit("")).alias("rules"))


@query("q76_requests_per_node", f"""{FLOW_SQL}, rq AS (SELECT er.*, tn.node, tn.node_type, CASE tn.node_type WHEN 'PLANNER' THEN ts[1] WHEN 'SOLVER' THEN CASE WHEN u > 0 THEN us[least(hop, u)] ELSE ts[1] END ELSE '{assembly.CREDIBILITY.replace("'", "''")}' END AS q FROM er JOIN tn USING (graph_type, hops))
    SELECT 'req_' || episode_id || '_' || node AS request_id, lower(node_type) AS role, md5(coalesce(q, '')) AS query_md5, 'task/' || episode_id || '/' || node || '/private task/' || episode_id || '/shared workspace/hotpotqa/semantic' || CASE WHEN node_type = 'VERIFIER' THEN ' task/' || episode_id || '/restricted' ELSE '' END AS scopes,
    CASE node_type WHEN 'SOLVER' THEN 'episodic,semantic,artifact' ELSE 'episodic,semantic' END AS types, CASE node_type WHEN 'VERIFIER' THEN 2 ELSE 1 END AS clearance, node_type = 'VERIFIER' AS audit FROM rq""")
def q76(spark, sf):
    """O-102."""
    r = built(spark, sf).requests
    return r.select("request_id", "role", F.md5("query").alias("query_md5"), F.array_join(F.concat("private", "shared", "workspace", "governed"), " ").alias("scopes"), F.array_join("types", ",").alias("types"), "policy.clearance", "policy.audit")


@query("q77_ground_truth_rows", f"""{FLOW_SQL}, g AS (SELECT episode_id, unnest(range(0, u)) AS k, nodes AS needed FROM er JOIN nc USING (graph_type, hops) WHERE NOT bare)
    SELECT episode_id || ':workspace_semantic:g' || k AS memory_id, needed::BIGINT AS n_required, (k + 1)::INT AS hop FROM g UNION ALL SELECT episode_id || ':task_shared_episodic:' || node, needed::BIGINT, hop FROM sh""")
def q77(spark, sf):
    """O-103 over assembled episodes."""
    return built(spark, sf).gold.select("memory_id", F.size("required_by").cast("long").alias("n_required"), "hop")


@query("q78_rho_by_graph_type", f"{RHO_SQL} SELECT graph_type, count(*) AS n, round_even(sum(round(rho * 10000)::BIGINT)::DOUBLE / count(*), 0) / 10000 AS mean, min(rho) AS low, max(rho) AS high FROM er GROUP BY 1")
def q78(spark, sf):
    """O-92."""
    return q46(spark, sf).groupBy("graph_type").agg(F.count(F.lit(1)).alias("n"), rules.mean_of("rho").alias("mean"), F.min("rho").alias("low"), F.max("rho").alias("high"))


@query("q79_dataset_report", f"""{FLOW_SQL}, gr AS (SELECT er.*, coalesce(shared, 0) > 0 OR (NOT bare AND u > 0) AS has FROM er LEFT JOIN sc USING (episode_id)),
    gk AS (SELECT rho, unnest(['all', 'subset', 'graph_type', 'hops', 's4', 'gold']) AS grain, unnest(['', label, graph_type, hops::VARCHAR, s4::VARCHAR, has::VARCHAR]) AS key FROM gr)
    SELECT grain, key, count(*) AS n, round_even(sum(round(rho * 10000)::BIGINT)::DOUBLE / count(*), 0) / 10000 AS mean, round_even(stddev_pop(rho), 4) AS std, min(rho) AS low, max(rho) AS high FROM gk GROUP BY ALL""")
def q79(spark, sf):
    """O-84."""
    return assembly.report(built(spark, sf))


@query("q80_metadata_contract", f"""{ARTIFACTS_SQL}, m AS (SELECT memory_id, (CASE WHEN topo_index % 14 = 2 THEN ['dataset'] ELSE [] END || CASE WHEN topo_index % 9 = 4 THEN ['hop_index'] ELSE [] END) AS missing FROM ar) SELECT memory_id, array_to_string(missing, ',') AS missing FROM m WHERE len(missing) > 0""")
def q80(spark, sf):
    """O-118, S-3; keys are taken away on purpose."""
    a = chain_artifacts(spark, sf)[2]
    t = F.col("topo_index")
    full = F.create_map(*[x for k in episodes.META_KEYS for x in (F.lit(k), F.lit("v"))])
    gone = F.concat(F.when(t % 14 == 2, F.array(F.lit("dataset"))).otherwise(F.array().cast("array<string>")), F.when(t % 9 == 4, F.array(F.lit("hop_index"))).otherwise(F.array().cast("array<string>")))
    return rules.contract(a.withColumn("metadata", F.map_filter(full, lambda k, v: ~F.array_contains(gone, k)))).select("memory_id", F.array_join("missing", ",").alias("missing"))


@query("q81_node_slots", f"""{ARTIFACTS_SQL}, h AS (SELECT episode, node, list_sort(list(DISTINCT slot)) AS slots FROM ar WHERE topo_index % 10 <> 7 GROUP BY ALL), w AS (SELECT node_type, list_sort(list(slot)) AS want FROM sl GROUP BY 1)
    SELECT cn.episode, cn.node::VARCHAR AS node, array_to_string(coalesce(slots, []), ',') AS slots, array_to_string(want, ',') AS expected FROM cn JOIN w USING (node_type) LEFT JOIN h ON h.episode = cn.episode AND h.node = cn.node WHERE coalesce(slots, []) <> want""")
def q81(spark, sf):
    """S-3: slots of a node against those of its type; every tenth artifact is lost on purpose."""
    nodes, _, a = chain_artifacts(spark, sf)
    return rules.slot_sets(a.where("topo_index % 10 <> 7"), nodes, ["episode"]).select("episode", "node", F.array_join("slots", ",").alias("slots"), F.array_join("expected", ",").alias("expected"))


@query("q82_uniform_dev_split", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS n, count(*) OVER () AS k FROM documents) WHERE n <= greatest(1, floor(k * 0.1))")
def q82(spark, sf):
    """O-116, the draw without strata."""
    return rules.stratified(table(spark, sf, "documents").select("doc_id"), None, "doc_id", 0.1, "42").select("doc_id")


@query("q83_split_registry", "WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS n, count(*) OVER (PARTITION BY source) AS k FROM documents), a AS (SELECT item_id AS asked FROM benchmark UNION SELECT -item_id - 1 FROM benchmark) SELECT asked, CASE WHEN doc_id IS NULL THEN NULL WHEN n <= greatest(1, floor(k * 0.1)) THEN 'dev' ELSE 'train' END AS split FROM a LEFT JOIN d ON doc_id = asked")
def q83(spark, sf):
    """O-117: the split of each id that is asked for; unknown ids have none."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    known = rules.registry(d, rules.stratified(d, "source", "doc_id", 0.1, "42"), "doc_id")
    asked = table(spark, sf, "benchmark").select("item_id")
    asked = asked.select(F.col("item_id").alias("asked")).union(asked.select(-F.col("item_id") - 1)).distinct()
    return asked.join(known, F.col("asked") == F.col("doc_id"), "left").select("asked", "split")


MERGE_SQL = "md5(concat_ws('|', array_to_string(list_sort(visibility), ','), clearance::VARCHAR, array_to_string(list_sort(zones), ',')))"


@query("q84_merge_controls", f"""{R}, k AS (SELECT *, count(*) OVER (PARTITION BY coalesce(main_scope, private_scope)) AS a4, count(*) OVER (PARTITION BY coalesce(main_scope, private_scope), {TYPES_SQL}, {MERGE_SQL}) AS a5, count(*) OVER () AS a2 FROM v_requests),
    s AS (SELECT unnest(['a2', 'a4', 'a5']) AS variant, unnest([a2 > 1, a4 > 1, a5 > 1]) AS shared FROM k WHERE audit) SELECT variant, count(*) AS conflicts, count(*) FILTER (shared) AS merged, round(count(*) FILTER (shared)::DOUBLE / count(*), 6) AS rate FROM s GROUP BY 1""")
def q84(spark, sf):
    """The control that merges all requests, by scope, and by scope, types and policy: how many requests that must not share do."""
    r = views.requests(spark, sf)
    marks = r.where("policy.audit").select("request_id")
    out = None
    for name, routed in (("a2", routing.forced(r)), ("a4", routing.scope_only(r)), ("a5", routing.hierarchical(r))):
        shown = routed.select("request_id", F.when(F.col("mode") == "shared", F.col("bucket")).alias("bucket"), "mode")
        one = evaluation.false_merges(shown, marks).select(F.lit(name).alias("variant"), "conflicts", "merged", F.round("rate", 6).alias("rate"))
        out = one if out is None else out.unionByName(one)
    return out


@query("q85_run_rates", f"""{variant_sql("a4")}, rt AS (SELECT count(DISTINCT request_id) AS requests, count(memory_id) AS shown, count(DISTINCT memory_id) AS kinds FROM res), ft AS (SELECT count(*) FILTER (fallback) AS fired FROM (SELECT request_id, any_value(fallback) AS fallback FROM res GROUP BY 1)),
    bt2 AS (SELECT count(*) AS pairs, count(*) FILTER (n > 1) AS twice FROM (SELECT bucket, memory_id, count(*) AS n FROM res WHERE bucket IS NOT NULL AND memory_id IS NOT NULL GROUP BY ALL))
    SELECT requests, shown, round(1 - kinds::DOUBLE / shown, 6) AS duplicate_rate, round(twice::DOUBLE / greatest(pairs, 1), 6) AS reuse_rate, round(fired::DOUBLE / requests, 6) AS trigger_rate FROM rt, ft, bt2""")
def q85(spark, sf):
    """Rates of a run: rows shown again, rows of a bucket that several of its members use, requests that fell back."""
    return evaluation.rates(checkpoint(run(spark, sf, "a4"))).select("requests", "shown", *(F.round(c, 6).alias(c) for c in ("duplicate_rate", "reuse_rate", "trigger_rate")))


TREE_SQL = f"WITH {SCOPE_TREE_SQL}, tr AS (SELECT scope AS scope_id, parent, CASE WHEN scope LIKE 'session/%' THEN 'session' ELSE 'task_shared' END AS type FROM sc UNION ALL SELECT 'workspace/' || r_regionkey, NULL, 'workspace' FROM region)"


@query("q86_scope_registry", f"{TREE_SQL}, ch AS (SELECT parent, count(*) AS k FROM tr WHERE parent IS NOT NULL AND NOT scope_id LIKE 'order/%5' GROUP BY 1) SELECT tr.scope_id, tr.type, coalesce(k, 0) AS children FROM tr LEFT JOIN ch ON ch.parent = tr.scope_id WHERE tr.scope_id LIKE '%/1%' AND NOT tr.scope_id LIKE 'order/%5'")
def q86(spark, sf):
    """O-58, O-134, O-15: a registry whose scopes ending in 5 of one kind are taken out, with children, of the ids that match a pattern."""
    t = scope_tree(spark, sf)
    known = scopes.register(scopes.unregister(t, t.where("scope_id LIKE 'order/%5'")), t.where("type = 'workspace'"))
    return scopes.matching(known, "*/1*").select("scope_id", "type").join(scopes.children(known), "scope_id")


@query("q103_scope_patterns", f"""WITH {SCOPE_TREE_SQL}, p AS (SELECT '*/' || c_custkey || '?' AS pattern FROM customer WHERE c_custkey % 50 = 7 UNION ALL SELECT 'ord*' || c_custkey || '[0-4]*' FROM customer WHERE c_custkey % 90 = 11 UNION ALL SELECT 'task/' || c_custkey FROM customer WHERE c_custkey % 30 = 3 UNION ALL SELECT '*s*n/' || n_nationkey FROM nation)
    SELECT pattern, scope AS scope_id FROM p JOIN sc ON CASE WHEN contains(pattern, '*') THEN scope GLOB pattern ELSE scope = pattern END""")
def q103(spark, sf):
    """O-15: a table of patterns against all scopes."""
    key = F.col("c_custkey")
    of = lambda rest, *text: table(spark, sf, "customer").where((key % rest[0]) == rest[1]).select(F.concat(*text).alias("pattern"))
    p = of((50, 7), F.lit("*/"), key.cast("string"), F.lit("?")).unionByName(of((90, 11), F.lit("ord*"), key.cast("string"), F.lit("[0-4]*"))).unionByName(of((30, 3), F.lit("task/"), key.cast("string")))
    p = p.unionByName(table(spark, sf, "nation").select(F.concat(F.lit("*s*n/"), F.col("n_nationkey").cast("string")).alias("pattern")))
    return scopes.find(scope_tree(spark, sf).where("parent IS NOT NULL"), p)


@query("q87_slice_index", f"""{views.with_views(views.MEMORY_SQL, views.REQUESTS_SQL)}, s AS (SELECT ord, coalesce(main_scope, private_scope) AS p, {TYPES_SQL} AS t, array_to_string(list_sort(visibility), ',') AS v, clearance, {SCOPES_SQL} AS scopes, types, visibility AS asked FROM v_requests),
    f AS (SELECT p, t, v, clearance, count(*) AS requests, arg_min(scopes, ord) AS scopes, arg_min(types, ord) AS types, arg_min(asked, ord) AS asked FROM s GROUP BY ALL), i AS (SELECT *, 'slice_' || substr(md5(concat_ws('|', p, t, v, clearance::VARCHAR)), 1, 8) AS slice_id FROM f)
    SELECT slice_id, requests, count(m.memory_id) AS rows FROM i LEFT JOIN v_memory m ON list_contains(i.scopes, m.scope_id) AND list_contains(i.types, m.memory_type) AND list_has_any(m.visibility, i.asked) GROUP BY ALL""")
def q87(spark, sf):
    """O-14, O-14a, O-136: the slices that requests ask for, each once, and the memory rows in them."""
    s = checkpoint(scopes.slices(routing.keyed(views.requests(spark, sf))))
    n = scopes.matches(s, views.memory(spark, sf)).groupBy("slice_id").agg(F.count(F.lit(1)).alias("rows"))
    return s.join(n, "slice_id", "left").select("slice_id", "requests", F.coalesce("rows", F.lit(0)).alias("rows"))


#: What is broken in the episodes of each twentieth part of the conversations, for one rule each.
BREAKS = ("enum", "conflict", "node_type", "unique_id", "shared_owner", "agent_policy", "query_empty", "scope_lists", "version", "clearance", "gold", "created_at", "rollout", "divergent", "parent", "slots", "produced", "audit")


def broken(rows):
    """Episodes as written, each with what its conversation's number tells to break."""
    n, first = F.col("original_id").cast("long") % 20, lambda xs, f: F.transform(xs, lambda x, k: F.when(k == 0, f(x)).otherwise(x))
    at = lambda rule, c, new: F.when(n == BREAKS.index(rule), new).otherwise(c)
    e, g, a, r, nodes = (F.col(c) for c in ("memory_entries", "ground_truth", "agents", "retrieval_requests", "nodes"))
    shared = F.transform(e, lambda x: F.when(F.startswith(x["scope_layer"], F.lit("task_shared")), x.withField("visibility", F.lit("owner"))).otherwise(x))
    e = at("unique_id", at("shared_owner", at("clearance", at("parent", e, first(e, lambda x: x.withField("parent_artifact_ids", F.array(F.lit("nowhere"))))), first(e, lambda x: x.withField("required_clearance", F.lit(4)))), shared), F.concat(e, F.slice(e, 1, 1)))
    e = at("slots", at("audit", e, F.filter(e, lambda x: ~x["slot"].eqNullSafe(F.lit("audit_report")))), F.filter(e, lambda x: ~x["slot"].eqNullSafe(F.lit("scratch"))))
    nodes = at("node_type", at("produced", nodes, first(nodes, lambda x: x.withField("produced_artifact_ids", F.array(F.lit("nowhere"))))), first(nodes, lambda x: x.withField("node_type", F.lower(x["node_type"]))))
    return rows.withColumns({
        "memory_entries": e, "nodes": nodes, "rho_subset": at("enum", F.col("rho_subset"), F.lit("S9")), "policy_conflict": at("conflict", F.col("policy_conflict"), ~F.col("policy_conflict")),
        "agents": at("agent_policy", a, first(a, lambda x: x.withField("policy", x["policy"].withField("clearance", F.lit(None).cast("int"))))), "retrieval_requests": at("query_empty", at("scope_lists", r, first(r, lambda x: x.withField("governed", F.lit(None).cast("array<string>")))), first(r, lambda x: x.withField("query", F.lit("")))),
        "ground_truth": at("gold", g, first(g, lambda x: x.withField("memory_id", F.lit("nowhere")))), "question": F.when((n == BREAKS.index("divergent")) & (F.col("graph_type") == "FORK"), "another").otherwise(F.col("question")),
        "meta": F.col("meta").withField("schema_version", at("version", F.col("meta.schema_version"), F.lit("0.9"))).withField("created_at", at("created_at", F.col("meta.created_at"), F.lit("yesterday"))).withField("rollout_llm", at("rollout", F.lit("template"), F.lit(None).cast("string"))),
    })


def written(spark, sf):
    """Assembled episodes with their artifacts, as they are written."""
    p = built(spark, sf, store=True)
    _, bad = assembly.check(p)
    p = assembly.without(p, checkpoint(bad))
    return assembly.nested(p, assembly.artifacts(p))


@query("q88_episode_audit", f"""{FLOW_SQL}, b AS (SELECT er.*, conv_id % 20 AS n, coalesce(shared, 0) AS shared FROM er LEFT JOIN sc USING (episode_id) WHERE NOT bare), r(n, rule, severity) AS (VALUES {", ".join(f"({k}, '{x}', '{'warning' if x == 'query_empty' else 'error'}')" for k, x in enumerate(BREAKS))})
    SELECT rule, severity, episode_id AS key FROM b JOIN r USING (n) WHERE rule NOT IN ('divergent', 'shared_owner', 'gold', 'slots', 'audit') UNION ALL SELECT 'divergent', 'error', conv_id::VARCHAR FROM b WHERE n = {BREAKS.index("divergent")} GROUP BY conv_id
    UNION ALL SELECT 'shared_owner', 'error', episode_id FROM b WHERE n = {BREAKS.index("shared_owner")} AND shared > 0 UNION ALL SELECT 'gold', 'error', episode_id FROM b WHERE n = {BREAKS.index("gold")} AND (u > 0 OR shared > 0)
    UNION ALL SELECT unnest(['slots', 'produced']), 'error', episode_id FROM b WHERE n = {BREAKS.index("slots")} UNION ALL SELECT unnest(['slots', 'produced', 'audit']), 'error', episode_id FROM b WHERE n = {BREAKS.index("audit")} AND s4
    UNION ALL SELECT 'slots', 'error', episode_id FROM b WHERE n = {BREAKS.index("node_type")} UNION ALL SELECT 's4_missing', 'warning', episode_id FROM b WHERE false""")
def q88(spark, sf):
    """O-114 over whole episodes, broken on purpose for each rule."""
    return rules.audit_episodes(broken(written(spark, sf))).distinct()


@query("q89_nested_round_trip", f"""{FLOW_SQL} SELECT episode_id, nodes AS n_nodes, (turns + coalesce(shared, 0) + nodes + CASE WHEN s4 THEN turns ELSE 0 END + 3 * nodes)::BIGINT AS n_memory, nodes AS n_requests, (3 * nodes)::BIGINT AS n_produced, label FROM er JOIN nc USING (graph_type, hops) LEFT JOIN sc USING (episode_id) WHERE NOT bare AND NOT (s4 AND split <> 'test')""")
def q89(spark, sf):
    """O-06b to O-06e: episodes written as JSON lines by shard and read again."""
    rows = written(spark, sf)  # read once, so they are no table beside the files
    path = scratch(spark, "episodes")
    assembly.write(rows, path, compression="gzip")
    back = assembly.read(spark, path, rows.schema)
    made = F.aggregate(F.transform("nodes", lambda x: F.size(x["produced_artifact_ids"])), F.lit(0), lambda s, x: s + x)
    return back.select("episode_id", F.size("nodes").cast("long").alias("n_nodes"), F.size("memory_entries").cast("long").alias("n_memory"), F.size("retrieval_requests").cast("long").alias("n_requests"), made.cast("long").alias("n_produced"), F.col("rho_subset").alias("label"))


_NL = " || chr(10) || "
_CONCLUDE = "CASE WHEN trim(split_part(coalesce(us[{h}], ''), '.', 1)) <> '' THEN trim(split_part(us[{h}], '.', 1)) ELSE '[conclusion] node=' || {n} || ' hop=' || {h} || ': (no gold oracle available)' END"
ROLLOUT_SQL = f"""{FLOW_SQL}, qs AS (SELECT *, trim(coalesce(ts[1], '')) AS q FROM er WHERE NOT bare),
    cs AS (SELECT episode_id, string_agg('  - ' || left({_CONCLUDE.format(h="hop", n="node")}, 120), chr(10) ORDER BY hop) AS bullets, count(*) AS k FROM qs JOIN tn USING (graph_type, hops) WHERE s4 AND node_type = 'SOLVER' GROUP BY 1),
    pa AS (SELECT graph_type, hops, dst AS node, count(*) AS parents FROM te GROUP BY ALL),
    ar AS (SELECT qs.*, tn.node, tn.node_type, tn.hop, unnest(CASE tn.node_type WHEN 'PLANNER' THEN ['query_intent', 'scratch', 'plan'] WHEN 'SOLVER' THEN ['query_intent', 'scratch', 'conclusion'] ELSE ['query_intent', 'scratch', 'audit_report'] END) AS slot FROM qs JOIN tn USING (graph_type, hops)),
    tx AS (SELECT ar.episode_id, node, slot, node_type, hop, us, graph_type, hops, trim(coalesce(us[hop], q)) AS a, CASE
      WHEN slot = 'query_intent' AND node_type = 'PLANNER' THEN '[query_intent] node=planner'{_NL}'I must decompose: ' || q{_NL}'I need to retrieve: high-level topical context to decide the hop structure.'
      WHEN slot = 'scratch' AND node_type = 'PLANNER' THEN '[scratch] node=planner'{_NL}'Decomposing the question into sequential hops: ' || q
      WHEN slot = 'plan' THEN 'Plan for question: ' || q || CASE WHEN u > 0 THEN list_aggregate(list_transform(us, lambda x, k: chr(10) || '  - hop ' || k || ': ' || trim(x)), 'string_agg', '') ELSE chr(10) || '  - decompose into ' || hops || ' sequential solver hops.' END
      WHEN slot = 'query_intent' AND node_type = 'SOLVER' THEN '[query_intent] node=' || node || ' hop=' || hop{_NL}'I must answer: ' || trim(coalesce(us[hop], q)){_NL}'I need to retrieve: facts that resolve this sub-question, plus any upstream conclusions from my ancestors.'
      WHEN slot = 'scratch' AND node_type = 'SOLVER' THEN '[scratch] node=' || node || ' hop=' || hop{_NL}'Considering sub-question: ' || trim(coalesce(us[hop], q)){_NL}'Drafting reasoning based on retrieved evidence and ancestor conclusions.'
      WHEN slot = 'conclusion' THEN {_CONCLUDE.format(h="hop", n="node")}
      WHEN slot = 'query_intent' THEN '[query_intent] node=verifier'{_NL}'I must check provenance and cross-conclusion consistency.'{_NL}'I need to retrieve: restricted audit traces and all task_shared conclusions.'
      WHEN slot = 'scratch' THEN '[scratch] node=verifier'{_NL}'Inspecting each solver''s conclusion for source-alignment.'
      ELSE '[audit_report] dataset=hotpotqa'{_NL}'Reviewed ' || k || ' solver conclusion(s):'{_NL}bullets{_NL}'Verdict: provenance checks applied, no inconsistencies flagged.' END AS text, k FROM ar LEFT JOIN cs USING (episode_id))"""


@query("q90_rollout_texts", f"""{ROLLOUT_SQL} SELECT tx.episode_id || ':' || tx.node || ':' || slot AS memory_id, md5(text) AS text_md5, slot = 'conclusion' AND trim(split_part(coalesce(us[hop], ''), '.', 1)) <> '' AS gold,
    coalesce(CASE WHEN node_type = 'VERIFIER' THEN k ELSE parents END, 0)::BIGINT AS n_parents FROM tx LEFT JOIN pa ON pa.graph_type = tx.graph_type AND pa.hops = tx.hops AND pa.node = tx.node""")
def q90(spark, sf):
    """O-107, O-109, O-110: every artifact of every episode with its template text."""
    p = built(spark, sf, store=True)
    p = assembly.without(p, checkpoint(assembly.check(p)[1]))
    return assembly.artifacts(p).select("memory_id", F.md5("text").alias("text_md5"), "gold", F.size("parents").cast("long").alias("n_parents"))


def digest(rows):
    """A writer that tells its prompt and its parents' texts by a digest, and fails for every seventh place."""
    if any(r["place"] % 7 == 3 for r in rows):
        raise ValueError("no text")
    return [hashlib.md5("\n".join([r["prompt"] or "", *r["parents"]]).encode()).hexdigest() for r in rows]


@query("q99_rollout_levels", f"""{views.with_views(views.CHAIN_SQL).replace("WITH", "WITH RECURSIVE", 1)}, cn AS (SELECT episode, node, coalesce(text, '') AS text, row_number() OVER (PARTITION BY episode ORDER BY node) - 1 AS lev FROM v_chain),
    ro AS (SELECT episode, node, lev, CASE WHEN node % 7 = 3 THEN 'template ' || node ELSE md5(text) END AS now, NULL::VARCHAR AS before FROM cn WHERE lev = 0
        UNION ALL SELECT c.episode, c.node, c.lev, CASE WHEN c.node % 7 = 3 THEN 'template ' || c.node ELSE md5(concat_ws(chr(10), c.text, r.before, r.now)) END, r.now FROM ro r JOIN cn c ON c.episode = r.episode AND c.lev = r.lev + 1)
    SELECT episode, node::VARCHAR AS node, lev::INT AS level, least(lev, 2)::INT AS parents, now AS text, CASE WHEN node % 7 = 3 THEN 'template' ELSE 'model' END AS made FROM ro""")
def q99(spark, sf):
    """O-107: conversations rolled out level by level; a turn reads the two turns before it."""
    nodes, edges = chain_graph(spark, sf)
    on = edges.toDF("episode", "mid", "dst").join(edges.toDF("episode", "src", "mid"), ["episode", "mid"]).select("episode", "src", "dst")
    n = nodes.select("episode", "node", F.col("turn").alias("place"), F.col("text").alias("prompt"), F.concat(F.lit("template "), "node").alias("template"))
    return rollout.rollout(n, edges.unionByName(on), ["episode"], digest)


@query("q102_s4_draw", f"""{RHO_SQL}, o AS (SELECT episode, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || episode), episode) AS nth FROM er), t AS (SELECT *, row_number() OVER (ORDER BY nth, label) AS turn, count(*) OVER () AS n FROM o)
    SELECT label, episode FROM t WHERE turn <= n // 2""")
def q102(spark, sf):
    """A draw of half of all episodes, a third from each subset as long as it has any."""
    e = checkpoint(q46(spark, sf).select("episode", graphs.label(F.col("rho")).alias("label")))
    return rules.exclusive_draw(e, e.count() // 2, "episode").select("label", "episode")
