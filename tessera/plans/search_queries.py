"""Queries over vectors, the memory table and access policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.functions import policies
from tessera.operators import memory as M
from tessera.operators import graphs, pruned, routing, search
from tessera.plans import views
from tessera.plans.registry import query
from tessera.session import table

AS_OF_SQL = f"TIMESTAMP '{views.AS_OF}'"
EVERY, K = views.EVERY, 10
DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def as_of():
    return F.timestamp_seconds(F.lit(views.AS_OF_SECONDS))


def flat(spark, sf, kind):
    """Top K of the stated query set, each vector whose id is divisible by EVERY, over all rows, in blocks."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    top = search.nearest(e.where(F.col("id") % EVERY == 0), e, K, kind)
    return top.select("qid", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def flat_sql(score):
    return f"""
    WITH q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % {EVERY} = 0),
    s AS (SELECT qid, vec_id, round({score}, 9) AS score FROM embeddings e, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT qid, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= {K}"""


_d = DOT.format(a="q", b="embedding")
_n = "sqrt(list_dot_product({x}::DOUBLE[], {x}::DOUBLE[]))"
COS_SQL = f"{_d} / ({_n.format(x='q')} * {_n.format(x='embedding')})"


@query("q01_topk_cosine", flat_sql(COS_SQL))
def q01(spark, sf):
    return flat(spark, sf, "cosine")


@query("q02_topk_dot", flat_sql(_d))
def q02(spark, sf):
    return flat(spark, sf, "dot")


@query("q03_topk_euclid", flat_sql(f"-(list_dot_product(q::DOUBLE[], q::DOUBLE[]) + list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) - 2 * {_d})"))
def q03(spark, sf):
    return flat(spark, sf, "euclid")


def scoped(spark, sf, policy):
    r = routing.keyed(views.requests(spark, sf))
    u = search.units(r, F.col("all_scopes"), F.col("policy.visibility") if policy else None)
    return search.search(u, views.memory(spark, sf), 20).select(F.col("unit").alias("request_id"), "memory_id", "rank", F.round("score", 6).alias("score"))


def scoped_sql(policy):
    ok = " AND list_has_any(m.visibility, r.visibility)" if policy else ""
    cos = COS_SQL.replace("embedding", "m.embedding").replace("q::", "r.qvec::")
    return f"""{views.with_views(views.MEMORY_SQL, views.REQUESTS_SQL)},
    s AS (SELECT request_id, memory_id, round({cos}, 9) AS score FROM v_requests r JOIN v_memory m
          ON (m.scope_id = r.main_scope OR m.scope_id = r.private_scope) AND list_contains(r.types, m.memory_type){ok}),
    k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, memory_id) AS rank FROM s)
    SELECT request_id, memory_id, rank, round(score, 6) AS score FROM k WHERE rank <= 20"""


@query("q04_policy_filtered_search", scoped_sql(True))
def q04(spark, sf):
    return scoped(spark, sf, True)


@query("q97_pruned_search", scoped_sql(True))
def q97(spark, sf):
    """The rows of q04, by blocks whose bounds leave most of them out where vectors lie in clusters."""
    r = routing.keyed(views.requests(spark, sf))
    found, _ = pruned.search(search.units(r, F.col("all_scopes"), F.col("policy.visibility")), pruned.build(views.memory(spark, sf)), 20)
    return found.select(F.col("unit").alias("request_id"), "memory_id", "rank", F.round("score", 6).alias("score"))


@query("q05_scope_type_filter", scoped_sql(False))
def q05(spark, sf):
    return scoped(spark, sf, False)


@query("q06_ttl_expired", f"{views.with_views(views.MEMORY_SQL)} SELECT memory_id, scope_id FROM v_memory WHERE ttl IS NOT NULL AND (epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / 1e6 > ttl")
def q06(spark, sf):
    return M.purge(views.memory(spark, sf), as_of())[1].select("memory_id", "scope_id")


@query("q07_cleanup_count", f"{views.with_views(views.MEMORY_SQL)}, x AS (SELECT coalesce(ttl IS NOT NULL AND (epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / 1e6 > ttl, false) AS gone FROM v_memory) SELECT count(*) FILTER (gone) AS purged, count(*) FILTER (NOT gone) AS kept FROM x")
def q07(spark, sf):
    gone = F.coalesce(policies.expired(F.col("created_at"), F.col("ttl"), as_of()), F.lit(False))
    return views.memory(spark, sf).agg(F.count_if(gone).alias("purged"), F.count_if(~gone).alias("kept"))


EVENT_AS_OF = "2024-03-01 00:00:00"


def newest(spark, sf):
    return F.lit(EVENT_AS_OF).cast("timestamp")


@query("q08_memory_filter_composite", f"""{views.with_views(views.EVENT_SQL)} SELECT memory_id, scope_id, memory_type, confidence FROM v_event
    WHERE memory_type IN ('episodic', 'working', 'artifact') AND list_has_any(visibility, ['team']) AND list_has_any(tags, ['u0', 'u1']) AND confidence >= 0.5
    AND (epoch_us(TIMESTAMP '{EVENT_AS_OF}') - epoch_us(created_at)) / 1e6 <= 5184000 AND contains(source, 'c') AND agent_id = 'a1' AND json_extract_string(metadata, '$.k') <> '7'""")
def q08(spark, sf):
    f = M.Filter(types=("episodic", "working", "artifact"), visibility=("team",), tags=("u0", "u1"), min_confidence=0.5, max_age_seconds=5184000, source="c", agent_id="a1")
    return views.events(spark, sf).where(f.column(newest(spark, sf)) & (F.get_json_object("metadata", "$.k") != "7")).select("memory_id", "scope_id", "memory_type", "confidence")


@query("q73_filter_scopes_metadata", f"""{views.with_views(views.EVENT_SQL)} SELECT memory_id, scope_id FROM v_event WHERE scope_id IN ('user/1', 'user/2', 'user/3', 'user/5', 'user/8', 'user/13') AND json_extract_string(metadata, '$.k')::INT BETWEEN 10 AND 19""")
def q73(spark, sf):
    """O-12: a filter for each of ten metadata values, over the same scopes."""
    e, scopes = views.events(spark, sf), ("user/1", "user/2", "user/3", "user/5", "user/8", "user/13")
    keep = [M.Filter(scopes=scopes, metadata={"k": str(k)}).column(newest(spark, sf)) for k in range(10, 20)]
    return e.where(reduce(lambda x, y: x | y, keep)).select("memory_id", "scope_id")


@query("q09_access_control", f"""{views.with_views(views.MEMORY_SQL, views.CHAIN_SQL)},
    ag AS (SELECT DISTINCT node, role FROM v_chain),
    en AS (SELECT *, CASE WHEN scope_id = 'task/alpha/shared' THEN 'task_shared_episodic' ELSE 'agent_private' END AS layer, vec_id % 8 AS source_node, CASE WHEN list_contains(visibility, 'restricted') THEN 2 ELSE 1 END AS need FROM v_memory)
    SELECT a.node, a.role, e.memory_id FROM ag a JOIN en e ON e.scope_id IN ('task/alpha/shared', 'session/current')
    WHERE (a.role <> 'solver' OR e.layer <> 'task_shared_episodic' OR e.source_node <= a.node)
      AND e.need <= CASE a.role WHEN 'verifier' THEN 2 ELSE 1 END AND NOT list_contains(e.tags, 'quarantine')""")
def q09(spark, sf):
    """What an agent may read depends on its place and role alone, so each pair of these over all conversations is one agent; its
    ancestors are those of its place along the edges of all conversations, and itself."""
    c = views.chain(spark, sf)
    edges = c.where("parent IS NOT NULL").select(F.lit(0).alias("graph"), F.col("parent").alias("src"), F.col("node").alias("dst")).distinct()
    above = graphs.ancestors(edges, ["graph"]).groupBy("node").agg(F.collect_set("ancestor").alias("above"))
    a = c.select("node", "role").distinct().join(above, "node", "left")
    ancestors = F.array_append(F.coalesce("above", F.array().cast("array<bigint>")), F.col("node"))
    a = a.select(F.struct("node", "role").alias("agent_id"), "role", F.array(F.lit("task/alpha/shared"), F.lit("session/current")).alias("scopes"), ancestors.alias("ancestors"), F.when(F.col("role") == "verifier", 2).otherwise(1).alias("clearance"), F.array(F.lit("quarantine")).alias("zones"))
    e = views.memory(spark, sf).select("memory_id", "scope_id", F.when(F.col("scope_id") == "task/alpha/shared", "task_shared_episodic").otherwise("agent_private").alias("layer"), (F.col("vec_id") % 8).alias("source_node"), F.when(F.array_contains("visibility", "restricted"), 2).otherwise(1).alias("required_clearance"), "tags", F.lit(False).alias("quarantined"))
    return M.accessible(a, e).select("agent_id.node", "agent_id.role", "memory_id")


PAGE = (50, 20)


@query("q10_page_parity", f"""{views.with_views(views.EVENT_SQL)},
    h AS (SELECT * FROM v_event ORDER BY confidence DESC, memory_id LIMIT {sum(PAGE)}), f AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, memory_id) AS n FROM h WHERE source <> 'error'),
    p AS (SELECT * FROM f WHERE n > {PAGE[1]} AND n <= {sum(PAGE)}) SELECT memory_id, confidence, row_number() OVER (ORDER BY created_at DESC, memory_id) AS at FROM p""")
def q10(spark, sf):
    order, sort = [F.col("confidence").desc(), F.col("memory_id")], [F.col("created_at").desc(), F.col("memory_id")]
    return M.page(views.events(spark, sf), F.col("source") != "error", order, sort, *PAGE, parity=True).select("memory_id", "confidence", "at")


@query("q11_page_intent", f"""{views.with_views(views.EVENT_SQL)} SELECT memory_id, confidence, row_number() OVER (ORDER BY created_at DESC, memory_id) AS at FROM
    (SELECT * FROM v_event WHERE source <> 'error' ORDER BY created_at DESC, memory_id LIMIT {PAGE[0]} OFFSET {PAGE[1]})""")
def q11(spark, sf):
    sort = [F.col("created_at").desc(), F.col("memory_id")]
    return M.page(views.events(spark, sf), F.col("source") != "error", sort, sort, *PAGE).select("memory_id", "confidence", "at")


@query("q12_store_stats_grouping_sets", f"""{views.with_views(views.EVENT_SQL)} SELECT CASE WHEN grouping(scope_id) = 0 THEN 'scope' WHEN grouping(memory_type) = 0 THEN 'type' ELSE 'all' END AS grain,
    coalesce(scope_id, memory_type, '') AS key, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM v_event GROUP BY GROUPING SETS ((), (scope_id), (memory_type))""")
def q12(spark, sf):
    return M.statistics(views.events(spark, sf)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("q13_update_merge", f"""{views.with_views(views.EVENT_SQL)} SELECT memory_id, CASE WHEN event_id % 5 = 0 THEN confidence / 2 ELSE confidence END AS confidence,
    CASE WHEN event_id % 10 = 0 THEN 'edited' ELSE source END AS source, CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '{EVENT_AS_OF}' ELSE created_at END AS updated_at FROM v_event""")
def q13(spark, sf):
    rows = views.events(spark, sf)
    changes = rows.where("event_id % 5 = 0").select("memory_id", (F.col("confidence") / 2).alias("confidence"), F.when(F.col("event_id") % 10 == 0, "edited").alias("source"))
    return M.update(rows, changes, newest(spark, sf)).select("memory_id", "confidence", "source", "updated_at")


@query("q14_upsert_last_wins", f"""{views.with_views(views.EVENT_SQL)}, b AS (SELECT memory_id, scope_id, confidence, 0 AS ord FROM v_event UNION ALL
    SELECT CASE WHEN event_id % 6 = 0 THEN 'n' || memory_id ELSE memory_id END, 'moved', confidence + 1, 1 FROM v_event WHERE event_id % 3 = 0)
    SELECT memory_id, scope_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY ord DESC) AS n FROM b) WHERE n = 1""")
def q14(spark, sf):
    rows = views.events(spark, sf).select("memory_id", "scope_id", "confidence", F.lit(0).alias("ord"), "event_id")
    new = rows.where("event_id % 3 = 0").select(F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("n"), "memory_id")).otherwise(F.col("memory_id")).alias("memory_id"), F.lit("moved").alias("scope_id"), (F.col("confidence") + 1).alias("confidence"), F.lit(1).alias("ord"), "event_id")
    return M.upsert(rows, new).select("memory_id", "scope_id", "confidence")


@query("q15_delete_anti", f"{views.with_views(views.EVENT_SQL)} SELECT memory_id, scope_id FROM v_event WHERE source <> 'error'")
def q15(spark, sf):
    rows = views.events(spark, sf)
    return M.delete(rows, rows.where("source = 'error'")).select("memory_id", "scope_id")


@query("q61_list_by_type", f"{views.with_views(views.EVENT_SQL)} SELECT memory_id, place FROM (SELECT memory_id, row_number() OVER (PARTITION BY memory_type ORDER BY created_at, memory_id) AS place FROM v_event) WHERE place <= 100")
def q61(spark, sf):
    """O-46: what a search without a vector lists: the first 100 of each type."""
    return search.top_k(views.events(spark, sf), ["memory_type"], 100, [F.col("created_at"), F.col("memory_id")], "place").select("memory_id", "place")


@query("q94_delete_counts", f"""{views.with_views(views.EVENT_SQL)}, a AS (SELECT memory_id FROM v_event WHERE event_id % 9 = 0 UNION SELECT 'x' || memory_id FROM v_event WHERE event_id % 90 = 0)
    SELECT (SELECT count(*) FROM a JOIN v_event USING (memory_id)) AS deleted, (SELECT count(*) FROM a ANTI JOIN v_event USING (memory_id)) AS missing, count(*) AS entries, count(DISTINCT scope_id) AS scopes, count(DISTINCT memory_type) AS types FROM v_event WHERE event_id % 9 <> 0""")
def q94(spark, sf):
    """O-74, O-122: what a delete takes and misses, and what is left."""
    e = views.events(spark, sf)
    ids = e.where("event_id % 9 = 0").select("memory_id").union(e.where("event_id % 90 = 0").select(F.concat(F.lit("x"), "memory_id")))
    return M.deleted(e, ids).withColumn("one", F.lit(1)).join(M.totals(M.delete(e, ids)).withColumn("one", F.lit(1)), "one").drop("one")


@query("q101_relevance_windows", f"""{views.with_views(views.MEMORY_SQL)}, w AS (SELECT *, (epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / 1e6 <= CASE memory_type WHEN 'episodic' THEN 86400 WHEN 'semantic' THEN 604800 WHEN 'artifact' THEN 259200 WHEN 'shared' THEN 172800 WHEN 'working' THEN 3600 END AS fresh,
    CASE memory_type WHEN 'semantic' THEN 'persistent' WHEN 'artifact' THEN 'versioned' WHEN 'shared' THEN 'collaborative' WHEN 'working' THEN 'ephemeral' ELSE 'adaptive' END AS retention FROM v_memory)
    SELECT memory_type, retention, count(*) AS n, count(*) FILTER (fresh) AS fresh, count(*) FILTER (NOT fresh AND retention = 'ephemeral') AS leaving FROM w GROUP BY ALL""")
def q101(spark, sf):
    """What is within its type's window, and what leaves with it."""
    kept, fresh = policies.retention(F.col("memory_type")), policies.relevant(F.col("memory_type"), F.col("created_at"), as_of())
    m = views.memory(spark, sf).select("memory_type", kept.alias("retention"), fresh.alias("f"))
    return m.groupBy("memory_type", "retention").agg(F.count(F.lit(1)).alias("n"), F.count_if("f").alias("fresh"), F.count_if(~F.col("f") & (F.col("retention") == "ephemeral")).alias("leaving"))
