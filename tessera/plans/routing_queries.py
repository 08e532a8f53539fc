"""Queries over policies, scopes and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import policies
from tessera.operators import evaluation, routing, scopes
from tessera.plans import views
from tessera.plans.registry import query
from tessera.session import table

R = views.with_views(views.REQUESTS_SQL)
HASH_SQL = "md5(concat_ws('|', array_to_string(list_sort(visibility), ','), clearance::VARCHAR, array_to_string(list_sort(zones), ',')))"
SCOPES_SQL = "CASE WHEN main_scope IS NULL THEN [private_scope] ELSE [private_scope, main_scope] END"
PRIMARY_SQL = "coalesce(main_scope, private_scope)"
TYPES_SQL = "array_to_string(list_sort(types), ',')"


@query("q16_policy_compat_pairs", f"""{R}, c AS (SELECT ord, request_id, visibility, clearance, audit, min(ord) OVER (PARTITION BY visibility, clearance, audit, zones) AS class FROM v_requests),
    k AS (SELECT class, any_value(visibility) AS v, any_value(clearance) AS l, any_value(audit) AS u, count(*) AS n FROM c GROUP BY 1),
    j AS (SELECT a.class AS a, b.class AS b, b.n FROM k a JOIN k b ON a.l = b.l AND a.u = b.u AND list_has_any(a.v, b.v)), p AS (SELECT a, string_agg(b, ',' ORDER BY b) AS mates, sum(n)::BIGINT AS total FROM j GROUP BY 1)
    SELECT request_id, class, coalesce(mates, '') AS mates, greatest(coalesce(total, 0) - 1, 0) AS partners FROM c LEFT JOIN p ON p.a = c.class""")
def q16(spark, sf):
    """Requests by policy class, named by its first request; the classes that it agrees with, and how many other requests those hold."""
    r = views.requests(spark, sf).select("ord", "request_id", "policy").withColumn("ckey", F.md5(F.to_json("policy")))
    kinds = r.groupBy("ckey").agg(F.min("ord").alias("class"), F.count(F.lit(1)).alias("n"), F.first("policy").alias("policy")).withColumns({"c": F.col("policy.clearance"), "u": F.col("policy.audit")})
    a, b = kinds.select("class", "policy", "c", "u"), kinds.select(F.col("class").alias("mate"), F.col("policy").alias("policy2"), "c", "u", "n")
    j = a.join(b, ["c", "u"]).where(policies.compatible(F.col("policy"), F.col("policy2")))
    per = j.groupBy("class").agg(F.array_join(F.sort_array(F.collect_list("mate")).cast("array<string>"), ",").alias("mates"), F.sum("n").alias("total"))
    out = r.join(kinds.select("ckey", "class"), "ckey").join(per, "class", "left")
    return out.select("request_id", "class", F.coalesce("mates", F.lit("")).alias("mates"), F.greatest(F.coalesce("total", F.lit(0)) - 1, F.lit(0)).alias("partners"))


@query("q17_policy_merge", f"""{R}, g AS (SELECT {PRIMARY_SQL} AS scope, count(*) AS n, min(clearance) AS clearance, bool_or(audit) AS audit,
    list_reduce(list(visibility ORDER BY ord), lambda x, y: list_intersect(x, y)) AS v FROM v_requests GROUP BY 1)
    SELECT scope, n, CASE WHEN len(v) = 0 THEN 'team' ELSE array_to_string(list_sort(v), ',') END AS visibility, clearance, audit FROM g""")
def q17(spark, sf):
    r = routing.keyed(views.requests(spark, sf))
    g = r.groupBy("primary").agg(F.count(F.lit(1)).alias("n"), policies.merged(F.collect_set("policy")).alias("m"))
    return g.select(F.col("primary").alias("scope"), "n", F.array_join(F.sort_array("m.visibility"), ",").alias("visibility"), "m.clearance", "m.audit")


@query("q18_policy_hash", f"{R} SELECT request_id, {HASH_SQL} AS policy_hash FROM v_requests")
def q18(spark, sf):
    return routing.keyed(views.requests(spark, sf)).select("request_id", "policy_hash")


PAIRS_SQL = f"""{R}, s AS (SELECT *, {SCOPES_SQL} AS scopes, min(ord) OVER (PARTITION BY {SCOPES_SQL}, visibility, clearance, audit, zones) AS class FROM v_requests),
    q AS (SELECT class, count(*) AS n, any_value(scopes) AS scopes, any_value(visibility) AS visibility, any_value(clearance) AS clearance, any_value(audit) AS audit FROM s GROUP BY 1),
    p AS (SELECT a.class AS a, b.class AS b, a.n AS na, b.n AS nb, a.scopes AS sa, b.scopes AS sb, len(list_intersect(a.scopes, b.scopes)) AS i, len(list_distinct(list_concat(a.scopes, b.scopes))) AS u,
          a.clearance = b.clearance AND a.audit = b.audit AND list_has_any(a.visibility, b.visibility) AS compatible FROM q a JOIN q b ON (a.class < b.class OR a.class = b.class AND a.n > 1) AND list_has_any(a.scopes, b.scopes)),
    o AS (SELECT *, CASE WHEN i = len(sa) AND i = len(sb) THEN 'identical' WHEN i = len(sa) OR i = len(sb) THEN 'subset' ELSE 'intersecting' END AS kind FROM p),
    z AS (SELECT *, CASE kind WHEN 'identical' THEN 1.0::DOUBLE WHEN 'subset' THEN i::DOUBLE / greatest(len(sa), len(sb)) ELSE i::DOUBLE / u END AS score FROM o)"""


@query("q19_overlap_pairs", f"{PAIRS_SQL} SELECT a, b, na, nb, kind, round(score, 6) AS score, kind IN ('identical', 'subset') OR score > 0.5 AS can_share, compatible FROM z")
def q19(spark, sf):
    """Pairs of classes of requests; q74 tells who is in them."""
    return routing.pairs(views.requests(spark, sf)).select("a", "b", "na", "nb", "kind", F.round("score", 6).alias("score"), "can_share", "compatible")


@query("q74_overlap_classes", f"{PAIRS_SQL} SELECT request_id, class FROM s")
def q74(spark, sf):
    return routing.classes(views.requests(spark, sf)).select("request_id", "class")


@query("q20_overlap_components", f"""{PAIRS_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, w0 AS (SELECT x.ord AS a, y.ord AS b FROM z JOIN s x ON x.class = z.a JOIN s y ON y.class = z.b WHERE z.score >= 0.5 AND z.compatible AND x.ord <> y.ord), e AS (SELECT a, b FROM w0 UNION SELECT b, a FROM w0),
    t AS (SELECT ord AS x, ord AS y FROM v_requests UNION SELECT t.x, e.b FROM t JOIN e ON e.a = t.y),
    c AS (SELECT x AS ord, min(y) AS component FROM t GROUP BY x), k AS (SELECT c.component, {PRIMARY_SQL} AS scope, count(*) AS n, min(c.ord) AS f FROM c JOIN v_requests USING (ord) GROUP BY ALL),
    w AS (SELECT component, arg_max(scope, (n, -f)) AS scope, sum(n)::BIGINT AS size FROM k GROUP BY 1), ty AS (SELECT component, string_agg(DISTINCT t, ',' ORDER BY t) AS types FROM (SELECT c.component, unnest(types) AS t FROM c JOIN v_requests USING (ord)) GROUP BY 1),
    mg AS (SELECT component, min(clearance) AS clearance, bool_or(audit) AS audit FROM c JOIN v_requests USING (ord) GROUP BY 1)
    SELECT c.ord, c.component, w.scope, w.size, ty.types, mg.clearance, mg.audit FROM c JOIN w USING (component) JOIN ty USING (component) JOIN mg USING (component)""")
def q20(spark, sf):
    r = routing.by_overlap(views.requests(spark, sf))
    return r.select("ord", "component", "scope", "size", F.array_join("types", ",").alias("types"), "merged.clearance", "merged.audit")


ROUTED_SQL = f"""{R}, k AS (SELECT *, {PRIMARY_SQL} AS scope, {TYPES_SQL} AS tk, {HASH_SQL} AS h FROM v_requests),
    n AS (SELECT *, count(*) OVER (PARTITION BY scope, tk, h) AS n, row_number() OVER (PARTITION BY scope, tk, h ORDER BY priority DESC, ord) AS place FROM k)"""


@query("q21_route_hierarchical", f"{ROUTED_SQL} SELECT request_id, scope, n, CASE WHEN place = 1 THEN 0 ELSE n - place + 1 END::INT AS member_ord, CASE WHEN n > 1 THEN 'shared' ELSE 'independent' END AS mode FROM n")
def q21(spark, sf):
    return routing.hierarchical(views.requests(spark, sf)).select("request_id", "scope", "n", "member_ord", "mode")


@query("q22_route_scope_only", f"{R}, k AS (SELECT *, {PRIMARY_SQL} AS scope FROM v_requests) SELECT request_id, scope, (row_number() OVER (PARTITION BY scope ORDER BY priority DESC, ord) - 1)::INT AS member_ord, CASE WHEN count(*) OVER (PARTITION BY scope) > 1 THEN 'shared' ELSE 'independent' END AS mode FROM k")
def q22(spark, sf):
    return routing.scope_only(views.requests(spark, sf)).select("request_id", "scope", "member_ord", "mode")


@query("q23_bucket_stats", f"""{ROUTED_SQL}, b AS (SELECT scope, tk, h, count(*) AS size FROM n WHERE n > 1 GROUP BY ALL), t AS (SELECT count(*) AS requests, count(*) FILTER (n = 1) AS independent FROM n)
    SELECT requests, independent, count(*) AS buckets, sum(size)::BIGINT AS shared_requests, round(avg(size), 6) AS avg_size, max(size) AS max_size, min(size) AS min_size, round(sum(size)::DOUBLE / requests, 6) AS shareable_ratio FROM b, t GROUP BY requests, independent""")
def q23(spark, sf):
    return routing.stats(routing.hierarchical(views.requests(spark, sf))).withColumn("avg_size", F.round("avg_size", 6)).withColumn("shareable_ratio", F.round("shareable_ratio", 6))


SCOPE_TREE_SQL = """sc AS (SELECT 'task/' || o_custkey::VARCHAR AS parent, 'order/' || o_orderkey::VARCHAR AS scope FROM orders
    UNION ALL SELECT 'session/' || c_nationkey::VARCHAR, 'task/' || c_custkey::VARCHAR FROM customer
    UNION ALL SELECT 'workspace/' || n_regionkey::VARCHAR, 'session/' || n_nationkey::VARCHAR FROM nation)"""


def scope_tree(spark, sf):
    """scope_id, parent, type of orders, customers, nations and regions as tasks, sessions and workspaces."""
    part = lambda t, parent, key, above, below, kind: table(spark, sf, t).select(F.concat(F.lit(below), F.col(key).cast("string")).alias("scope_id"), F.concat(F.lit(above), F.col(parent).cast("string")).alias("parent"), F.lit(kind).alias("type"))
    rows = part("orders", "o_custkey", "o_orderkey", "task/", "order/", "task_shared").unionByName(part("customer", "c_nationkey", "c_custkey", "session/", "task/", "task_shared")).unionByName(part("nation", "n_regionkey", "n_nationkey", "workspace/", "session/", "session"))
    return rows.unionByName(table(spark, sf, "region").select(F.concat(F.lit("workspace/"), F.col("r_regionkey").cast("string")).alias("scope_id"), F.lit(None).cast("string").alias("parent"), F.lit("workspace").alias("type")))


@query("q24_scope_descendants", f"""WITH RECURSIVE {SCOPE_TREE_SQL}, d AS (SELECT parent AS root, scope, 1 AS depth FROM sc WHERE parent LIKE 'workspace/%' UNION ALL SELECT d.root, sc.scope, d.depth + 1 FROM d JOIN sc ON sc.parent = d.scope)
    SELECT root, depth::INT AS depth, count(*) AS scopes, min(scope) AS first FROM d GROUP BY ALL""")
def q24(spark, sf):
    """O-58: workspaces, sessions, tasks and orders as a tree of scopes; all descendants of each workspace."""
    return scopes.descendants(scope_tree(spark, sf).where("parent IS NOT NULL"), scope_tree(spark, sf).where("parent IS NOT NULL AND parent LIKE 'workspace/%'").select(F.col("parent").alias("scope_id"))).groupBy(F.col("root"), "depth").agg(F.count(F.lit(1)).alias("scopes"), F.min("scope_id").alias("first"))


@query("q42_fmr_by_clearance", f"{R}, g AS (SELECT ord // 8 AS episode, {PRIMARY_SQL} AS bucket, count(DISTINCT clearance) > 1 AS mixed FROM v_requests GROUP BY ALL) SELECT episode, bool_or(mixed) AS false_merge FROM g GROUP BY 1")
def q42(spark, sf):
    r = routing.scope_only(views.requests(spark, sf)).select(F.floor(F.col("ord") / 8).alias("episode"), "bucket", "policy.clearance")
    return evaluation.clearance_merges(r)


@query("q60_keyword_route", """SELECT conv_id, turn, CASE WHEN contains(lower(text), 'plan') OR contains(lower(text), 'constraint') THEN 'planner' WHEN contains(lower(text), 'verify') OR contains(lower(text), 'check') THEN 'verifier'
    WHEN contains(lower(text), 'critic') OR contains(lower(text), 'conflict') THEN 'critic' ELSE 'solver' END AS route FROM conversations""")
def q60(spark, sf):
    from tessera.functions.texts import route

    return table(spark, sf, "conversations").select("conv_id", "turn", route(F.col("text")).alias("route"))
