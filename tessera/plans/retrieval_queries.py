"""Queries over reranking, fallback, fusion, the retrieval variants and their evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import features
from tessera.operators import answers, bm25, evaluation, fusion, retrieval, routing, search
from tessera.plans import views
from tessera.plans.registry import SQL, query
from tessera.plans.search_queries import AS_OF_SQL, COS_SQL, as_of
from tessera.session import checkpoint, table

V = views.with_views(views.MEMORY_SQL, views.REQUESTS_SQL)
PRIMARY = "coalesce(main_scope, private_scope)"


def cos(a: str, b: str) -> str:
    return COS_SQL.replace("embedding", "\0").replace("q::", f"{a}::").replace("\0", b)


WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))"
OVERLAP = f"len(list_intersect({WORDS.format('{q}')}, {WORDS.format('{c}')}))::DOUBLE / greatest(len({WORDS.format('{q}')}), 1)"
AGE = f"(epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / 1e6"
AUTHORITY = "CASE WHEN contains(lower(source), 'verified') THEN 1.0 WHEN contains(lower(source), 'tool_output') THEN 0.9 WHEN contains(lower(source), 'agent_generated') THEN 0.7 WHEN contains(lower(source), 'user_input') THEN 0.8 WHEN contains(lower(source), 'external') THEN 0.6 ELSE 0.5 END::DOUBLE"
PROVENANCE = "least(CASE WHEN coalesce(parent_event, '') <> '' THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN coalesce(prov_agent, '') <> '' THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN prov_at IS NOT NULL THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN version > 1 THEN 0.2::DOUBLE * least(version::DOUBLE / 5, 1) ELSE 0 END, 1)"
RECENCY = f"exp(-0.1::DOUBLE * ({AGE}) / 3600)"
WEIGHTED = f"""CASE role WHEN 'planner' THEN 0.4::DOUBLE * confidence + 0.2::DOUBLE * {RECENCY} + 0.1::DOUBLE * {AUTHORITY} WHEN 'solver' THEN 0.5::DOUBLE * confidence + 0.2::DOUBLE * {AUTHORITY}
    WHEN 'verifier' THEN 0.3::DOUBLE * {RECENCY} + 0.3::DOUBLE * {AUTHORITY} + 0.4::DOUBLE * {PROVENANCE} ELSE 0.5::DOUBLE * confidence + 0.2::DOUBLE * {RECENCY} END"""


@query("q25_mean_query_search", f"""{V}, b AS (SELECT {PRIMARY} AS bucket, request_id, unnest(qvec)::DOUBLE AS x, generate_subscripts(qvec, 1) AS i FROM v_requests),
    a AS (SELECT bucket, i, sum(x) / count(*) AS x FROM b GROUP BY ALL), m AS (SELECT bucket, list(x ORDER BY i) AS q FROM a GROUP BY 1),
    s AS (SELECT bucket, memory_id, round({cos('q', 'embedding')}, 9) AS score FROM m JOIN v_memory ON scope_id = bucket),
    k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, memory_id) AS rank FROM s) SELECT bucket, memory_id, rank, round(score, 6) AS score FROM k WHERE rank <= 50""")
def q25(spark, sf):
    r = routing.keyed(views.requests(spark, sf)).select(F.col("primary").alias("bucket"), "qvec")
    m = search.mean_vectors(r)
    u = m.select(F.col("bucket").alias("unit"), "qvec", F.array("bucket").alias("scopes"), F.array().cast("array<string>").alias("types"), F.lit(None).cast("array<string>").alias("asked"))
    return search.search(u, views.memory(spark, sf), 50).select(F.col("unit").alias("bucket"), "memory_id", "rank", F.round("score", 6).alias("score"))


@query("q26_rerank_features", f"""{V} SELECT memory_id, confidence AS summary, round({OVERLAP.format(q="'the of and src1 label'", c='content')}, 6) AS keyword, round({RECENCY}, 6) AS recency, {AUTHORITY} AS authority, round({PROVENANCE}, 6) AS provenance FROM v_memory""")
def q26(spark, sf):
    m = views.memory(spark, sf).withColumn("query", F.lit("the of and src1 label"))
    return features.with_features(m, as_of()).select("memory_id", "summary", F.round("keyword", 6).alias("keyword"), F.round("recency", 6).alias("recency"), "authority", F.round("provenance", 6).alias("provenance"))


RERANKED = f"""{V}, c AS (SELECT r.request_id, r.role, m.*, round({cos('r.qvec', 'm.embedding')}, 9) AS score FROM v_requests r JOIN v_memory m ON m.scope_id = r.main_scope AND list_contains(r.types, m.memory_type) AND list_has_any(m.visibility, r.visibility)),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, memory_id) AS pool_rank FROM c) WHERE pool_rank <= 50),
    w AS (SELECT *, round({WEIGHTED}, 9) AS rerank FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rerank DESC, pool_rank) AS rr FROM w)"""


def pooled(spark, sf):
    r, m = views.requests(spark, sf), views.memory(spark, sf)
    u = search.units(routing.keyed(r).where("size(shared) + size(workspace) > 0"), F.array("primary"), F.col("policy.visibility"))
    return r, m, search.search(u, m, 50).select(F.col("unit").alias("request_id"), "memory_id", "score", F.col("rank").alias("pool_rank"))


@query("q27_rerank_role_weighted", f"{RERANKED} SELECT request_id, memory_id, rr AS rank, round(rerank, 6) AS score FROM k WHERE rr <= 20")
def q27(spark, sf):
    r, m, pool = pooled(spark, sf)
    wanted = [c for c in retrieval.PROFILE if c != "content"]
    rows = features.with_features(pool.join(m.select(*wanted), "memory_id").join(r.select("request_id", "role"), "request_id"), as_of(), None)
    rows = rows.withColumn("rerank", features.rounded(features.rerank_score(F.col("role")), 9))
    top = search.top_k(rows, ["request_id"], 20, [F.col("rerank").desc(), F.col("pool_rank")])
    return top.select("request_id", "memory_id", "rank", features.rounded(F.col("rerank"), 6).alias("score"))


@query("q28_personalise_blend", f"{RERANKED}, b AS (SELECT request_id, memory_id, rr, round(0.5 * score + 0.5 * rerank, 9) AS s FROM k WHERE rr <= 20) SELECT request_id, memory_id, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, rr) AS rank, round(s, 6) AS score FROM b")
def q28(spark, sf):
    r, m, pool = pooled(spark, sf)
    return retrieval.personalise(pool, r, m, as_of()).select("request_id", "memory_id", "rank", features.rounded(F.col("score"), 6).alias("score"))


@query("q29_fallback_triggers", f"""{RERANKED}, b AS (SELECT request_id, round(0.5 * score + 0.5 * rerank, 9) AS s, rr FROM k WHERE rr <= 20), o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, rr) AS rank FROM b),
    a AS (SELECT request_id, count(*) AS n, avg(s) FILTER (rank <= 5) AS t FROM o GROUP BY 1)
    SELECT request_id, coalesce(n, 0) AS n, coalesce(n, 0) < 15 AS by_count, coalesce(n, 0) = 0 OR t < 0.4 AS by_score, coalesce(n, 0) < 15 OR coalesce(n, 0) = 0 OR t < 0.4 AS either FROM v_requests LEFT JOIN a USING (request_id)""")
def q29(spark, sf):
    r, m, pool = pooled(spark, sf)
    return retrieval.triggers(r, retrieval.personalise(pool, r, m, as_of()), 15, 0.4)


PRIVATE = f"""pc AS (SELECT r.request_id, m.memory_id, list_position(r.types, m.memory_type) AS tp, round({cos('r.qvec', 'm.embedding')}, 9) AS score FROM v_requests r JOIN v_memory m ON m.scope_id = r.private_scope AND list_contains(r.types, m.memory_type) AND list_has_any(m.visibility, r.visibility)),
    pr AS (SELECT *, row_number() OVER (PARTITION BY request_id, tp ORDER BY score DESC, memory_id) AS rk FROM pc), po AS (SELECT request_id, memory_id, score, row_number() OVER (PARTITION BY request_id ORDER BY tp, rk) AS rank FROM pr WHERE rk <= 20), pv AS (SELECT * FROM po WHERE rank <= 20)"""


@query("q30_private_fallback", f"{V}, {PRIVATE} SELECT request_id, memory_id, rank, round(score, 6) AS score FROM pv")
def q30(spark, sf):
    return retrieval.private_search(views.requests(spark, sf), views.memory(spark, sf)).select("request_id", "memory_id", "rank", F.round("score", 6).alias("score"))


TWO_SQL = f"""{RERANKED}, sh AS (SELECT request_id, memory_id, score, pool_rank AS rank FROM p WHERE pool_rank <= 20), pc AS (SELECT request_id, memory_id, confidence AS score, row_number() OVER (PARTITION BY request_id ORDER BY confidence DESC, memory_id) AS rank FROM p),
    pv AS (SELECT * FROM pc WHERE rank <= 20), j AS (SELECT request_id, memory_id, s.rank AS sr, v.rank AS vr, s.score AS ss, v.score AS vs, CASE WHEN s.memory_id IS NULL THEN 'private' WHEN v.memory_id IS NULL THEN 'shared' ELSE 'both' END AS origin FROM sh s FULL JOIN pv v USING (request_id, memory_id))"""


def two(spark, sf):
    """The pool by similarity and by confidence."""
    _, m, pool = pooled(spark, sf)
    sure = pool.join(m.select("memory_id", "confidence"), "memory_id").select("request_id", "memory_id", F.col("confidence").alias("score"))
    return pool.where("pool_rank <= 20").withColumnRenamed("pool_rank", "rank"), search.ranked(sure, ["request_id"], 20)


@query("q31_rrf_fuse", f"{TWO_SQL}, f AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + sr), 0) + coalesce(1.0::DOUBLE / (60 + vr), 0), 12) AS s FROM j) SELECT request_id, memory_id, origin, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, sr NULLS LAST, vr NULLS LAST, memory_id) AS rank, round(s, 6) AS score FROM f")
def q31(spark, sf):
    return fusion.reciprocal_rank(*two(spark, sf)).select("request_id", "memory_id", "origin", "rank", F.round("score", 6).alias("score"))


@query("q32_weighted_fuse", f"{TWO_SQL}, f AS (SELECT *, coalesce(ss, vs * 0.7::DOUBLE) AS s FROM j) SELECT request_id, memory_id, origin, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, sr NULLS LAST, vr NULLS LAST, memory_id) AS rank, round(s, 6) AS score FROM f")
def q32(spark, sf):
    return fusion.score_weighted(*two(spark, sf)).select("request_id", "memory_id", "origin", "rank", F.round("score", 6).alias("score"))


@query("q33_rrf_at_scale", """WITH t AS (SELECT l_partkey AS part, l_suppkey AS supp, sum(l_quantity) AS q, sum(round(l_extendedprice, 2)) AS e FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY q DESC, supp) AS qr, row_number() OVER (PARTITION BY part ORDER BY round(e, 2) DESC, supp) AS er FROM t),
    f AS (SELECT part, supp, CASE WHEN qr <= 10 THEN qr END AS qr, CASE WHEN er <= 10 THEN er END AS er FROM r WHERE qr <= 10 OR er <= 10),
    s AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + qr), 0) + coalesce(1.0::DOUBLE / (60 + er), 0), 12) AS s FROM f),
    k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY s DESC, qr NULLS LAST, er NULLS LAST, lpad(supp::VARCHAR, 8, '0')) AS rank FROM s) SELECT part, supp, rank, round(s, 6) AS score FROM k WHERE rank <= 5""")
def q33(spark, sf):
    """Two ranked lists for each part, its suppliers by quantity and by price, fused for all parts at once."""
    t = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).agg(F.sum("l_quantity").alias("q"), F.sum(F.round("l_extendedprice", 2)).alias("e"))
    t = t.withColumn("memory_id", F.lpad(F.col("supp").cast("string"), 8, "0"))
    lists = [search.top_k(t, ["part"], 10, [c, F.col("supp")]).select("part", "memory_id", "rank", F.lit(0.0).alias("score")) for c in (F.col("q").desc(), F.round("e", 2).desc())]
    return fusion.reciprocal_rank(*lists, by="part", k=5).select("part", F.col("memory_id").cast("long").alias("supp"), "rank", F.round("score", 6).alias("score"))


def run(spark, sf, variant):
    return retrieval.retrieve(views.requests(spark, sf), views.memory(spark, sf), as_of(), variant)


def shown(results):
    return results.select("request_id", "mode", "memory_id", "rank", "origin", F.round("score", 6).alias("score"), "fallback")


def variant_sql(variant: str) -> str:
    """Up to the CTE res(request_id, mode, bucket, memory_id, rank, origin, s, fallback)."""
    shared = variant != "a1"
    rerank_shared = variant == "a4"
    fallback = variant == "a4"
    size = "count(*) OVER (PARTITION BY scope)" if shared else "1"
    return f"""{V}, rq AS (SELECT *, {PRIMARY} AS scope FROM v_requests), ro AS (SELECT *, {size} AS n, row_number() OVER (PARTITION BY scope ORDER BY priority DESC, ord) AS place FROM rq),
    bx AS (SELECT scope, unnest(qvec)::DOUBLE AS x, generate_subscripts(qvec, 1) AS i FROM ro WHERE n > 1), ba AS (SELECT scope, i, sum(x) / count(*) AS x FROM bx GROUP BY ALL), bm AS (SELECT scope, list(x ORDER BY i) AS q FROM ba GROUP BY 1),
    bt AS (SELECT DISTINCT scope, unnest(types) AS ty FROM ro WHERE n > 1),
    bs AS (SELECT b.scope, m.memory_id, round({cos('b.q', 'm.embedding')}, 9) AS score FROM bm b JOIN v_memory m ON m.scope_id = b.scope WHERE EXISTS (SELECT 1 FROM bt WHERE bt.scope = b.scope AND bt.ty = m.memory_type)),
    bk AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, memory_id) AS pool_rank FROM bs),
    sx AS (SELECT r.request_id, m.memory_id, round({cos('r.qvec', 'm.embedding')}, 9) AS score FROM ro r JOIN v_memory m ON (m.scope_id = r.main_scope OR m.scope_id = r.private_scope) AND list_contains(r.types, m.memory_type) AND list_has_any(m.visibility, r.visibility) WHERE r.n = 1),
    sk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, memory_id) AS pool_rank FROM sx),
    po1 AS (SELECT r.request_id, b.memory_id, b.score, b.pool_rank, {str(rerank_shared).lower()} AS rer FROM ro r JOIN bk b ON r.scope = b.scope WHERE r.n > 1 AND b.pool_rank <= 50 UNION ALL SELECT request_id, memory_id, score, pool_rank, true FROM sk WHERE pool_rank <= 50),
    w AS (SELECT po1.*, CASE WHEN rer THEN round({WEIGHTED}, 9) END AS rerank FROM po1 JOIN v_memory USING (memory_id) JOIN (SELECT request_id, role FROM rq) USING (request_id)),
    k AS (SELECT *, CASE WHEN rer THEN row_number() OVER (PARTITION BY request_id ORDER BY rerank DESC, pool_rank) ELSE pool_rank END AS rr FROM w),
    b AS (SELECT request_id, memory_id, rr, CASE WHEN rer THEN round(0.5 * score + 0.5 * rerank, 9) ELSE score END AS s FROM k WHERE rr <= 20),
    sh AS (SELECT request_id, memory_id, s AS score, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, rr) AS rank FROM b),
    ct AS (SELECT request_id, coalesce(c, 0) < 5 AND {str(fallback).lower()} AS fired FROM rq LEFT JOIN (SELECT request_id, count(*) AS c FROM sh GROUP BY 1) USING (request_id)),
    {PRIVATE}, pf AS (SELECT pv.* FROM pv JOIN ct USING (request_id) WHERE fired),
    j AS (SELECT request_id, memory_id, x.rank AS sr, v.rank AS vr, CASE WHEN x.memory_id IS NULL THEN 'private' WHEN v.memory_id IS NULL THEN 'shared' ELSE 'both' END AS origin FROM sh x FULL JOIN pf v USING (request_id, memory_id)),
    f AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + sr), 0) + coalesce(1.0::DOUBLE / (60 + vr), 0), 12) AS s FROM j),
    fr AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, sr NULLS LAST, vr NULLS LAST, memory_id) AS rank FROM f),
    res AS (SELECT r.request_id, '{variant}_' || CASE WHEN r.n > 1 THEN 'shared' ELSE 'independent' END AS mode, CASE WHEN r.n > 1 THEN r.scope END AS bucket, x.memory_id, x.rank, x.origin, x.s, ct.fired AS fallback
            FROM ro r JOIN ct USING (request_id) LEFT JOIN (SELECT * FROM fr WHERE rank <= 20) x ON x.request_id = r.request_id)"""


RES = " SELECT request_id, mode, memory_id, rank, origin, round(s, 6) AS score, fallback FROM res"


@query("q34_pipeline_a1", variant_sql("a1") + RES)
def q34(spark, sf):
    return shown(run(spark, sf, "a1"))


@query("q35_pipeline_a3", variant_sql("a3") + RES)
def q35(spark, sf):
    return shown(run(spark, sf, "a3"))


@query("q36_pipeline_a4", variant_sql("a4") + RES)
def q36(spark, sf):
    return shown(run(spark, sf, "a4"))


@query("q37_pipeline_a5")
def q37(spark, sf):
    """The pool needs an eigendecomposition for each bucket; tests hold a numpy twin."""
    return shown(run(spark, sf, "a5"))


GOLD_SQL = "gold AS (SELECT request_id, memory_id FROM (SELECT r.request_id, m.memory_id, row_number() OVER (PARTITION BY r.request_id ORDER BY m.memory_id) AS g FROM v_requests r JOIN v_memory m ON m.label = r.label AND (m.scope_id = r.main_scope OR m.scope_id = r.private_scope)) WHERE g <= 5)"
PER_CTES = f"""{GOLD_SQL}, tp AS (SELECT request_id, memory_id, min(rank) AS rank FROM res WHERE rank <= 10 GROUP BY ALL),
    pe AS (SELECT request_id, count(*) AS n_gold, count(rank) AS hits, count(rank)::DOUBLE / count(*) AS recall, coalesce(1.0::DOUBLE / min(rank), 0) AS rr FROM gold LEFT JOIN tp USING (request_id, memory_id) GROUP BY 1)"""
PER_SQL = f"{variant_sql('a4')}, {PER_CTES}"


def gold(spark, sf):
    r, m = routing.keyed(views.requests(spark, sf)), views.memory(spark, sf)
    # the first five of a scope and label are enough for each request
    m = search.top_k(m.select("memory_id", "label", "scope_id"), ["label", "scope_id"], 5, [F.col("memory_id")], "g").drop("g")
    j = r.select("request_id", "label", F.explode("all_scopes").alias("scope_id")).join(m, ["label", "scope_id"])
    return search.top_k(j, ["request_id"], 5, [F.col("memory_id")], "g").select("request_id", "memory_id")


def conflicts(spark, sf):
    return views.requests(spark, sf).where("policy.audit").select("request_id")


@query("q38_recall_at_k", f"{PER_SQL} SELECT round(avg(recall), 6) AS recall, count(*) AS evaluated FROM pe")
def q38(spark, sf):
    return evaluation.means(evaluation.per_request(run(spark, sf, "a4"), gold(spark, sf))).select(F.round("recall", 6).alias("recall"), "evaluated")


@query("q39_mrr_at_k", f"{PER_SQL} SELECT round(avg(rr), 6) AS mrr, count(*) AS evaluated FROM pe")
def q39(spark, sf):
    return evaluation.means(evaluation.per_request(run(spark, sf, "a4"), gold(spark, sf))).select(F.round("mrr", 6).alias("mrr"), "evaluated")


@query("q40_savings_fmr", f"""{variant_sql('a4')}, p AS (SELECT request_id, first(bucket) AS bucket FROM res GROUP BY 1), c AS (SELECT count(*) AS requests, count(DISTINCT bucket) + count(*) FILTER (bucket IS NULL) AS first_stage FROM p),
    x AS (SELECT count(*) AS conflicts, count(*) FILTER (bucket IS NOT NULL) AS merged FROM p WHERE request_id IN (SELECT request_id FROM v_requests WHERE audit))
    SELECT requests, first_stage, round((requests - first_stage)::DOUBLE / requests, 6) AS savings, conflicts, merged, round(merged::DOUBLE / conflicts, 6) AS rate FROM c, x""")
def q40(spark, sf):
    r = evaluation.report(checkpoint(run(spark, sf, "a4")), gold(spark, sf), conflicts(spark, sf))
    return r.select("requests", "first_stage", F.round("savings", 6).alias("savings"), "conflicts", "merged", F.round("rate", 6).alias("rate"))


@query("q41_eval_per_request", f"{PER_SQL} SELECT request_id, n_gold, hits, round(recall, 6) AS recall, round(rr, 6) AS rr FROM pe")
def q41(spark, sf):
    return evaluation.per_request(run(spark, sf, "a4"), gold(spark, sf)).select("request_id", "n_gold", "hits", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"))


@query("q62_variant_comparison")
def q62(spark, sf):
    """O-81: one row a variant."""
    g, c = gold(spark, sf), conflicts(spark, sf)
    return evaluation.compare({v: checkpoint(run(spark, sf, v)) for v in ("a1", "a3", "a4", "a5")}, g, c)


def report_sql(variant: str) -> str:
    return f"""SELECT * FROM ({variant_sql(variant)}, {PER_CTES}, p AS (SELECT request_id, first(bucket) AS bucket FROM res GROUP BY 1), cn AS (SELECT count(*) AS requests, count(DISTINCT bucket) + count(*) FILTER (bucket IS NULL) AS first_stage FROM p),
    xc AS (SELECT count(*) AS conflicts, count(*) FILTER (bucket IS NOT NULL) AS merged FROM p WHERE request_id IN (SELECT request_id FROM v_requests WHERE audit)), mn AS (SELECT round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, count(*) AS evaluated FROM pe)
    SELECT '{variant}' AS variant, recall, mrr, evaluated, requests, first_stage, round(greatest((requests - first_stage)::DOUBLE / requests, 0), 6) AS savings, conflicts, merged, round(merged::DOUBLE / conflicts, 6) AS rate FROM mn, cn, xc)"""


@query("q91_variant_report", " UNION ALL ".join(report_sql(v) for v in ("a1", "a3", "a4")))
def q91(spark, sf):
    """O-80, O-81: the variants that SQL can express."""
    g, c = gold(spark, sf), conflicts(spark, sf)
    r = evaluation.compare({v: checkpoint(run(spark, sf, v)) for v in ("a1", "a3", "a4")}, g, c)
    return r.select("variant", *(F.round(x, 6).alias(x) for x in ("recall", "mrr", "savings", "rate")), "evaluated", "requests", "first_stage", "conflicts", "merged")


@query("q63_softmax_scores", """WITH s AS (SELECT part, q, row_number() OVER (PARTITION BY part ORDER BY q DESC, supp) AS r FROM (SELECT l_partkey AS part, l_suppkey AS supp, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)), t AS (SELECT * FROM s WHERE r <= 10)
    SELECT part, r AS rank, round(exp((q - max(q) OVER (PARTITION BY part)) / 10) / sum(exp((q - m) / 10)) OVER (PARTITION BY part), 6) AS p FROM (SELECT *, max(q) OVER (PARTITION BY part) AS m FROM t)""")
def q63(spark, sf):
    """Row softmax of scores, named by the design text only."""
    t = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).agg(F.sum("l_quantity").alias("q"))
    t = search.top_k(t, ["part"], 10, [F.col("q").desc(), F.col("supp")])
    w = Window.partitionBy("part")
    e = F.exp((F.col("q") - F.max("q").over(w)) / 10)
    return t.withColumn("e", e).select("part", "rank", F.round(F.col("e") / F.sum("e").over(w), 6).alias("p"))


TOKENS_SQL = "list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


@query("q96_bm25", f"""WITH d AS (SELECT doc_id, {TOKENS_SQL} AS ws FROM documents), s AS (SELECT count(*) FILTER (len(ws) > 0) AS n, sum(len(ws))::DOUBLE / count(*) FILTER (len(ws) > 0) AS mean FROM d),
    q AS (SELECT DISTINCT item_id, unnest({TOKENS_SQL}) AS w FROM benchmark), t AS (SELECT doc_id, len, w, count(*) AS tf FROM (SELECT doc_id, len(ws) AS len, unnest(ws) AS w FROM d) GROUP BY ALL), f AS (SELECT w, count(*) AS df FROM t GROUP BY 1),
    j AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score FROM q JOIN f USING (w) JOIN t USING (w), s GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM j) SELECT item_id, doc_id, rank, round(score, 5) AS score FROM r WHERE rank <= 10""")
def q96(spark, sf):
    """The sparse baseline: benchmark items over all documents, the best ten."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), bm25.tokens(F.col("text")).alias("ws"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), bm25.tokens(F.col("text")).alias("ws"))
    top, _ = bm25.search(bm25.index(d, q.select(F.explode("ws").alias("word"))), q, 10)
    return top.select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "rank", F.round("score", 5).alias("score"))


BAG_SQL = "list_filter(string_split_regex(regexp_replace(lower(coalesce({0}, '')), '[!-/:-@\\[-`{{-~]', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


@query("q100_answer_quality", f"""WITH top AS ({SQL["q96_bm25"]}), i AS (SELECT item_id, text AS gold, array_to_string(string_split(text, ' ')[1:4], ' ') AS short FROM benchmark),
    a AS (SELECT i.item_id, {BAG_SQL.format("d.text")} AS p, {BAG_SQL.format("gold")} AS g, short FROM i LEFT JOIN top ON top.item_id = i.item_id AND rank = 1 LEFT JOIN documents d USING (doc_id)),
    w AS (SELECT item_id, unnest(p) AS w, 1 AS p, 0 AS g FROM a UNION ALL SELECT item_id, unnest(g), 0, 1 FROM a), o AS (SELECT item_id, sum(least(p, g)) AS n FROM (SELECT item_id, w, sum(p) AS p, sum(g) AS g FROM w GROUP BY ALL) GROUP BY 1),
    h AS (SELECT item_id, bool_or(doc_id % 5 = item_id % 5) AS hit, bool_or(contains(' ' || array_to_string({BAG_SQL.format("d.text")}, ' ') || ' ', ' ' || array_to_string({BAG_SQL.format("short")}, ' ') || ' ')) AS told FROM top JOIN documents d USING (doc_id) JOIN i USING (item_id) GROUP BY 1)
    SELECT item_id, p = g AS em, round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN (p = g)::INT ELSE 2.0 * coalesce(n, 0) / (len(p) + len(g)) END, 6)::DOUBLE AS f1, coalesce(hit, false) AS hit, coalesce(told, false) AND len({BAG_SQL.format("short")}) > 0 AS supported
    FROM a LEFT JOIN o USING (item_id) LEFT JOIN h USING (item_id)""")
def q100(spark, sf):
    """EM, F1, evidence hit and answer support: items answered by the best document, their first words looked for in the first ten."""
    top = checkpoint(q96(spark, sf).select(F.col("item_id").alias("id"), F.col("doc_id").alias("doc"), "rank"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("gold"))
    docs = answers.retrieved(top, table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"))
    best = items.join(top.where("rank = 1").join(docs, "doc").select("id", F.col("text").alias("predicted")), "id", "left")
    gold = top.where(F.col("doc") % 5 == F.col("id") % 5).select("id", "doc").unionByName(items.select("id", F.lit(-1).cast("long").alias("doc")))
    short = items.select("id", F.array_join(F.slice(F.split("gold", " "), 1, 4), " ").alias("gold"))
    out = answers.matches(best).join(answers.evidence_hits(items, top, gold), "id").join(answers.supported(short, top, docs), "id")
    return out.withColumnRenamed("id", "item_id")
