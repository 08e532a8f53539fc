"""Domain views over the given tables, as DataFrames and as SQL for the oracle. All are deterministic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

AS_OF, AS_OF_SECONDS = "2024-01-15 00:00:00", 1705276800
SOURCES = ("verified tool_output", "tool_output", "agent_generated", "user_input", "external feed", "manual")
TYPES = ("semantic", "episodic", "artifact", "shared", "working")
ROLES = ("planner", "solver", "verifier", "critic", "custom")
#: Every vector whose id this divides is a request; every request of this turn has private scopes only.
EVERY, SOLO = 50, 9


def _list(xs: tuple[str, ...]) -> str:
    return ", ".join(f"'{x}'" for x in xs)


MEMORY_SQL = f"""
v_memory AS (
  SELECT lpad(e.vec_id::VARCHAR, 8, '0') AS memory_id, e.vec_id, e.label, e.embedding,
    CASE e.label % 5 WHEN 0 THEN 'task/alpha/shared' WHEN 1 THEN 'task/alpha/shared' WHEN 2 THEN 'session/current' WHEN 3 THEN 'workspace/default'
         ELSE 'agent/a' || (e.vec_id % 4)::VARCHAR || '/private' END AS scope_id,
    ([{_list(TYPES)}])[e.vec_id % 5 + 1] AS memory_type, coalesce(d.text, '') AS content,
    CASE WHEN e.vec_id % 7 = 0 THEN ['restricted'] WHEN e.vec_id % 11 = 0 THEN ['public', 'team'] ELSE ['team'] END AS visibility,
    (e.vec_id % 100)::DOUBLE / 100 AS confidence, CASE WHEN e.vec_id % 10 = 0 THEN 86400 END AS ttl,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(e.vec_id::INT) AS created_at, ([{_list(SOURCES)}])[e.vec_id % 6 + 1] AS source,
    CASE WHEN e.vec_id % 3 = 0 THEN 'ev_' || e.vec_id::VARCHAR END AS parent_event, CASE WHEN e.vec_id % 4 <> 3 THEN 'a' || (e.vec_id % 4)::VARCHAR ELSE '' END AS prov_agent,
    CASE WHEN e.vec_id % 5 <> 4 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(e.vec_id::INT) END AS prov_at, (e.vec_id % 9 + 1)::INT AS version,
    ['t' || (e.vec_id % 3)::VARCHAR, CASE WHEN e.vec_id % 13 = 0 THEN 'quarantine' ELSE 'z' || (e.vec_id % 5)::VARCHAR END] AS tags
  FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id)"""

REQUESTS_SQL = f"""
v_requests AS (
  SELECT o AS ord, 'r' || lpad(o::VARCHAR, 8, '0') AS request_id, label, embedding AS qvec,
    ([{_list(ROLES)}])[o % 5 + 1] AS role, (o % 3)::INT AS priority, 'src' || (o % 20)::VARCHAR || ' the of and label' AS query,
    CASE WHEN o % {SOLO} = {SOLO - 1} THEN 'agent/a0/private' ELSE 'agent/a' || (o % 4)::VARCHAR || '/private' END AS private_scope,
    CASE WHEN o % {SOLO} = {SOLO - 1} THEN NULL ELSE (['task/alpha/shared', 'session/current', 'workspace/default'])[o % 3 + 1] END AS main_scope,
    CASE WHEN o % {SOLO} <> {SOLO - 1} AND o % 8 = 7 THEN ['shared', 'working'] ELSE ['semantic', 'episodic', 'artifact'] END AS types,
    CASE WHEN o % 6 = 5 THEN ['restricted', 'team'] ELSE ['team'] END AS visibility, CASE WHEN o % 6 = 5 THEN 5 ELSE 3 END AS clearance,
    ['quarantine', 'audit_hold'] AS zones, o % 6 = 5 AS audit
  FROM (SELECT *, (vec_id // {EVERY})::INT AS o FROM embeddings WHERE vec_id % {EVERY} = 0))"""
EVENT_SQL = """
v_event AS (
  SELECT lpad(event_id::VARCHAR, 10, '0') AS memory_id, event_id, 'user/' || user_id::VARCHAR AS scope_id,
    CASE event_type WHEN 'view' THEN 'episodic' WHEN 'click' THEN 'working' WHEN 'purchase' THEN 'artifact' WHEN 'signup' THEN 'shared' ELSE 'semantic' END AS memory_type,
    value AS confidence, ts AS created_at, event_type AS source, 'a' || (user_id % 4)::VARCHAR AS agent_id, props AS metadata,
    [event_type, 'u' || (user_id % 3)::VARCHAR] AS tags, CASE WHEN event_id % 7 = 0 THEN ['restricted'] ELSE ['team', 'public'] END AS visibility
  FROM events)"""
CHAIN_SQL = """
v_chain AS (SELECT conv_id AS episode, turn AS node, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent,
    CASE role WHEN 'user' THEN 'solver' WHEN 'assistant' THEN 'verifier' ELSE 'planner' END AS role, text FROM conversations)"""


def memory(spark: SparkSession, sf: str) -> DataFrame:
    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents").select("doc_id", "text")
    i = F.col("vec_id")
    created = F.timestamp_seconds(F.lit(1704067200) + i * 3600)
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k + 1).cast("int"))
    private = F.concat(F.lit("agent/a"), (i % 4).cast("string"), F.lit("/private"))
    rows = e.join(d, e["vec_id"] == d["doc_id"], "left")
    return rows.select(
        F.lpad(i.cast("string"), 8, "0").alias("memory_id"), i.alias("vec_id"), "label", "embedding",
        F.when(F.col("label") % 5 <= 1, "task/alpha/shared").when(F.col("label") % 5 == 2, "session/current").when(F.col("label") % 5 == 3, "workspace/default").otherwise(private).alias("scope_id"),
        pick(TYPES, i % 5).alias("memory_type"), F.coalesce("text", F.lit("")).alias("content"),
        F.when(i % 7 == 0, F.array(F.lit("restricted"))).when(i % 11 == 0, F.array(F.lit("public"), F.lit("team"))).otherwise(F.array(F.lit("team"))).alias("visibility"),
        ((i % 100).cast("double") / 100).alias("confidence"), F.when(i % 10 == 0, 86400).alias("ttl"), created.alias("created_at"), pick(SOURCES, i % 6).alias("source"),
        F.when(i % 3 == 0, F.concat(F.lit("ev_"), i.cast("string"))).alias("parent_event"), F.when(i % 4 != 3, F.concat(F.lit("a"), (i % 4).cast("string"))).otherwise("").alias("prov_agent"),
        F.when(i % 5 != 4, created).alias("prov_at"), (i % 9 + 1).cast("int").alias("version"),
        F.array(F.concat(F.lit("t"), (i % 3).cast("string")), F.when(i % 13 == 0, "quarantine").otherwise(F.concat(F.lit("z"), (i % 5).cast("string")))).alias("tags"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of requests, one for each vector whose id is divisible by EVERY; scopes as arrays, policy as a struct."""
    i = F.col("o")
    strings = lambda *xs: F.array(*map(F.lit, xs))
    none = F.array().cast("array<string>")
    solo = i % SOLO == SOLO - 1
    main = F.element_at(strings("task/alpha/shared", "session/current", "workspace/default"), (i % 3 + 1).cast("int"))
    private = F.when(solo, "agent/a0/private").otherwise(F.concat(F.lit("agent/a"), (i % 4).cast("string"), F.lit("/private")))
    strict = i % 6 == 5
    rows = table(spark, sf, "embeddings").where(F.col("vec_id") % EVERY == 0).withColumn("o", (F.col("vec_id") / EVERY).cast("int"))
    return rows.select(
        i.alias("ord"), F.concat(F.lit("r"), F.lpad(i.cast("string"), 8, "0")).alias("request_id"), "label", F.col("embedding").alias("qvec"),
        F.element_at(strings(*ROLES), (i % 5 + 1).cast("int")).alias("role"), (i % 3).cast("int").alias("priority"),
        F.concat(F.lit("src"), (i % 20).cast("string"), F.lit(" the of and label")).alias("query"), F.array(private).alias("private"),
        F.when(solo | (i % 3 == 2), none).otherwise(F.array(main)).alias("shared"), F.when(~solo & (i % 3 == 2), F.array(main)).otherwise(none).alias("workspace"), none.alias("governed"),
        F.when(~solo & (i % 8 == 7), strings("shared", "working")).otherwise(strings("semantic", "episodic", "artifact")).alias("types"),
        F.struct(F.when(strict, strings("restricted", "team")).otherwise(strings("team")).alias("visibility"), F.when(strict, 5).otherwise(3).alias("clearance"), strings("quarantine", "audit_hold").alias("zones"), strict.alias("audit")).alias("policy"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    return table(spark, sf, "events").select(
        F.lpad(F.col("event_id").cast("string"), 10, "0").alias("memory_id"), "event_id", F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("scope_id"),
        F.when(t == "view", "episodic").when(t == "click", "working").when(t == "purchase", "artifact").when(t == "signup", "shared").otherwise("semantic").alias("memory_type"),
        F.col("value").alias("confidence"), F.col("ts").cast("timestamp").alias("created_at"), t.alias("source"), F.concat(F.lit("a"), (F.col("user_id") % 4).cast("string")).alias("agent_id"), F.col("props").alias("metadata"),
        F.array(t, F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string"))).alias("tags"), F.when(F.col("event_id") % 7 == 0, F.array(F.lit("restricted"))).otherwise(F.array(F.lit("team"), F.lit("public"))).alias("visibility"),
    )


def chain(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as linear episodes: a turn depends on the turn before."""
    from pyspark.sql import Window

    role = F.when(F.col("role") == "user", "solver").when(F.col("role") == "assistant", "verifier").otherwise("planner")
    prior = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("episode"), F.col("turn").alias("node"), prior.alias("parent"), role.alias("role"), "text")


def with_views(*views: str) -> str:
    return "WITH " + ",".join(views)
