"""Queries over normalised items, layers, streams of events and embedding adapters, on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import embed
from tessera.plans import views
from tessera.plans.registry import query
from tessera.session import scratch, table
from tessera.sources import json_list, normalise, readers
from tessera.streaming import cycles, expiry

Q66 = """WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(split_part(text, '####', 1), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS steps, n_chars FROM documents)
    SELECT 'gsm8k_train_' || lpad(doc_id::VARCHAR, 6, '0') AS original_id, n_chars::VARCHAR AS answer, greatest(2, least(len(steps), 9))::INT AS hop_count, len(steps)::INT AS n_steps, (1 + least(len(steps), 9))::INT AS n_paragraphs,
    md5(array_to_string(steps[1:9], '|')) AS shared_md5 FROM d"""


@query("q66_gsm8k_items", Q66)
def q66(spark, sf):
    """O-05e over all documents, read as worked answers."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("_s"), F.lit("which one?").alias("question"), F.concat(F.split_part("text", F.lit("####"), F.lit(1)), F.lit("\n#### "), F.col("n_chars").cast("string")).alias("answer"))
    i = normalise.gsm8k(d)
    return i.select("original_id", "answer", "hop_count", F.size("solution_steps").alias("n_steps"), F.size("supporting_paragraphs").alias("n_paragraphs"), F.md5(F.array_join(F.transform("task_shared_items", lambda x: x["text"]), "|")).alias("shared_md5"))


Q67 = """WITH t AS (SELECT conv_id, turn, 'p' || turn AS title, text, role = 'user' AS gold FROM conversations), g AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS hop FROM t WHERE gold)
    SELECT t.conv_id::VARCHAR AS original_id, 'para_' || lpad((row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn) - 1)::VARCHAR, 3, '0') AS paragraph_id, t.gold AS is_gold, g.hop::INT AS hop_index, md5(t.text) AS text_md5 FROM t LEFT JOIN g USING (conv_id, turn)"""


@query("q67_hotpot_items", Q67)
def q67(spark, sf):
    """O-05c over all conversations, turns as paragraphs and users' turns as facts."""
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    name = lambda x: F.concat(F.lit("p"), x["turn"].cast("string"))
    users = F.filter("ts", lambda x: x["role"] == "user")
    rows = t.select(F.col("conv_id").cast("string").alias("id"), F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit("bridge").alias("type"), F.transform("ts", name).alias("titles"), F.transform("ts", lambda x: F.array(x["text"])).alias("sentences"), F.transform(users, name).alias("fact_titles"), F.transform(users, lambda x: F.lit(0)).alias("fact_sents"))
    i = normalise.hotpot(rows)
    p = i.select("original_id", F.explode(F.concat("supporting_paragraphs", "distractor_paragraphs")).alias("p"))
    return p.select("original_id", "p.paragraph_id", "p.is_gold", "p.hop_index", F.md5("p.text").alias("text_md5"))


@query("q68_event_cycles", """SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, user_id % 4 AS scope, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY ALL""")
def q68(spark, sf):
    """The hourly window of the streaming extension, run as a batch plan."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("created_at"), (F.col("user_id") % 4).alias("scope_id"), F.lit("").alias("memory_type"), F.col("value").alias("confidence"))
    w = cycles.live(e)
    return w.select(F.unix_micros("window.start").alias("hour_us"), F.col("scope_id").alias("scope"), "n", F.round("avg_confidence", 6).alias("avg_value"))


@query("q69_pseudo_embedding")
def q69(spark, sf):
    """O-125 over all documents; tests hold a numpy twin."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    e = embed.embed(d, "text", 16)
    return e.select("doc_id", F.size("embedding").alias("dim"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("q95_json_list", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def q95(spark, sf):
    """O-01: conversations written as lists and read back in ranges of bytes."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    path = scratch(spark, "list")
    json_list.write(t, path)
    return readers.read_json(spark, path, t.schema).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("q98_ttl_stream", f"""{views.with_views(views.MEMORY_SQL)}, m AS (SELECT max(created_at) AS now FROM v_memory)
    SELECT memory_id, scope_id, epoch(created_at)::BIGINT + ttl AS expired_s FROM v_memory, m WHERE ttl IS NOT NULL AND (epoch_us(now) - epoch_us(created_at)) / 1e6 > ttl""")
def q98(spark, sf):
    """The memory table as a stream of entries: what has expired when its newest entry comes."""
    path = scratch(spark, "entries")
    m = views.memory(spark, sf).select("memory_id", "scope_id", "created_at", F.col("ttl").cast("long").alias("ttl"))
    m.write.parquet(path)
    gone = expiry.run(spark.readStream.schema(m.schema).parquet(path), delay="0 seconds")
    return gone.select("memory_id", "scope_id", F.unix_seconds("expired_at").alias("expired_s"))
