"""Mixing sources to target weights by weighted fair queueing.

Each source gets a target: the budget is shared by weight, no source above `passes` times its size, the excess reshared
by weight. A source's documents stand in a shuffled order that depends on seed, id and text alone and is repeated for up to
`passes` rounds. A copy's virtual finish time is the source's cumulative size up to its end, divided by the source's
target. Copies are sorted by finish time over all sources, by ranges, and taken until the budget is spent.

No source is ever in one task: cumulative sizes come from totals of (source, hash bucket), whose number follows the rows,
and a window within each bucket; the range in which the budget ends is found by the ranges' totals, and only that one is
added up row by row. Documents of size 0 are never taken and null sources are a source of their own, last in order. Null ids
count as an empty one; rows that share an id are told apart by their texts, and rows that share both are copies of their own,
whose order among each other doesn't matter, as they are alike. Only id, text and source are read; other columns
are carried by `carry`, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpoint, free_names

WEIGHTS = (1, 2, 3)
PASSES = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a hash bucket, on average.
BUCKET_ROWS = 2000


def order_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    none = F.lit("")
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), none), F.coalesce(text, none)))


def targets(sizes: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> DataFrame:
    """sizes: source, source_size. Adds weight and target. With r = passes * size / weight, the sources of smallest r are
    capped; the level that shares the rest by weight is the first, in that order, that the next r reaches."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    t = t.withColumn("cap", (F.col("source_size") * passes).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    t = t.withColumn("nth", F.row_number().over(by_ratio)).withColumn("at", F.min_by("level", F.when(F.col("ratio") >= F.col("level"), F.col("nth"))).over(every))
    return t.withColumn("target", F.when(F.col("ratio") < F.col("at"), F.col("cap")).otherwise(F.least(F.col("at") * F.col("weight"), F.col("cap")))).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, passes: int = PASSES, seed: str = SEED, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row; carry gives the rows
    of docs instead, each as often as it is taken."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = checkpoint(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), order_key(F.col(doc_id), F.col(text), seed).alias("h")))
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = targets(per.select("source", "source_size"), weights, passes)
    n_rows, budget = per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    digits = 1
    while 16**digits * BUCKET_ROWS < n_rows:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("h", 1, digits))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0)).alias("offset"))
    totals = totals.join(goal, totals["source"].eqNullSafe(goal["source"])).select(totals["source"].alias("s"), F.col("bucket").alias("b"), "offset", "source_size", "target")
    # what is equal in source, hash and size has the same place whichever comes first
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(inside))
    rows = rows.join(totals, rows["source"].eqNullSafe(F.col("s")) & (rows["bucket"] == F.col("b"))).withColumn("place", F.col("offset") + F.col("upto"))
    rows = checkpoint(rows.select("doc_id", "source", "size", "h", "source_size", "target", "place"))

    def finish(k) -> Column:
        return F.when(F.col("target") > 0, (F.lit(k) * F.col("source_size") + F.col("place")) / F.col("target"))

    copies = rows.where("size > 0 AND target > 0").select("source", "h", "doc_id", "place", "size", F.posexplode(F.array(*[finish(k) for k in range(passes)])).alias("k", "finish"))
    line = ["finish", F.col("source").asc_nulls_last(), "h", "doc_id", "place"]
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    queue = checkpoint(copies.repartitionByRange(ranges, *line).sortWithinPartitions(*line).withColumn("part", F.spark_partition_id()))
    spent = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))  # a row a range
    parts = queue.groupBy("part").agg(F.sum("size").alias("total")).withColumn("spent", spent)
    over = parts.where(F.col("spent") > budget).orderBy("part").first()
    cut = None
    if over is not None:  # the first copy that doesn't fit
        upto = F.sum("size").over(Window.partitionBy("part").orderBy(*line).rowsBetween(Window.unboundedPreceding, 0))
        last = queue.where(F.col("part") == over["part"]).withColumn("spent", upto + (over["spent"] - over["total"]))
        cut = last.where(F.col("spent") > budget).orderBy(*line).first()
    if cut is None:
        wanted = [F.lit(True)] * passes
    else:
        c_source, missing = F.lit(cut["source"]).cast("string"), F.lit(cut["source"] is None)
        key = F.struct("h", F.coalesce("doc_id", F.lit(-(2**63))), "place") < F.struct(F.lit(cut["h"]), F.lit(-(2**63) if cut["doc_id"] is None else cut["doc_id"]).cast("long"), F.lit(cut["place"]).cast("long"))
        before = F.when(F.col("source").eqNullSafe(c_source), key).when(F.col("source").isNull(), F.lit(False)).otherwise(missing | (F.col("source") < c_source))
        wanted = [(finish(k) < cut["finish"]) | ((finish(k) == cut["finish"]) & before) for k in range(passes)]
    took = sum((F.when(w, F.col("size")).otherwise(0) for w in wanted), F.lit(0))
    out = rows.select("doc_id", "source", "size", "source_size", "target", "h", F.coalesce(F.when((F.col("size") > 0) & (F.col("target") > 0), took), F.lit(0)).cast("long").alias("taken"))
    return out.drop("h") if not carry else _carry(docs, out, doc_id, text, source, seed)


def _carry(docs: DataFrame, out: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    """docs, each row as often as it is taken. Rows that repeat id, source and text share what was taken of them."""
    n = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    h, copies, rows, src, key, nth, k = free_names(docs, "h", "copies", "rows", "src", "key", "nth", "k")
    per = out.groupBy("source", "h").agg(F.sum(n).alias(copies), F.count(F.lit(1)).alias(rows)).where(F.col(copies) > 0).select(F.col("source").alias(src), F.col("h").alias(h), copies, rows)
    d = docs.withColumn(key, order_key(F.col(doc_id), F.col(text), seed))
    d = d.join(per, (F.col(key) == F.col(h)) & d[source].eqNullSafe(F.col(src)))
    many = d.where(F.col(rows) > 1).withColumn(nth, F.row_number().over(Window.partitionBy(src, h).orderBy(src)))
    d = d.where(F.col(rows) == 1).withColumn(nth, F.lit(1)).union(many)
    times = F.floor(F.col(copies) / F.col(rows)).cast("int") + F.when(F.col(nth) <= F.col(copies) % F.col(rows), 1).otherwise(0)
    return d.withColumn(k, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as often as the mix takes it."""
    return mix(docs, carry=True)


def op10_sql() -> str:
    return f"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                      md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, ([1, 2, 3])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, ({PASSES} * source_size)::DOUBLE AS cap FROM s),
    l AS (SELECT *, cap / weight AS ratio,
                 (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
    o AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS nth FROM l),
    a AS (SELECT *, arg_min(level, CASE WHEN ratio >= level THEN nth END) OVER () AS lv FROM o),
    t AS (SELECT source, source_size, CASE WHEN ratio < lv THEN cap ELSE least(lv * weight, cap) END AS target FROM a),
    p AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS place
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    c AS (SELECT *, (k * source_size + place)::DOUBLE / target AS finish FROM p, (VALUES (0), (1), (2)) v(k) WHERE size > 0 AND target > 0),
    g AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, h, doc_id, place ROWS UNBOUNDED PRECEDING) AS spent FROM c),
    m AS (SELECT doc_id, source, place, sum(size)::BIGINT AS taken FROM g WHERE spent <= (SELECT sum(size) FROM d) GROUP BY ALL)
    SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(m.taken, 0)::BIGINT AS taken
    FROM p LEFT JOIN m ON p.doc_id IS NOT DISTINCT FROM m.doc_id AND p.source IS NOT DISTINCT FROM m.source AND p.place = m.place AND p.size > 0"""
