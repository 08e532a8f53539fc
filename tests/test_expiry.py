"""Expiry in a stream against memory.purge over the last versions."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import memory as M
from tessera.session import scratch
from tessera.streaming import expiry

SCHEMA = "memory_id string, scope_id string, created_at timestamp, ttl long"
START = datetime(2024, 1, 1, tzinfo=UTC)


def batches():
    at = lambda m: START + timedelta(minutes=m)
    first = [(f"m{k}", f"s{k % 3}", at(k), None if k % 5 == 0 else 60 * (k % 37 + 1)) for k in range(60)]
    first += [("twice", "a", at(1), 60), ("twice", "b", at(30), 3000), ("same", "a", at(7), 60), ("same", "b", at(7), 120), (None, "n", at(5), 60)]
    second = [("m1", "new", at(70), 6000), ("m7", "new", at(65), None), ("m13", "old", at(50), 60), ("m59", "x", at(61), 60), ("late", "s", at(66), 30)]
    third = [("edge", "s", at(100), 1200), ("end", "s", at(120), None)]
    return [first, second, third]


@pytest.mark.parametrize("files", [1, 3])
def test_equals_purge(spark, files):
    path, parts = scratch(spark, "entries"), batches()
    if files == 1:
        parts = [sum(parts, [])]
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    got = expiry.run(stream, delay="0 seconds" if files == 1 else "60 minutes")
    rows = spark.read.schema(SCHEMA).parquet(path)
    last = Window.partitionBy("memory_id").orderBy(F.desc("created_at"), F.desc_nulls_first("ttl"))
    rows = rows.withColumn("nth", F.row_number().over(last)).where("nth = 1")
    as_of = F.lit(START + timedelta(minutes=120 if files == 1 else 60))
    want = M.purge(rows.withColumn("created_at", F.col("created_at")), as_of)[1]
    plain = lambda df: sorted((str(r.memory_id), r.scope_id, r.created_at) for r in df.select("memory_id", "scope_id", "created_at").collect())
    assert plain(got) == plain(want) and got.count() > 10
    assert got.where("expired_at <= created_at").count() == 0
