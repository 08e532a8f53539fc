"""Extension: streams of memory entries and requests with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entries(stream: DataFrame, at: str = "created_at", delay: str = "10 minutes") -> DataFrame:
    """New entries, each id once within the watermark; state older than the delay goes."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(["memory_id"])


def request_cycles(stream: DataFrame, at: str = "asked_at", cycle: str = "1 minute", delay: str = "2 minutes") -> DataFrame:
    """How many requests of each primary scope and type key a scheduling cycle has: what the cycle's routing will group."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, cycle), "primary", "type_key").agg(F.count(F.lit(1)).alias("requests"), F.approx_count_distinct("policy_hash").alias("policies"))


def live(stream: DataFrame, at: str = "created_at", delay: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Entries by scope and hour, late ones counted until the watermark passes."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, window), "scope_id", "memory_type").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"))
