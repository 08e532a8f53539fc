"""Extension: the time to live of entries as streaming state.

Each entry keeps its last version and an event-time timer. When the watermark passes the end of its time, the entry's expiry is a
row of the result and its state goes. A later version of an entry takes the place of the one before, with its timer; a version
without a time to live takes the timer away. The state of an entry without one stays until the watermark passes the version's own
time, behind which no older one can arrive any more, so state is bounded by what can still expire or be overtaken.

What arrives later than the watermark's delay is lost, as in any stream. Of versions of one time, the one with the longest time to live
counts (none is longest). Null ids are one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.session import scratch

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "memory_id string, scope_id string, created_at timestamp, expired_at timestamp"
FOREVER = 2**62


class Expiry(StatefulProcessor):
    """State: at (of the version, microseconds), due (when it expires; FOREVER: never), timer (milliseconds), scope."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "at long, due long, timer long, scope string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.entry.get() if self.entry.exists() else None
        held = best
        for frame in rows:
            for at, due, scope in zip(frame["at"].tolist(), frame["due"].tolist(), frame["scope_id"].tolist(), strict=True):
                if best is None or (at, due) > (best[0], best[1]):
                    best = (at, due, None, scope)
        if best is not held:
            if held is not None:
                self.handle.deleteTimer(held[2])
            self._keep(best[0], best[1], best[3], (best[0] if best[1] == FOREVER else best[1]) // 1000)
        yield from ()

    def _keep(self, at: int, due: int, scope: str | None, timer: int) -> None:
        self.handle.registerTimer(timer)
        self.entry.update((at, due, timer, scope))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.entry.exists():
            return
        at, due, timer, scope = self.entry.get()
        now = timerValues.getCurrentWatermarkInMs()
        if (at if due == FOREVER else due) >= now * 1000:  # the end itself has not passed yet
            self._keep(at, due, scope, max(timer, now) + 1)
            return
        self.entry.clear()
        if due != FOREVER:
            time = lambda us: pd.to_datetime([us], unit="us")
            yield pd.DataFrame({"memory_id": [key[0]], "scope_id": [scope], "created_at": time(at), "expired_at": time(due)})

    def close(self) -> None:
        pass


def expiries(stream: DataFrame, at: str = "created_at", ttl: str = "ttl", delay: str = "10 minutes") -> DataFrame:
    """stream: memory_id, scope_id, a time and a time to live in seconds (null: forever) -> RESULT, a row for each entry that expired,
    once. The session's state store must be PROVIDER's."""
    rows = stream.withWatermark(at, delay)
    micros = F.unix_micros(F.col(at))
    due = F.coalesce(micros + (F.col(ttl) * 1_000_000).cast("long"), F.lit(FOREVER))
    rows = rows.where(F.col(at).isNotNull()).select("memory_id", "scope_id", F.col(at), micros.alias("at"), due.alias("due"))
    return rows.groupBy("memory_id").transformWithStateInPandas(Expiry(), RESULT, "append", "EventTime")


def run(stream: DataFrame, **options) -> DataFrame:
    """Runs a stream of entries to the end of what is there, into a table of the shared folder."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        out = scratch(spark, "expired")
        q = expiries(stream, **options).writeStream.format("parquet").option("checkpointLocation", scratch(spark, "expiry")).trigger(availableNow=True).start(out)
        q.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(RESULT).parquet(out)
