"""The memory table: filters, paging, statistics, changes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import policies


@dataclass(frozen=True)
class Filter:
    """Criteria that are empty are not applied."""

    scopes: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    visibility: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    min_confidence: float = 0.0
    max_age_seconds: float = 0.0
    source: str = ""
    agent_id: str = ""
    metadata: dict[str, str] = field(default_factory=dict)

    def column(self, as_of: Column) -> Column:
        any_of = lambda c, xs: F.arrays_overlap(F.col(c), F.array(*map(F.lit, xs)))
        out = F.lit(True)
        if self.scopes:
            out &= F.col("scope_id").isin(*self.scopes)
        if self.types:
            out &= F.col("memory_type").isin(*self.types)
        if self.visibility:
            out &= any_of("visibility", self.visibility)
        if self.tags:
            out &= any_of("tags", self.tags)
        if self.min_confidence:
            out &= F.col("confidence") >= self.min_confidence
        if self.max_age_seconds:
            out &= (F.unix_micros(as_of) - F.unix_micros("created_at")) / 1e6 <= self.max_age_seconds
        if self.source:
            out &= F.contains(F.col("source"), F.lit(self.source))
        if self.agent_id:
            out &= F.col("agent_id") == self.agent_id
        for k, v in self.metadata.items():  # keys are whole, dots and all
            out &= F.try_element_at(F.from_json("metadata", "map<string,string>"), F.lit(k)) == v
        return out


def page(rows: DataFrame, keep: Column, order: list[Column], sort: list[Column], limit: int, offset: int, parity: bool = False) -> DataFrame:
    """A page of rows. As meant: filter, order, cut. In parity mode the first limit + offset rows are cut off before the filter, and
    the page is sorted afterwards by `sort`; `at` is the place on the page."""
    if parity:
        head = rows.orderBy(*order).limit(limit + offset).where(keep)
        at = Window.orderBy(*order)
        cut = head.withColumn("_at", F.row_number().over(at)).where((F.col("_at") > offset) & (F.col("_at") <= offset + limit)).drop("_at")
        return cut.withColumn("at", F.row_number().over(Window.orderBy(*sort)))
    head = rows.where(keep).orderBy(*sort).limit(limit + offset)
    return head.withColumn("at", F.row_number().over(Window.orderBy(*sort)) - offset).where("at > 0")


def statistics(rows: DataFrame) -> DataFrame:
    """grain (all, scope, type), key, n, avg_confidence in one pass of grouping sets."""
    t = rows.select("scope_id", "memory_type", "confidence").groupingSets([[], [F.col("scope_id")], [F.col("memory_type")]], "scope_id", "memory_type")
    a = t.agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"), F.grouping("scope_id").alias("gs"), F.grouping("memory_type").alias("gt"))
    grain = F.when(F.col("gs") == 0, "scope").when(F.col("gt") == 0, "type").otherwise("all")
    return a.select(grain.alias("grain"), F.coalesce("scope_id", "memory_type", F.lit("")).alias("key"), "n", "avg_confidence")


def purge(rows: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and what has expired."""
    gone = policies.expired(F.col("created_at"), F.col("ttl"), as_of)
    return rows.where(~gone), rows.where(gone)


def update(rows: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """changes: memory_id and any of content, visibility, confidence, tags, metadata (a map, merged into the old one);
    nulls leave what is there. Ids that aren't there are no error."""
    fields = [c for c in changes.columns if c != "memory_id"]
    c = changes.select(F.col("memory_id").alias("_id"), *(F.col(f).alias(f"_new_{f}") for f in fields))
    j = rows.join(c, F.col("memory_id") == F.col("_id"), "left")
    for f in fields:
        new = F.col(f"_new_{f}")
        if f == "metadata" and dict(rows.dtypes)[f].startswith("map"):
            kept = F.map_filter(F.col(f), lambda k, v: ~F.array_contains(F.coalesce(F.map_keys(new), F.array().cast("array<string>")), k))
            j = j.withColumn(f, F.when(new.isNull(), F.col(f)).otherwise(F.map_concat(kept, new)))
        else:
            j = j.withColumn(f, F.coalesce(new, F.col(f)))
    return j.withColumn("updated_at", F.when(F.col("_id").isNotNull(), as_of).otherwise(F.col("updated_at") if "updated_at" in rows.columns else F.col("created_at"))).drop("_id", *(f"_new_{f}" for f in fields))


def upsert(rows: DataFrame, new: DataFrame, version: str = "ord") -> DataFrame:
    """The last version of each id."""
    both = rows.unionByName(new, allowMissingColumns=True)
    return both.withColumn("_nth", F.row_number().over(Window.partitionBy("memory_id").orderBy(F.col(version).desc()))).where("_nth = 1").drop("_nth")


def delete(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("memory_id").distinct(), "memory_id", "left_anti")


def deleted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: how many of the ids asked for are there, and so go, and how many are not."""
    asked = ids.select("memory_id").distinct()
    hit = asked.join(rows.select("memory_id").distinct().withColumn("there", F.lit(True)), "memory_id", "left")
    return hit.agg(F.count_if(F.col("there").isNotNull()).alias("deleted"), F.count_if(F.col("there").isNull()).alias("missing"))


def totals(rows: DataFrame) -> DataFrame:
    """One row: entries, scopes and types that have any."""
    return rows.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("scope_id").alias("scopes"), F.count_distinct("memory_type").alias("types"))


def create(rows: DataFrame, as_of: Column) -> DataFrame:
    """Defaults of new entries: zero vectors are missing vectors; id by content and place."""
    zero = ~F.exists("embedding", lambda x: x != 0)
    return rows.withColumns({
        "embedding": F.when(zero, None).otherwise(F.col("embedding")),
        "visibility": F.when(F.size(F.coalesce("visibility", F.array().cast("array<string>"))) == 0, F.array(F.lit("team"))).otherwise(F.col("visibility")),
        "salience": F.coalesce("salience", F.lit(0.5)),
        "created_at": as_of,
        "updated_at": as_of,
        "memory_id": F.concat(F.lit("mem_"), F.substring(F.md5("content"), 1, 12), F.lit("_"), F.col("ord").cast("string")),
    })


def accessible(agents: DataFrame, entries: DataFrame) -> DataFrame:
    """agents: agent_id, role, scopes, ancestors, clearance, zones; entries: memory_id, scope_id, layer, source_node,
    required_clearance, tags, quarantined. Pairs that row-level security lets through."""
    a = agents.withColumn("scope", F.explode("scopes"))
    j = a.join(entries, F.col("scope") == F.col("scope_id"))
    below = (F.col("role") != "solver") | (F.col("layer") != "task_shared_episodic") | F.array_contains("ancestors", F.col("source_node"))
    ok = below & (F.col("required_clearance") <= F.col("clearance")) & ~F.col("quarantined") & ~F.arrays_overlap("tags", "zones")
    return j.where(ok).select("agent_id", "memory_id").distinct()
