"""Scopes and memory slices as tables: registry, children and descendants, patterns, slices of the memory.

A scope: scope_id, parent (null: none), type. A slice: slice_id, scopes, types, policy; its key is primary scope, sorted
types, sorted visibility and clearance, and equal keys are one slice.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import policies
from tessera.session import checkpoint


def scope_of(kind: str, task: Column, session: Column, workspace: Column, agent: Column, other: Column) -> Column:
    """The id of a scope of that type; without the part that its type needs, it is `other`."""
    some = {
        "agent_private": (agent, F.concat(F.lit("agent/"), agent, F.lit("/private"))), "task_shared": (task, F.concat(F.lit("task/"), task, F.lit("/shared"))),
        "session": (session, F.concat(F.lit("session/"), session)), "workspace": (workspace, F.concat(F.lit("workspace/"), workspace)), "governed": (F.lit("x"), F.concat(F.lit("governed/"), other)),
    }
    part, made = some.get(kind, (F.lit(None).cast("string"), other))
    return F.when(F.coalesce(part, F.lit("")) != "", made).otherwise(other)


def from_requests(requests: DataFrame) -> DataFrame:
    """The scopes that requests name, each once: scope_id, type by the list that has it (the first list counts)."""
    lists = (("private", "agent_private"), ("shared", "task_shared"), ("workspace", "workspace"), ("governed", "governed"))
    rows = None
    for k, (column, kind) in enumerate(lists):
        part = requests.select(F.explode(column).alias("scope_id"), F.lit(k).alias("k"), F.lit(kind).alias("type"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("scope_id").agg(F.min_by("type", "k").alias("type"))


def register(scopes: DataFrame, new: DataFrame) -> DataFrame:
    """A scope that is registered again is replaced."""
    return scopes.join(new.select("scope_id").distinct(), "scope_id", "left_anti").unionByName(new)


def unregister(scopes: DataFrame, ids: DataFrame) -> DataFrame:
    """Children of a scope that goes stay, and keep its name as their parent's."""
    return scopes.join(ids.select("scope_id").distinct(), "scope_id", "left_anti")


def children(scopes: DataFrame) -> DataFrame:
    """scope_id, children: how many scopes name it as their parent."""
    n = scopes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("p")).agg(F.count(F.lit(1)).alias("k"))
    return scopes.join(n, F.col("scope_id") == F.col("p"), "left").select("scope_id", F.coalesce("k", F.lit(0)).alias("children"))


def matching(scopes: DataFrame, pattern: str) -> DataFrame:
    return scopes.where(policies.matches_pattern(F.col("scope_id"), pattern))


#: Letters of a gram that patterns and scopes meet on, at most.
GRAM = 12


def literals(pattern: str) -> list[str]:
    """The runs of a glob that stand for themselves; every string that matches has them."""
    runs = [""]
    for kind, text in policies.glob_tokens(pattern):
        if kind:
            runs.append("")
        else:
            runs[-1] += text
    return [r for r in runs if r]


def find(scopes: DataFrame, patterns: DataFrame) -> DataFrame:
    """scope_id; pattern -> pattern, scope_id of all that match, as `matching` for each pattern.

    Patterns without `*` are an equi-join. A glob's grams are its longest literal runs, cut to windows of GRAM letters where they are
    longer (the empty text if there is none), and the one that the fewest scopes have is its key; scopes meet patterns on the grams of
    theirs that are as long as some pattern's, and only those pairs run the glob. Grams grow with the names in patterns, so a
    pattern that names one scope of many meets few, however many there are. Nulls match nothing, repeated rows count once."""
    ids = checkpoint(scopes.select("scope_id").where("scope_id IS NOT NULL").distinct())
    asked = checkpoint(patterns.select("pattern").where("pattern IS NOT NULL").distinct())

    @F.pandas_udf("struct<glob:string,grams:array<string>>")
    def read(rows: pd.Series) -> pd.DataFrame:
        out = []
        for p in rows:
            runs = literals(p)
            size = min(GRAM, max(map(len, runs), default=0))
            grams = {r[k : k + size] for r in runs for k in range(len(r) - size + 1)} if size else {""}
            out.append((policies.glob_regex(p), sorted(grams)))
        return pd.DataFrame(out, columns=["glob", "grams"])

    globs = checkpoint(asked.where(F.contains("pattern", F.lit("*"))).select("pattern", read("pattern").alias("r")).select("pattern", "r.glob", F.explode("r.grams").alias("gram")))
    n = F.char_length("scope_id")
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda at: F.substr(F.col("scope_id"), at, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    used = [r["k"] for r in globs.select(F.char_length("gram").alias("k")).distinct().collect()]  # GRAM + 1 lengths at most
    every = F.array_distinct(F.concat(F.array(F.lit("")), *(of(k) for k in used if k)))
    has = checkpoint(ids.select("scope_id", F.explode(every).alias("gram")).join(globs.select("gram").distinct(), "gram", "left_semi"))
    counts = has.groupBy("gram").agg(F.count(F.lit(1)).alias("k"))
    keys = globs.join(counts, "gram", "left").groupBy("pattern", "glob").agg(F.min(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "gram")).alias("least")).where("least.k > 0")
    met = keys.select("pattern", "glob", "least.gram").join(has, "gram").where(F.rlike("scope_id", F.col("glob"))).select("pattern", "scope_id")
    same = asked.where(~F.contains("pattern", F.lit("*"))).join(ids, F.col("pattern") == F.col("scope_id")).select("pattern", "scope_id")
    return met.unionByName(same)


def descendants(scopes: DataFrame, roots: DataFrame) -> DataFrame:
    """scope_id, parent; scope_id of the roots -> root, scope_id, depth. A round finds the scopes one step below; a scope is
    met once under a root, so circles end."""
    below = scopes.select(F.col("scope_id").alias("next"), "parent")
    found = front = checkpoint(roots.select(F.col("scope_id").alias("root"), "scope_id").distinct().withColumn("depth", F.lit(0)))
    while True:
        front = front.join(below, F.col("scope_id") == F.col("parent")).select("root", F.col("next").alias("scope_id"), (F.col("depth") + 1).alias("depth")).distinct()
        front = checkpoint(front.join(found.select("root", "scope_id"), ["root", "scope_id"], "left_anti"))
        if front.isEmpty():
            return found.where("depth > 0")
        found = found.unionByName(front)


@dataclass(frozen=True)
class Slice:
    """A part of the memory, built step by step; each step gives a new one."""

    name: str = ""
    scopes: tuple[str, ...] = ()
    types: tuple[str, ...] = ("episodic",)
    visibility: tuple[str, ...] = policies.DEFAULT_VISIBILITY
    clearance: int = policies.DEFAULT_CLEARANCE
    zones: tuple[str, ...] = policies.DEFAULT_ZONES
    metadata: dict[str, str] = field(default_factory=dict)

    def with_scope(self, *scopes: str) -> Slice:
        return replace(self, scopes=self.scopes + scopes)

    def with_types(self, *types: str) -> Slice:
        return replace(self, types=types)

    def add_type(self, kind: str) -> Slice:
        return self if kind in self.types else replace(self, types=(*self.types, kind))

    def with_policy(self, visibility: tuple[str, ...] | None = None, clearance: int | None = None, zones: tuple[str, ...] | None = None) -> Slice:
        return replace(self, visibility=self.visibility if visibility is None else visibility, clearance=self.clearance if clearance is None else clearance, zones=self.zones if zones is None else zones)

    def build(self) -> Slice:
        if not self.scopes:
            raise ValueError("a slice needs a scope")
        return self

    @property
    def key(self) -> tuple:
        return self.scopes[0] if self.scopes else "default", tuple(sorted(self.types)), tuple(sorted(self.visibility)), self.clearance

    def column(self) -> Column:
        """Scope and type in the slice's, visibilities overlapping; clearance and zones play no part."""
        ok = F.col("scope_id").isin(*self.scopes) & F.col("memory_type").isin(*self.types)
        return ok & F.arrays_overlap(F.col("visibility"), F.array(*map(F.lit, self.visibility)))


def slices(requests: DataFrame) -> DataFrame:
    """The slices that requests ask for, one for each key: slice_id, primary, type_key, visibility, clearance, requests, and
    scopes, types and asked of the first request that has the key. requests: as views, with primary and all_scopes."""
    vis = F.array_join(F.sort_array("policy.visibility"), ",")
    rows = requests.select("ord", "primary", F.array_join(F.sort_array("types"), ",").alias("type_key"), vis.alias("visibility"), F.col("policy.clearance").alias("clearance"), "all_scopes", "types", F.col("policy.visibility").alias("asked"))
    key = ["primary", "type_key", "visibility", "clearance"]
    first = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("requests"), F.min_by(F.struct("all_scopes", "types", "asked"), "ord").alias("s"))
    return first.select(F.concat(F.lit("slice_"), F.substring(F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key))), 1, 8)).alias("slice_id"), *key, "requests", F.col("s.all_scopes").alias("scopes"), "s.types", "s.asked")


def matches(slices: DataFrame, memory: DataFrame) -> DataFrame:
    """slice_id, memory_id: an equi-join on scope, then type and visibility."""
    s = slices.select("slice_id", F.explode(F.array_distinct("scopes")).alias("scope"), "types", "asked")
    ok = (F.col("scope") == F.col("scope_id")) & F.array_contains("types", F.col("memory_type")) & F.arrays_overlap("visibility", "asked")
    return s.join(memory.select("memory_id", "scope_id", "memory_type", "visibility"), ok).select("slice_id", "memory_id").distinct()
