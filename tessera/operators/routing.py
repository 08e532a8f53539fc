"""Grouping requests that may share work: by scope, memory types and policy, by scope alone, or by overlapping scopes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import policies
from tessera.operators import search
from tessera.session import checkpoint


def keyed(requests: DataFrame) -> DataFrame:
    """Adds primary, all_scopes, type_key and policy_hash."""
    return requests.withColumns({
        "primary": policies.primary_scope(F.col("shared"), F.col("workspace"), F.col("governed"), F.col("private")),
        "all_scopes": policies.all_scopes(F.col("private"), F.col("shared"), F.col("workspace"), F.col("governed")),
        "type_key": F.array_join(F.sort_array("types"), ","),
        "policy_hash": policies.policy_hash(F.col("policy")),
    })


def _seeds(group: pd.DataFrame) -> pd.DataFrame:
    """Distinct policies of one scope and type key, in order: each open one opens a group and draws in what it is compatible with."""
    left = group.sort_values("first").to_dict("records")
    out = []
    while left:
        seed, *left = left
        mates = [seed] + [p for p in left if set(p["vis"]) & set(seed["vis"]) and (p["clearance"], set(p["zones"]), p["audit"]) == (seed["clearance"], set(seed["zones"]), seed["audit"])]
        out += [(p["primary"], p["type_key"], p["pkey"], seed["pkey"]) for p in mates]
        taken = {p["pkey"] for p in mates}
        left = [p for p in left if p["pkey"] not in taken]
    return pd.DataFrame(out, columns=["primary", "type_key", "pkey", "seed"])


def hierarchical(requests: DataFrame) -> DataFrame:
    """ord, request_id, bucket, member_ord, mode (shared, independent), scope, types, asked (visibility of the merged policy).

    Requests only differ by policy inside a scope and type key, so the greedy grouping runs over the distinct policies
    of a key, not over its requests. Members come in order of priority; behind the seed they stand in reverse."""
    pkey = F.to_json(F.struct("policy"))
    rows = keyed(requests).withColumn("pkey", pkey).withColumn("first", F.struct(-F.col("priority"), "ord"))
    kinds = rows.groupBy("primary", "type_key", "pkey").agg(F.min("first").alias("f"), F.first("policy").alias("p"))
    kinds = kinds.withColumn("first", F.row_number().over(Window.partitionBy("primary", "type_key").orderBy("f")))
    kinds = kinds.select("primary", "type_key", "pkey", "first", F.col("p.visibility").alias("vis"), F.col("p.clearance").alias("clearance"), F.col("p.zones").alias("zones"), F.col("p.audit").alias("audit"))
    seeds = kinds.groupBy("primary", "type_key").applyInPandas(_seeds, "primary string, type_key string, pkey string, seed string")
    rows = rows.join(seeds, ["primary", "type_key", "pkey"]).withColumn("bucket", F.concat_ws("|", "primary", "type_key", F.md5("seed")))
    rows = search.numbered(rows, ["bucket"], [F.col("priority").desc(), "ord"])
    rows = rows.withColumn("member_ord", F.when(F.col("at") == 1, 0).otherwise(F.col("n") - F.col("at") + 1).cast("int"))
    # merging is idempotent, so a bucket's distinct policies tell what all of its members would
    groups = rows.groupBy("bucket").agg(F.collect_set("policy").alias("all"), F.first("policy").alias("one"), F.count(F.lit(1)).alias("k"))
    groups = groups.withColumn("merged", F.when(F.col("k") == 1, F.col("one")).otherwise(policies.merged(F.concat("all", "all"))))
    groups = groups.select("bucket", "merged", F.forall("all", lambda p: policies.compatible(p, F.col("merged"))).alias("fits"))
    rows = rows.join(groups, "bucket")
    rows = rows.withColumn("mode", F.when((F.col("n") > 1) & F.col("fits"), "shared").otherwise("independent"))
    return rows.select("ord", "request_id", "bucket", "member_ord", "mode", F.col("primary").alias("scope"), "types", "merged", F.col("merged.visibility").alias("asked"), "policy", "n")


def scope_only(requests: DataFrame) -> DataFrame:
    """As hierarchical, by primary scope alone; no policy, types united in order of appearance."""
    rows = search.numbered(keyed(requests), ["primary"], [F.col("priority").desc(), "ord"]).withColumn("member_ord", F.col("at") - 1)
    seen = rows.select("primary", "member_ord", F.posexplode("types").alias("pos", "type")).groupBy("primary", "type").agg(F.min(F.struct("member_ord", "pos")).alias("first"))
    united = seen.groupBy("primary").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "type"))), lambda s: s["type"]).alias("all_types"))
    rows = rows.join(united, "primary", "left").withColumn("all_types", F.coalesce("all_types", F.array().cast("array<string>")))
    return rows.select("ord", "request_id", F.col("primary").alias("bucket"), "member_ord", F.when(F.col("n") > 1, "shared").otherwise("independent").alias("mode"), F.col("primary").alias("scope"), F.col("all_types").alias("types"), F.lit(None).cast("array<string>").alias("asked"), "policy", "n")


def forced(requests: DataFrame) -> DataFrame:
    """The control: one bucket for all requests, whatever their scopes, types and policies."""
    total = requests.agg(F.count(F.lit(1)).alias("n"))
    rows = requests.select("ord", "request_id", "policy", F.lit(1).alias("one")).join(total.withColumn("one", F.lit(1)), "one")
    return rows.select("ord", "request_id", F.lit("all").alias("bucket"), F.when(F.col("n") > 1, "shared").otherwise("independent").alias("mode"), "policy", "n")


def stats(routed: DataFrame) -> DataFrame:
    """Totals and sizes of the shared buckets."""
    sizes = routed.where("mode = 'shared'").groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    s = sizes.agg(F.count(F.lit(1)).alias("buckets"), F.coalesce(F.sum("size"), F.lit(0)).alias("shared_requests"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_size"), F.coalesce(F.max("size"), F.lit(0)).alias("max_size"), F.coalesce(F.min("size"), F.lit(0)).alias("min_size"))
    t = routed.agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("mode") == "independent").alias("independent"))
    return s.join(t).withColumn("shareable_ratio", F.when(F.col("requests") > 0, F.col("shared_requests") / F.col("requests")).otherwise(0.0))


def classes(requests: DataFrame) -> DataFrame:
    """ord, request_id, class: the least ord of those with the same scopes and policy, which overlap alike with all others."""
    rows = keyed(requests).withColumn("ckey", F.md5(F.to_json(F.struct("all_scopes", "policy"))))
    first = rows.groupBy("ckey").agg(F.min("ord").alias("class"))
    return rows.join(first, "ckey").select("ord", "request_id", "class", "primary", "types", "all_scopes", "policy")


def pairs(requests: DataFrame) -> DataFrame:
    """a <= b, classes that share a scope, na and nb members, kind and score of their overlap, whether they may share, and
    whether their policies agree. a = b tells of a class's members among each other, if it has several."""
    rows = classes(requests).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.first("all_scopes").alias("s"), F.first("policy").alias("p"))
    ex = rows.select("class", F.explode(F.array_distinct("s")).alias("scope"))
    near = ex.toDF("a", "scope").join(ex.toDF("b", "scope"), "scope").where("a <= b").select("a", "b").distinct()
    found = near.join(rows.toDF("a", "na", "sa", "pa"), "a").join(rows.toDF("b", "nb", "sb", "pb"), "b").where("a < b OR na > 1")
    return found.withColumn("o", policies.overlap(F.col("sa"), F.col("sb"))).select("a", "b", "na", "nb", "o.kind", "o.score", "o.can_share", policies.compatible(F.col("pa"), F.col("pb")).alias("compatible"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node; a, b -> node, component: the least node reachable. A round lets each node take the least label of its
    neighbours and of its label's label; lineage is cut each round."""
    both = checkpoint(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = checkpoint(nodes.select("node", F.col("node").alias("label")))
    while True:
        seen = both.join(labels.toDF("b", "lb"), "b").groupBy("a").agg(F.min("lb").alias("near"))
        new = labels.join(seen, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        jump = new.select(F.col("node").alias("j"), F.col("next").alias("up"))
        new = checkpoint(new.join(jump, F.col("next") == F.col("j"), "left").select("node", "label", F.least("next", F.coalesce("up", "next")).alias("next")))
        if new.where("next < label").isEmpty():
            return new.select("node", F.col("next").alias("component"))
        labels = new.select("node", F.col("next").alias("label"))


def by_overlap(requests: DataFrame, threshold: float = 0.5) -> DataFrame:
    """ord, request_id, component, scope (the component's most frequent primary scope, the first at ties), size, types (all
    of its members', in order of name), merged (their policies as one). Components are found over classes of requests;
    members of a class whose policy doesn't agree with itself stay alone."""
    rows = checkpoint(classes(requests))
    found = checkpoint(pairs(requests).where((F.col("score") >= threshold) & F.col("compatible")))
    # a class that is alone and whose members don't agree with each other falls apart
    bound = found.where("a = b").select(F.col("a").alias("bound"))
    linked = connected(rows.select(F.col("class").alias("node")).distinct(), found.where("a < b"))
    rows = rows.join(linked, rows["class"] == linked["node"]).join(bound, rows["class"] == bound["bound"], "left")
    edged = found.where("a < b").select("a").union(found.where("a < b").select("b")).distinct().toDF("edged")
    rows = rows.join(edged, rows["class"] == edged["edged"], "left")
    rows = rows.withColumn("component", F.when(F.col("bound").isNull() & F.col("edged").isNull(), F.col("ord")).otherwise(F.col("component")))
    counts = rows.groupBy("component", "primary").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    best = counts.groupBy("component").agg(F.max_by("primary", F.struct("n", -F.col("first"))).alias("scope"), F.sum("n").alias("size"))
    types = rows.select("component", F.explode("types").alias("t")).groupBy("component").agg(F.sort_array(F.collect_set("t")).alias("types"))
    merged = rows.groupBy("component").agg(F.collect_set("policy").alias("all"), F.count(F.lit(1)).alias("k"))
    merged = merged.select("component", F.when(F.col("k") == 1, F.col("all")[0]).otherwise(policies.merged(F.concat("all", "all"))).alias("merged"))
    return rows.join(best, "component").join(types, "component", "left").join(merged, "component").select("ord", "request_id", "component", "scope", "size", types["types"], "merged")
