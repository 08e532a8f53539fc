"""Rerank features and role weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.texts import keyword_overlap

# Source keys and their authority; the first that the source contains counts.
AUTHORITY = (("verified", 1.0), ("tool_output", 0.9), ("agent_generated", 0.7), ("user_input", 0.8), ("external", 0.6), ("unknown", 0.5))
# Feature weights by role; "default" is for every other role.
ROLE_WEIGHTS = {
    "planner": {"summary": 0.4, "keyword": 0.3, "recency": 0.2, "authority": 0.1},
    "solver": {"summary": 0.5, "keyword": 0.3, "authority": 0.2},
    "verifier": {"provenance": 0.4, "authority": 0.3, "recency": 0.3},
    "default": {"summary": 0.5, "keyword": 0.3, "recency": 0.2},
}
FEATURES = ("summary", "keyword", "recency", "authority", "provenance")
DECAY = 0.1


def recency(created_at: Column, as_of: Column, decay: float = DECAY) -> Column:
    return F.exp(-decay * ((F.unix_micros(as_of) - F.unix_micros(created_at)) / 1e6) / 3600)


def authority(source: Column) -> Column:
    low, out = F.lower(source), None
    for key, weight in AUTHORITY:
        hit = F.contains(low, F.lit(key))
        out = F.when(hit, weight) if out is None else out.when(hit, weight)
    return out.otherwise(AUTHORITY[-1][1])


def provenance(parent: Column, agent: Column, at: Column, version: Column) -> Column:
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    score = F.when(full(parent), 0.3).otherwise(0.0) + F.when(full(agent), 0.3).otherwise(0.0) + F.when(at.isNotNull(), 0.2).otherwise(0.0)
    score = score + F.when(version > 1, 0.2 * F.least(version / 5, F.lit(1.0))).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def weight(role: Column, feature: str, fix_keyword: bool = False) -> Column:
    """Keyword weights are never applied unless fix_keyword: the feature's own name differs from the weight's."""
    if feature == "keyword" and not fix_keyword:
        return F.lit(0.0)
    out = None
    for name, weights in ROLE_WEIGHTS.items():
        if name != "default":
            out = F.when(role == name, weights.get(feature, 0.0)) if out is None else out.when(role == name, weights.get(feature, 0.0))
    return out.otherwise(ROLE_WEIGHTS["default"].get(feature, 0.0))


def with_features(rows, as_of: Column, query: str | None = "query"):
    """rows have the memory's columns and the request's query; without a query there is no keyword feature, and no content
    is read."""
    return rows.withColumns({
        "summary": F.col("confidence"),
        "keyword": F.lit(0.0) if query is None else keyword_overlap(F.col(query), F.col("content")),
        "recency": recency(F.col("created_at"), as_of),
        "authority": authority(F.col("source")),
        "provenance": provenance(F.col("parent_event"), F.col("prov_agent"), F.col("prov_at"), F.col("version")),
    })


def rerank_score(role: Column, fix_keyword: bool = False) -> Column:
    """Only what a role weighs is added up: recency is infinite for times far ahead, and no weight of 0 undoes that."""
    out = None

    def total(weights: dict[str, float]) -> Column:
        return reduce(lambda a, b: a + b, [F.lit(weights[f]) * F.col(f) for f in FEATURES if f in weights and (fix_keyword or f != "keyword")])

    for name, weights in ROLE_WEIGHTS.items():
        if name != "default":
            out = F.when(role == name, total(weights)) if out is None else out.when(role == name, total(weights))
    return out.otherwise(total(ROLE_WEIGHTS["default"]))


def rounded(x: Column, places: int) -> Column:
    """x at so many places, as scaling, rounding and scaling back give it, which is what SQL does: a value too large to have places
    may change in its last digit, and one too large to be scaled stays."""
    scaled = x * F.lit(10.0**places)
    return F.when((F.abs(scaled) >= 2.0**52) & (F.abs(scaled) < float("inf")), scaled / F.lit(10.0**places)).otherwise(F.round(x, places))
