"""Access policies and scopes as column expressions.

A policy is a struct of visibility array<string>, clearance int, zones array<string>, audit boolean.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_VISIBILITY, DEFAULT_CLEARANCE, DEFAULT_ZONES = ("team",), 3, ("quarantine", "audit_hold")
#: A policy read from a record without zones has only this one.
WIRE_ZONES = ("quarantine",)


def from_record(visibility: Column, clearance: Column, zones: Column, audit: Column) -> Column:
    """A policy as it is read from a record: what is missing has the record's defaults, not those of a new policy."""
    strings = lambda xs: F.array(*map(F.lit, xs))
    return F.struct(F.coalesce(visibility, strings(DEFAULT_VISIBILITY)).alias("visibility"), F.coalesce(clearance, F.lit(DEFAULT_CLEARANCE)).alias("clearance"), F.coalesce(zones, strings(WIRE_ZONES)).alias("zones"), F.coalesce(audit, F.lit(False)).alias("audit"))


def as_set(a: Column) -> Column:
    return F.sort_array(F.array_distinct(a))


def compatible(p: Column, q: Column) -> Column:
    """Visibilities overlap; clearance, zones as sets, and audit are equal."""
    return F.arrays_overlap(p["visibility"], q["visibility"]) & (p["clearance"] == q["clearance"]) & (as_set(p["zones"]) == as_set(q["zones"])) & (p["audit"] == q["audit"])


def policy_hash(p: Column) -> Column:
    """md5 over sorted visibility, clearance and sorted zones. Audit is not part of it."""
    return F.md5(F.concat_ws("|", F.array_join(F.sort_array(p["visibility"]), ","), p["clearance"].cast("string"), F.array_join(F.sort_array(p["zones"]), ",")))


def merged(policies: Column) -> Column:
    """Of an array of policies: visibilities intersected (none left: team), least clearance, zones united, audit if any."""
    seen = F.aggregate(F.slice(policies, 2, F.greatest(F.size(policies) - 1, F.lit(0))), policies[0]["visibility"], lambda s, p: F.array_intersect(s, p["visibility"]))
    many = F.struct(
        F.when(F.size(seen) > 0, as_set(seen)).otherwise(F.array(F.lit("team"))).alias("visibility"),
        F.array_min(F.transform(policies, lambda p: p["clearance"])).alias("clearance"),
        as_set(F.flatten(F.transform(policies, lambda p: p["zones"]))).alias("zones"),
        F.exists(policies, lambda p: p["audit"]).alias("audit"),
    )
    return F.when(F.size(policies) == 1, policies[0]).otherwise(many)


def readable(memory_visibility: Column, asked: Column) -> Column:
    """The store's check: visibilities overlap; an empty or missing request passes. Clearance, zones and audit play no part."""
    return asked.isNull() | (F.size(asked) == 0) | F.arrays_overlap(memory_visibility, asked)


def primary_scope(shared: Column, workspace: Column, governed: Column, private: Column) -> Column:
    return F.coalesce(F.get(shared, F.lit(0)), F.get(workspace, F.lit(0)), F.get(governed, F.lit(0)), F.get(private, F.lit(0)), F.lit("default"))


def all_scopes(private: Column, shared: Column, workspace: Column, governed: Column) -> Column:
    return F.concat(private, shared, workspace, governed)


def overlap(a: Column, b: Column) -> Column:
    """Struct of kind, score and can_share for two lists of scopes."""
    x, y = as_set(a), as_set(b)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    subset = (both == F.size(x)) | (both == F.size(y))
    kind = F.when(both == 0, "disjoint").when(x == y, "identical").when(subset, "subset").otherwise("intersecting")
    score = F.when(both == 0, 0.0).when(x == y, 1.0).when(subset, both / F.greatest(F.size(a), F.size(b))).otherwise(both / either)
    return F.struct(kind.alias("kind"), score.alias("score"), (kind.isin("identical", "subset") | ((kind == "intersecting") & (score > 0.5))).alias("can_share"))


def glob_tokens(pattern: str) -> Iterator[tuple[str, str]]:
    """Kind and text of each part of a glob: `*`, `?`, `[` with what a closed class holds, or a letter that stands for itself."""
    at = 0
    while at < len(pattern):
        c, stop = pattern[at], -1
        if c == "[":
            stop = pattern.find("]", at + 2 + pattern.startswith("!", at + 1))
        if stop > 0:
            yield "[", pattern[at + 1 : stop]
            at = stop
        else:
            yield (c, "") if c in "*?" else ("", c)
        at += 1


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression of the JVM, whose classes have letters of their own meaning that Python's haven't."""
    quoted = lambda c: c if c.isalnum() or ord(c) > 127 else f"\\{c}" if c.isprintable() else f"\\x{ord(c):02x}"
    out = []
    for kind, text in glob_tokens(pattern):
        if kind == "[":
            no, body, items, at = text.startswith("!"), text.removeprefix("!"), [], 0
            while at < len(body):
                if at + 2 < len(body) and body[at + 1] == "-":  # a range; one that is upside down holds nothing
                    items += [f"{quoted(body[at])}-{quoted(body[at + 2])}"] if body[at] <= body[at + 2] else []
                    at += 3
                else:
                    items.append(quoted(body[at]))
                    at += 1
            out.append(f"[{'^' if no else ''}{''.join(items)}]" if items else "." if no else "(?!)")
        else:
            out.append({"*": ".*", "?": "."}.get(kind) or quoted(text))
    return r"(?s)\A" + "".join(out) + r"\z"


def matches_pattern(scope: Column, pattern: str) -> Column:
    """`*` makes it a glob, in which `?` and `[...]` count too; without one it is equality."""
    return scope.rlike(glob_regex(pattern)) if "*" in pattern else scope == pattern


def expired(created_at: Column, ttl: Column, as_of: Column) -> Column:
    """Older than its time to live, in seconds; equal age is not."""
    return ttl.isNotNull() & ((F.unix_micros(as_of) - F.unix_micros(created_at)) / 1e6 > ttl)


# For how many seconds a row of a type is taken to be of use, and what becomes of it then.
WINDOWS = {"episodic": 86400, "semantic": 604800, "artifact": 259200, "shared": 172800, "working": 3600}
RETENTION = {"episodic": "adaptive", "semantic": "persistent", "artifact": "versioned", "shared": "collaborative", "working": "ephemeral"}


def relevant(memory_type: Column, created_at: Column, as_of: Column) -> Column:
    """Whether a row is within its type's window; types without one always are, rows without a time never."""
    age = (F.unix_micros(as_of) - F.unix_micros(created_at)) / 1e6
    window = F.try_element_at(F.create_map(*[F.lit(x) for kv in WINDOWS.items() for x in kv]), memory_type)
    return F.coalesce(created_at.isNotNull() & (window.isNull() | (age <= window)), F.lit(False))


def retention(memory_type: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RETENTION.items() for x in kv]), memory_type), F.lit("adaptive"))
