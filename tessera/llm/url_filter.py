"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over `host + path`, in the usual block-list notation: `||` anchors at the start of a host label,
a leading `|` at the start, a trailing `|` at the end, `*` is any run, `^` a separator or the end; everything else
is literal. Literal tokens are runs of [a-z0-9] (A-Z folded) that the pattern delimits on both sides, so a URL that
matches must have them as whole tokens. Each rule is filed under the one of its tokens that the fewest URLs of the
input have; a URL's tokens fetch candidates and only those run their regular expressions. Rules without such a token
are candidates of every URL.

Null or scheme-less URLs have empty host and path, so that only token-less rules can fit; the default verdict holds.
URLs of any length are read whole. Of rules that fit equally long the last by name decides; of patterns the first is named. Repeated
rows are judged one by one. Other columns stay, whatever their names, but such as have the name of a result make
room for it. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import free_names, small_batches

# Host and path rules of the query's contract.
PATH_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Default patterns for URLs that no host and path rule decides: spam hosts, trackers, adverts.
PATTERNS = (
    "||spam-farm.", "||cheap-pills.", "||free-bets.", "||ads.", "||track.", "||ads-track.", "||casino.", "||adserver.",
    "/banner/", "/popup/", "/affiliate/", "||doubleclick^", "||click-bait.",
)
TOKEN = re.compile("[a-z0-9]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    literals: tuple[str, ...]
    rank: int = 0


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host, its subdomains, and paths that begin with path; longer rules win."""
    tokens = TOKEN.findall(host.translate(FOLD)) + [m[0] for m in TOKEN.finditer(path.translate(FOLD)) if m.start() > 0 and m.end() < len(path)]
    return Rule(host + path, verdict, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens), len(host + path))


def pattern_rule(pattern: str, verdict: str = "block") -> Rule:
    body, head, tail = pattern, ".*", ""
    if body.startswith("||"):
        body, head = body[2:], r"(?:[^/]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], ""
    if body.endswith("|"):
        body, tail = body[:-1], r"\Z"
    regex = "".join(".*" if c == "*" else r"(?:[^A-Za-z0-9_.%-]|\Z)" if c == "^" else re.escape(c) for c in body)
    tokens = []
    for m in TOKEN.finditer(body.translate(FOLD)):
        open_left = m.start() == 0 and head == ".*" or m.start() > 0 and body[m.start() - 1] == "*"
        open_right = m.end() == len(body) and not tail or m.end() < len(body) and body[m.end()] == "*"
        if not open_left and not open_right:
            tokens.append(m[0])
    return Rule(pattern, verdict, head + regex + tail, tuple(tokens))


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(text: Column) -> Column:
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(folded, F.lit("([a-z0-9]+)"), 1))


def token_counts(urls: DataFrame, literals: set[str]) -> dict[str, int]:
    """In how many URLs each literal occurs, over all rows; as many entries as the rules have literals at most."""
    rows = urls.select(F.explode(tokens(F.concat("host", "path"))).alias("t")).where(F.col("t").isin(sorted(literals))).groupBy("t").count()
    return {r["t"]: r["count"] for r in rows.toLocalIterator()} if literals else {}


class Index:
    """Rules by their rarest literal."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.rules = rules
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        for k, r in enumerate(rules):
            if r.literals:
                self.by_token.setdefault(min(r.literals, key=lambda t: (counts.get(t, 0), t)), []).append(k)
            else:
                self.always.append(k)
        self.compiled: list[re.Pattern | None] = [None] * len(rules)

    def match(self, text: str) -> list[int]:
        found = list(self.always)
        for t in set(TOKEN.findall(text.translate(FOLD))):
            found += self.by_token.get(t, ())
        out = []
        for k in found:
            if self.compiled[k] is None:
                self.compiled[k] = re.compile(self.rules[k].regex, re.S)
            if self.compiled[k].match(text):
                out.append(k)
        return out


def filter_urls(pages: DataFrame, url: str = "url", path_rules=PATH_RULES, patterns=PATTERNS, default: str = "allow") -> DataFrame:
    """Adds host, path, rule, pattern and verdict to pages. The longest host and path rule decides; without one, a
    pattern that fits blocks; else the default verdict."""
    mine = [host_rule(*r) for r in path_rules]
    rules = mine + [pattern_rule(p) for p in patterns]
    split = len(mine)
    small_batches(pages.sparkSession)
    h, p, judged = free_names(pages, "host", "path", "judged")
    out = pages.withColumn(h, host(F.col(url))).withColumn(p, path(F.col(url)))
    counts = token_counts(out.select(F.col(h).alias("host"), F.col(p).alias("path")), {t for r in rules for t in r.literals})
    shared = pages.sparkSession.sparkContext.broadcast((rules, counts))  # a block list is large; a task's closure is not

    @F.pandas_udf("rule string, pattern string, verdict string")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rules, counts = shared.value
        index = Index(rules, counts)
        for part in texts:
            rows = []
            for text in part:
                hits = index.match(text)
                own = max((k for k in hits if k < split), key=lambda k: (rules[k].rank, rules[k].name), default=None)
                other = min((rules[k].name for k in hits if k >= split), default=None)
                rows.append((None if own is None else rules[own].name, other, rules[own].verdict if own is not None else "block" if other else default))
            yield pd.DataFrame(rows, columns=["rule", "pattern", "verdict"])

    results = {"host", "path", "rule", "pattern", "verdict"}
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in results]
    return out.withColumn(judged, judge(F.concat(h, p))).select(*kept, F.col(h).alias("host"), F.col(p).alias("path"), f"{judged}.*")


def op1(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op1_sql() -> str:
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = [f"SELECT '{h}{p}' AS rule, '{v}' AS verdict, '{h}' AS h, '{p}' AS p" for v, h, p in PATH_RULES]
    pats = [(p, pattern_rule(p).regex.replace("'", "''").replace(r"\Z", "$")) for p in PATTERNS]
    cases = ", ".join(f"CASE WHEN regexp_matches(host || path, '^{r}', 's') THEN '{p}' END" for p, r in pats)
    return f"""
    WITH u AS (SELECT page_id, {fold.format("regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')")} AS host,
                      regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, row_number() OVER () AS n FROM pages),
    r AS ({" UNION ALL ".join(fits)}),
    b AS (SELECT n, arg_max(struct_pack(rule := rule, verdict := verdict), (length(rule), rule)) AS best
          FROM u, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n),
    j AS (SELECT *, list_aggregate([{cases}], 'min') AS pattern FROM u LEFT JOIN b USING (n))
    SELECT page_id, host, path, best.rule AS rule,
           coalesce(best.verdict, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern FROM j"""
