"""Template texts of artifacts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a node writes when no model is asked. Names in braces are columns.
TEXTS = {
    ("PLANNER", "query_intent"): "[query_intent] node=planner\nI must decompose: {question}\nI need to retrieve: high-level topical context to decide the hop structure.",
    ("PLANNER", "scratch"): "[scratch] node=planner\nDecomposing the question into sequential hops: {question}",
    ("SOLVER", "query_intent"): "[query_intent] node={node} hop={hop}\nI must answer: {ask}\nI need to retrieve: facts that resolve this sub-question, plus any upstream conclusions from my ancestors.",
    ("SOLVER", "scratch"): "[scratch] node={node} hop={hop}\nConsidering sub-question: {ask}\nDrafting reasoning based on retrieved evidence and ancestor conclusions.",
    ("VERIFIER", "query_intent"): "[query_intent] node=verifier\nI must check provenance and cross-conclusion consistency.\nI need to retrieve: restricted audit traces and all task_shared conclusions.",
    ("VERIFIER", "scratch"): "[scratch] node=verifier\nInspecting each solver's conclusion for source-alignment.",
}
# Conclusions without a gold text, plans and audit reports.
NO_GOLD = "[conclusion] node={node} hop={hop}: (no gold oracle available)"
PLAN, PLAN_HOP, PLAN_BARE = "Plan for question: {question}", "\n  - hop {hop}: {ask}", "\n  - decompose into {hops} sequential solver hops."
AUDIT, AUDIT_LINE, AUDIT_NONE, AUDIT_END = "[audit_report] dataset={dataset}\nReviewed {n} solver conclusion(s):\n", "  - ", "  - (no conclusions)", "\nVerdict: provenance checks applied, no inconsistencies flagged."


def fill(text: str, **columns: Column) -> Column:
    """A text with columns in place of names in braces; null counts as empty."""
    import string

    parts = []
    for literal, name, _, _ in string.Formatter().parse(text):
        parts.append(F.lit(literal))
        if name:
            parts.append(F.coalesce(columns[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def ask(sub_questions: Column, hop: Column, question: Column) -> Column:
    return F.trim(F.coalesce(F.get(sub_questions, hop - 1), question))


def gold(task_shared: Column, supporting: Column, hop: Column) -> Column:
    """The first shared item of the hop, else the first supporting paragraph of it, else null."""
    first = lambda xs: F.get(F.filter(xs, lambda x: x["hop_index"] == hop), F.lit(0))["text"]
    return F.trim(F.coalesce(first(task_shared), first(supporting)))


def plan(question: Column, sub_questions: Column, hops: Column) -> Column:
    lines = F.transform(sub_questions, lambda s, k: fill(PLAN_HOP, hop=k + 1, ask=F.trim(s)))
    return F.concat(fill(PLAN, question=F.trim(question)), F.when(F.size(sub_questions) > 0, F.array_join(lines, "")).otherwise(fill(PLAN_BARE, hops=F.coalesce(hops, F.lit(2)))))


def audit(dataset: Column, conclusions: Column) -> Column:
    lines = F.array_join(F.transform(conclusions, lambda c: F.concat(F.lit(AUDIT_LINE), F.substring(c, 1, 120))), "\n")
    return F.concat(fill(AUDIT, dataset=dataset, n=F.size(conclusions)), F.when(F.size(conclusions) > 0, lines).otherwise(AUDIT_NONE), F.lit(AUDIT_END))


def conclusion(found: Column, node: Column, hop: Column) -> Column:
    return F.when(F.coalesce(found, F.lit("")) != "", found).otherwise(fill(NO_GOLD, node=node, hop=hop))


def artifact(node_type: Column, slot: Column, question: Column, node: Column, hop: Column, asked: Column) -> Column:
    out = None
    for (kind, name), text in TEXTS.items():
        made, hit = fill(text, question=F.trim(question), node=node, hop=hop, ask=asked), (node_type == kind) & (slot == name)
        out = F.when(hit, made) if out is None else out.when(hit, made)
    return out
