"""Text columns: normalising queries, keywords, routing words, steps of worked solutions."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]+"
#: Spaces at the ends of a step: the characters of Unicode's category Zs.
BLANKS = "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
SENTENCE = r"\.[ \t\n\f\r]+"
# Words that route a task, in order of precedence.
ROUTES = (("planner", ("plan", "constraint")), ("verifier", ("verify", "check")), ("critic", ("critic", "conflict")))
# Prefixes of role-aware queries.
ROLE_PREFIX = {"planner": "Planning task: ", "solver": "Solving task: ", "verifier": "Verification task: ", "critic": "Critique task: "}
# Answers, numbers and formulas in worked solutions.
ANSWER = r"####\s*([\-0-9\.,]+)"
BOXED = r"\\boxed\{([^}]+)\}"
NUMBER = r"\d+(?:\.\d+)?"
FORMULA = r"\$[^$]+\$"


def collapse(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, SPACE, " "), F.lit(" "))


def normalise_query(query: Column, role: Column | None = None, task: Column | None = None) -> Column:
    """White space collapsed, the role's prefix unless it is there, and the task in brackets in front."""
    out = collapse(query)
    if role is not None:
        prefix = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_PREFIX.items() for x in kv]), role), F.lit(""))
        out = F.when(F.startswith(out, prefix), out).otherwise(F.concat(prefix, out))
    if task is not None:
        out = F.when(F.coalesce(task, F.lit("")) == "", out).otherwise(F.concat(F.lit("[Task: "), task, F.lit("] "), out))
    return out


def chained(query: Column, *steps: Callable[[Column], Column]) -> Column:
    """One way of normalising after another."""
    for step in steps:
        query = step(query)
    return query


def templated(query: Column, role: Column, templates: dict[str, str], default: str = "{query}", **columns: Column) -> Column:
    """The role's template, with names in braces filled by columns of those names; one that names something else leaves the
    query as it is."""
    from tessera.functions.templates import fill

    known = {"query": query, "role": role, **columns}

    def made(text: str) -> Column:
        names = {n for _, n, _, _ in string.Formatter().parse(text) if n}
        return fill(text, **known) if names <= set(known) else query

    out = None
    for name, text in templates.items():
        out = F.when(role == name, made(text)) if out is None else out.when(role == name, made(text))
    return made(default) if out is None else out.otherwise(made(default))


def humanise(step: Column, prior: Column) -> Column:
    """A step like `A >> R` as a question; `#n` stands for what step n concluded, if prior has so many."""
    s = F.trim(F.coalesce(step, F.lit("")))
    parts = F.regexp_extract_all(s, F.lit(r"#\d+|[^#]+|#"), F.lit(0))
    known = F.transform(parts, lambda p: F.coalesce(F.when(p.rlike(r"^#\d+$"), F.concat(F.lit("("), F.get(prior, F.substring(p, 2, 9).cast("int") - 1), F.lit(")"))), p))
    told = F.array_join(known, "")
    left = F.substring_index(told, ">>", 1)
    right = F.trim(F.substr(told, F.length(left) + 3))
    question = F.when((F.trim(left) != "") & (right != ""), F.concat(F.lit("What is the "), right, F.lit(" of "), F.trim(left), F.lit("?"))).otherwise(told)
    return F.when(F.contains(s, F.lit(">>")), question).otherwise(s)


def words(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), SPACE), lambda x: x != ""))


def keyword_overlap(query: Column, content: Column) -> Column:
    q = words(query)
    return F.size(F.array_intersect(q, words(content))) / F.greatest(F.size(q), F.lit(1))


def route(task: Column) -> Column:
    low, out = F.lower(task), None
    for name, keys in ROUTES:
        hit = F.contains(low, F.lit(keys[0])) | F.contains(low, F.lit(keys[1]))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("solver")


def first_sentence(text: Column) -> Column:
    return F.trim(F.split_part(text, F.lit("."), F.lit(1)))


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_\-]+", "_")


def final_answer(answer: Column) -> Column:
    return F.regexp_extract(answer, ANSWER, 1)


def trimmed(parts: Column) -> Column:
    """Each text of a list without spaces at its ends. F.trim itself can't be handed to F.transform, which would give it a text's
    place in the list as the characters to cut."""
    return F.transform(parts, lambda x: F.btrim(x, F.lit(BLANKS)))


def steps(answer: Column) -> Column:
    """Lines that are not blank, before the final answer."""
    return F.filter(trimmed(F.split(F.split_part(answer, F.lit("####"), F.lit(1)), "\n")), lambda x: x != "")


def math_steps(solution: Column) -> Column:
    """Lines of ten characters or more if there are two such, else sentences."""
    lines = F.filter(trimmed(F.split(solution, "\n")), lambda x: F.char_length(x) >= 10)
    sentences = F.filter(trimmed(F.split(solution, SENTENCE)), lambda x: x != "")
    return F.when(F.size(lines) >= 2, lines).otherwise(sentences)


def first_step_with(steps: Column, needle: Column) -> Column:
    """1-based; 0 if none has it."""
    return F.array_position(F.transform(steps, lambda s: F.contains(s, needle)), F.lit(True))


def boxed_answer(solution: Column) -> Column:
    found = F.regexp_extract(solution, BOXED, 1)
    return F.when(found != "", found).otherwise(F.right(solution, F.lit(80)))
