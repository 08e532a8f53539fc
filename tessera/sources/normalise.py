"""Raw multi-hop QA and math rows as items of one shape.

An item: original_id, question, answer, hop_count, sub_questions, solution_steps, supporting_paragraphs and
distractor_paragraphs (paragraph_id, text, title, is_gold, hop_index), supporting_facts (paragraph_id, sentence_idx),
task_shared_items (hop_index, text, source_paragraph_id), dataset, qa_type, math_category.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import texts

PARAGRAPH = "struct<paragraph_id:string,text:string,title:string,is_gold:boolean,hop_index:int>"
FACT = "struct<paragraph_id:string,sentence_idx:int>"
SHARED = "struct<hop_index:int,text:string,source_paragraph_id:string>"
ITEM = {
    "original_id": "string", "question": "string", "answer": "string", "hop_count": "int", "sub_questions": "array<string>", "solution_steps": "array<string>", "supporting_paragraphs": f"array<{PARAGRAPH}>",
    "distractor_paragraphs": f"array<{PARAGRAPH}>", "supporting_facts": f"array<{FACT}>", "task_shared_items": f"array<{SHARED}>", "dataset": "string", "qa_type": "string", "math_category": "string",
}


def item(rows: DataFrame, **columns: Column) -> DataFrame:
    """Missing columns are empty lists or nulls."""
    empty = lambda t: F.array().cast(t) if t.startswith("array") else F.lit(None).cast(t)
    return rows.select(*[(columns[c].cast(t) if c in columns else empty(t)).alias(c) for c, t in ITEM.items()])


# The texts "Numeric value: ", "Find information about " and "Step-n rationale: " of the items below.
def pid(k: Column, kind: str = "para_") -> Column:
    return F.concat(F.lit(kind), F.lpad(k.cast("string"), 3, "0"))


def paragraph(i: Column, text: Column, title: Column, gold: Column, hop: Column) -> Column:
    return F.struct(i.alias("paragraph_id"), text.alias("text"), title.alias("title"), gold.alias("is_gold"), hop.cast("int").alias("hop_index"))


def musique(rows: DataFrame) -> DataFrame:
    """Unanswerable rows go; a paragraph's hop is the earliest step that cites it."""
    rows = rows.where("answerable IS DISTINCT FROM false")
    steps = F.col("question_decomposition")
    hop = lambda i: F.array_position(F.transform(steps, lambda s: s["paragraph_support_idx"]), i.cast("int"))
    made = F.transform("paragraphs", lambda p, i: paragraph(pid(i), p["paragraph_text"], p["title"], p["is_supporting"], F.when(p["is_supporting"] & (hop(i) > 0), hop(i))))
    gold, rest = F.filter(made, lambda p: p["is_gold"]), F.filter(made, lambda p: ~F.coalesce(p["is_gold"], F.lit(False)))
    at = lambda s: F.get(F.col("paragraphs"), s["paragraph_support_idx"])
    shared = F.filter(F.transform(steps, lambda s, k: F.struct((k + 1).cast("int").alias("hop_index"), texts.first_sentence(at(s)["paragraph_text"]).alias("text"), pid(s["paragraph_support_idx"]).alias("source_paragraph_id"))), lambda x: x["text"].isNotNull())
    return item(rows, original_id=F.col("id"), question=F.col("question"), answer=F.col("answer"), hop_count=F.greatest(F.size(steps), F.lit(2)), sub_questions=F.transform(steps, lambda s: s["question"]), supporting_paragraphs=gold, distractor_paragraphs=rest, task_shared_items=shared, dataset=F.lit("musique"))


def _titled(rows: DataFrame, dataset: str, hops: Column, questions: Column) -> DataFrame:
    """rows: id, question, answer, type, titles, sentences (array<array<string>>), fact_titles, fact_sents."""
    order = F.array_distinct("fact_titles")
    hop = lambda t: F.array_position(order, t)
    made = F.transform(F.arrays_zip("titles", "sentences"), lambda p, i: paragraph(pid(i), F.array_join(p["sentences"], " "), p["titles"], hop(p["titles"]) > 0, F.when(hop(p["titles"]) > 0, hop(p["titles"]))))
    first = lambda t: F.array_position("titles", t)  # noqa: E731  the first context of a title counts
    facts = F.filter(F.transform(F.arrays_zip("fact_titles", "fact_sents"), lambda f: F.struct(first(f["fact_titles"]).alias("at"), f["fact_sents"].alias("sent"))), lambda x: x["at"] > 0)
    pairs = F.transform(facts, lambda x: F.struct(pid(x["at"] - 1).alias("paragraph_id"), x["sent"].cast("int").alias("sentence_idx")))

    def shared(f: Column, k: Column) -> Column:
        s = F.get(F.col("sentences"), (first(f["fact_titles"]) - 1).cast("int"))
        text = F.coalesce(F.when(f["fact_sents"] >= 0, F.get(s, f["fact_sents"].cast("int"))), F.get(s, F.lit(0)), F.lit(""))
        return F.struct((k + 1).cast("int").alias("hop_index"), F.trim(text).alias("text"), pid(first(f["fact_titles"]) - 1).alias("source_paragraph_id"))

    told = F.filter(F.transform(F.slice(F.arrays_zip("fact_titles", "fact_sents"), 1, 4), shared), lambda x: (x["hop_index"] <= hops) & ~F.endswith(x["source_paragraph_id"], F.lit("-1")))
    told = F.when(F.col("type") == "comparison", F.array().cast(f"array<{SHARED}>")).otherwise(told)
    return item(rows, original_id=F.col("id"), question=F.col("question"), answer=F.col("answer"), hop_count=hops, sub_questions=questions, supporting_paragraphs=F.filter(made, lambda p: p["is_gold"]), distractor_paragraphs=F.filter(made, lambda p: ~p["is_gold"]), supporting_facts=pairs, task_shared_items=told, dataset=F.lit(dataset), qa_type=F.coalesce(F.col("type"), F.lit("bridge")))


def columns_layout(rows: DataFrame, ident: str = "_id") -> DataFrame:
    """The Parquet layout: dictionaries of lists."""
    return rows.select(F.col(ident).alias("id"), "question", "answer", "type", F.col("context.title").alias("titles"), F.col("context.sentences").alias("sentences"), F.col("supporting_facts.title").alias("fact_titles"), F.col("supporting_facts.sent_id").alias("fact_sents"))


def pairs_layout(rows: DataFrame, ident: str = "_id") -> DataFrame:
    """The JSON layout: lists of pairs of unlike kinds, read as text and parsed as variants."""
    context, facts = F.try_parse_json("context"), F.try_parse_json("supporting_facts")
    as_list = lambda v: F.coalesce(v.cast("array<variant>"), F.array().cast("array<variant>"))
    rows = rows.withColumn("_c", as_list(context)).withColumn("_f", as_list(facts))
    get = lambda x, p, t: F.try_variant_get(x, p, t)
    return rows.select(F.col(ident).alias("id"), "question", "answer", "type", F.transform("_c", lambda x: get(x, "$[0]", "string")).alias("titles"), F.transform("_c", lambda x: get(x, "$[1]", "array<string>")).alias("sentences"), F.transform("_f", lambda x: get(x, "$[0]", "string")).alias("fact_titles"), F.transform("_f", lambda x: get(x, "$[1]", "int")).alias("fact_sents"))


def hotpot(rows: DataFrame) -> DataFrame:
    """rows in one of the layouts above. Two hops; sub-questions name the first two facts' titles."""
    ask = lambda k: F.coalesce(F.concat(F.lit("Find information about "), F.get("fact_titles", F.lit(k)), F.lit(".")), F.col("question"))
    return _titled(rows, "hotpotqa", F.lit(2), F.array(ask(0), ask(1)))


def wiki(rows: DataFrame) -> DataFrame:
    n = F.least(F.greatest(F.when(F.size("fact_titles") > 0, F.size("fact_titles")).otherwise(2), F.lit(2)), F.lit(4))
    return _titled(rows, "2wikimhqa", n, F.array_repeat("question", n))


def gsm8k(rows: DataFrame, split: str = "train") -> DataFrame:
    """rows: ord, question, answer. Numbers of the question are paragraphs, tagged with the first step that has them."""
    rows = rows.withColumn("steps", texts.steps(F.coalesce("answer", F.lit("")))).withColumn("nums", F.regexp_extract_all(F.coalesce("question", F.lit("")), F.lit(texts.NUMBER), F.lit(0)))
    hops = F.greatest(F.lit(2), F.least(F.size("steps"), F.lit(9)))
    kept = F.slice("steps", 1, 9)
    step = lambda n: F.nullif(texts.first_step_with(F.col("steps"), n), F.lit(0))
    numbers = F.transform("nums", lambda n, i: paragraph(pid(i), F.concat(F.lit("Numeric value: "), n), F.concat(F.lit("number_"), i.cast("string")), F.lit(True), step(n)))
    whole = F.array(paragraph(F.lit("para_000"), F.col("question"), F.lit("question"), F.lit(True), F.lit(None)))
    steps = F.transform(kept, lambda s, i: paragraph(pid(i + 1, "para_step_"), F.concat(F.lit("Step-"), (i + 1).cast("string"), F.lit(" rationale: "), s), F.concat(F.lit("step_"), (i + 1).cast("string")), F.lit(True), i + 1))
    shared = F.transform(kept, lambda s, i: F.struct((i + 1).cast("int").alias("hop_index"), s.alias("text"), pid(i + 1, "step_").alias("source_paragraph_id")))
    final = texts.final_answer(F.coalesce("answer", F.lit("")))
    return item(rows, original_id=F.concat(F.lit(f"gsm8k_{split}_"), F.lpad(F.col("ord").cast("string"), 6, "0")), question=F.coalesce("question", F.lit("")), answer=F.when(final != "", final).otherwise(F.trim("answer")), hop_count=hops, solution_steps=F.col("steps"), supporting_paragraphs=F.concat(F.when(F.size("nums") > 0, numbers).otherwise(whole), steps), task_shared_items=shared, dataset=F.lit("gsm8k"))


def math(rows: DataFrame, split: str = "train") -> DataFrame:
    """rows: ord, problem, solution, and any of id, type, category, subject, level, file, path."""
    have = lambda *cs: [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in cs if c in rows.columns]
    named = F.coalesce(*have("type", "category", "subject", "level"), F.lit(None).cast("string"))
    place = F.coalesce(*have("file", "path"), F.lit(None).cast("string"))
    category = F.coalesce(F.regexp_replace(F.lower(named), r"\s+", "_"), F.nullif(F.element_at(F.split(F.concat(F.lit("//"), place), "/"), -2), F.lit("")))
    rows = rows.withColumn("steps", texts.math_steps(F.coalesce("solution", F.lit(""))))
    formulas = F.regexp_extract_all(F.coalesce("problem", F.lit("")), F.lit(texts.FORMULA), F.lit(0))
    made = F.transform(formulas, lambda f, i: paragraph(pid(i), f, F.concat(F.lit("formula_"), i.cast("string")), F.lit(True), F.nullif(texts.first_step_with(F.col("steps"), f), F.lit(0))))
    shared = F.transform(F.slice("steps", 1, 9), lambda s, i: F.struct((i + 1).cast("int").alias("hop_index"), s.alias("text"), pid(i + 1, "step_").alias("source_paragraph_id")))
    ident = F.coalesce(*have("id"), F.concat(F.lit(f"math_{split}_"), F.lpad(F.col("ord").cast("string"), 6, "0")))
    return item(rows, original_id=ident, question=F.col("problem"), answer=texts.boxed_answer(F.coalesce("solution", F.lit(""))), hop_count=F.greatest(F.lit(2), F.least(F.size("steps"), F.lit(9))), solution_steps=F.col("steps"), supporting_paragraphs=made, task_shared_items=shared, dataset=F.lit("math"), math_category=category)


def by_name(name: str, split: str = "train", pairs: bool = False) -> Callable[[DataFrame], DataFrame]:
    """The normaliser of a data set; those of titled paragraphs read the layout of columns, or that of pairs."""
    from tessera.sources.readers import dataset

    layout = pairs_layout if pairs else columns_layout
    known = {"musique": musique, "hotpotqa": lambda r: hotpot(layout(r)), "2wikimhqa": lambda r: wiki(layout(r)), "gsm8k": lambda r: gsm8k(r, split), "math": lambda r: math(r, split)}
    return known[dataset(name)]
