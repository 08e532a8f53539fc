"""Quality of answers and of what was retrieved for them: exact match, F1, evidence hit, answer support.

Texts are compared by their words: lower-case, without ASCII punctuation, without articles. Null texts have no words; two texts without
words match, and one without words matches nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint

# What is no word.
ARTICLES = ("a", "an", "the")
PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: Documents whose ids are broadcast at most to pick their texts.
FEW = 100_000


def bag(text: Column) -> Column:
    """The words of a text, in order, repeats included."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(plain, r"[ \t\n\x0B\f\r]+"), lambda w: (w != "") & ~w.isin(*ARTICLES))


def matches(answers: DataFrame) -> DataFrame:
    """answers: id (one row each), predicted, gold -> id, em, f1. The overlap is that of bags: a word counts as often as both have it.
    Words are counted on the map side, so a long text costs its distinct words. A plain explode would have Spark cut every text into words
    below the joins that `answers` is made of, to see if there are any."""
    both = answers.select("id", bag(F.col("predicted")).alias("p"), bag(F.col("gold")).alias("g"))
    words = both.select("id", F.explode_outer("p").alias("w"), F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(both.select("id", F.explode_outer("g").alias("w"), F.lit(0).alias("p"), F.lit(1).alias("g"))).where("w IS NOT NULL")
    shared = words.groupBy("id", "w").agg(F.sum("p").alias("p"), F.sum("g").alias("g")).groupBy("id").agg(F.sum(F.least("p", "g")).alias("both"))
    n, m, common = F.size("p"), F.size("g"), F.coalesce("both", F.lit(0))
    em = F.col("p") == F.col("g")
    f1 = F.when((n == 0) | (m == 0), em.cast("double")).otherwise(2.0 * common / (n + m))
    return both.join(shared, "id", "left").select("id", em.alias("em"), F.round(f1, 6).alias("f1"))


def evidence_hits(requests: DataFrame, results: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """requests: id; results: id, doc, rank; gold: id, doc -> id, hit: whether one of the first k results is evidence. Requests
    without evidence have null."""
    found = results.where(F.col("rank") <= k).join(gold.select("id", "doc").distinct(), ["id", "doc"], "left_semi").select("id").distinct().withColumn("hit", F.lit(True))
    asked = gold.select("id").distinct().withColumn("some", F.lit(True))
    return requests.select("id").join(asked, "id", "left").join(found, "id", "left").select("id", F.when(F.col("some"), F.coalesce("hit", F.lit(False))).alias("hit"))


def retrieved(results: DataFrame, texts: DataFrame, at_most: int = FEW) -> DataFrame:
    """results: doc; texts: doc, text -> the texts of documents that are among the results, as a table of their own. All others go in the
    scan where the results have few documents, and by a shuffle of their ids and texts where they have many."""
    met = checkpoint(results.select("doc").distinct())
    return checkpoint(texts.select("doc", "text").join(F.broadcast(met) if met.count() <= at_most else met, "doc", "left_semi"))


def supported(answers: DataFrame, results: DataFrame, texts: DataFrame, k: int = 10) -> DataFrame:
    """answers: id, gold; results: id, doc, rank; texts: doc, text -> id, supported: whether the answer's words stand in a row in one of
    the first k texts. An answer is looked for in what was retrieved for it only; answers without words are not supported."""
    line = lambda c: F.concat(F.lit(" "), F.array_join(bag(c), " "), F.lit(" "))
    asked = answers.select("id", line(F.col("gold")).alias("answer"))
    met = results.where(F.col("rank") <= k).select("id", "doc").join(asked, "id").join(texts.select("doc", "text"), "doc")
    told = met.groupBy("id").agg(F.bool_or(F.contains(line(F.col("text")), F.col("answer"))).alias("told"))
    return asked.join(told, "id", "left").select("id", (F.coalesce("told", F.lit(False)) & (F.col("answer") != "  ")).alias("supported"))


def rates(*parts: DataFrame) -> DataFrame:
    """One row: the mean of every measure of tables by id; nulls don't count."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.join(p, "id")
    return rows.agg(F.count(F.lit(1)).alias("requests"), *(F.avg(F.col(c).cast("double")).alias(c) for c in rows.columns if c != "id"))
