"""The corpus pipeline: quality rules, exact dedup, near duplicates, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder
and reads it again as the next stage's documents. All stages but the last return the columns of their documents, in their
order and whatever their names; extra columns are carried.

Null and empty texts have no words, so the quality rules reject them; null ids, repeated rows and texts of any length are
treated as each operator's docstring says: of equal texts the row with the largest id stays, and the mix may repeat
a document up to three times. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, exact_dedup, mixing, ngram_join, quality
from tessera.session import owned, scratch, ship

STAGES = [
    ("quality_rules", quality.stage),
    ("exact_dedup", exact_dedup.stage),
    ("ngram_join", ngram_join.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]
#: Rolling hashes, similarity and BPE are not expressible in SQL; tests/llm holds brute-force twins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage-{k}-{name}")
        with owned(spark):  # what a stage stores on its way goes when its result is written
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
