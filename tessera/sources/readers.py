"""Reading and writing: JSON, JSON lines and Parquet by extension, splits, shards, restricted records, frozen ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources import json_list

# Dataset names, with the second spelling of one of them.
DATASETS = ("gsm8k", "hotpotqa", "math", "musique", "2wikimhqa")
ALIASES = {"2wikimultihopqa": "2wikimhqa"}
RESTRICTED = "original_id string, entries array<struct<content:string,confidence:double,source:string,metadata:map<string,string>>>"


def dataset(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}")
    return name


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that are one list of rows, one row, or an object with the rows under `data`; a large file is read by many tasks."""
    return json_list.read(spark, path, schema)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A row a line; blank lines and broken ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_any(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "jsonl":
        return read_jsonl(spark, path, schema)
    if kind == "json":
        return read_json(spark, path, schema)
    raise ValueError(f"cannot read {path!r}: expected .jsonl, .json or .parquet")


def split_file(split: str, train: str | None = None, dev: str | None = None, test: str | None = None, default_test: str | None = None) -> str:
    """train and dev have their own files; test falls back to its default and then to dev, which makes both leak."""
    found = {"train": train, "dev": dev, "test": test or default_test or dev}.get(split)
    if not found:
        raise ValueError(f"no file for split {split!r}")
    return found


def restricted(spark: SparkSession, path: str) -> DataFrame:
    """original_id and its records, one row each; ids that repeat are pooled; a missing file has none."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], RESTRICTED).select("original_id", F.explode("entries").alias("e")).select("original_id", "e.*")
    rows = read_jsonl(spark, path, RESTRICTED).where("coalesce(original_id, '') <> ''")
    return rows.select("original_id", F.inline("entries"))


def restricted_entries(items: DataFrame, kind: str) -> DataFrame:
    """Generates restricted records: credibility of paragraphs and gold sentences for QA, a check of each step for math.
    Items without entries have no row."""
    if kind == "math":
        rows = items.select("original_id", F.posexplode("solution_steps").alias("k", "step")).withColumn("k", F.col("k") + 1)
        e = rows.select("original_id", F.concat(F.lit("step_"), F.col("k").cast("string")).alias("source"), F.lit(1.0).alias("confidence"), F.lit(0).alias("part"), "k")
        e = e.withColumn("content", F.concat("source", F.lit(" numerical check: pass, value=<oracle>"))).withColumn("kind", F.lit("numerical_check"))
    else:
        para = lambda c, part, conf, word, k: items.select("original_id", F.posexplode(c).alias("k", "p")).select("original_id", F.col("p.paragraph_id").alias("source"), F.lit(conf).alias("confidence"), F.lit(part).alias("part"), "k", F.concat(F.col("p.paragraph_id"), F.lit(f" credibility: {conf} ({word})")).alias("content"), F.lit(k).alias("kind"))
        facts = items.select("original_id", F.posexplode("supporting_facts").alias("k", "f")).select("original_id", F.concat_ws(":", "f.paragraph_id", F.col("f.sentence_idx").cast("string")).alias("source"), F.lit(1.0).alias("confidence"), F.lit(2).alias("part"), "k", F.concat(F.col("f.paragraph_id"), F.lit(" sentence "), F.col("f.sentence_idx").cast("string"), F.lit(": credibility=1.0")).alias("content"), F.lit("gold_sentence").alias("kind"))
        e = para("supporting_paragraphs", 0, 1.0, "gold evidence", "gold_fact").unionByName(para("distractor_paragraphs", 1, 0.0, "distractor", "distractor")).unionByName(facts)
    entry = F.struct("part", "k", "content", "confidence", "source", "kind")
    return e.groupBy("original_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def shards(episodes: DataFrame) -> DataFrame:
    """The shard of each episode: s4 for policy-isolated ones, which only the test split may have, else its label; and its graph type."""
    ok = ~F.col("s4") | (F.col("split") == "test")
    return episodes.where(ok).withColumn("shard", F.concat_ws("_", F.when(F.col("s4"), "s4").otherwise(F.lower("label")), F.lower("graph_type")))


def misplaced(episodes: DataFrame) -> DataFrame:
    """Episodes that no shard takes: policy-isolated ones outside the test split."""
    return episodes.where(F.col("s4") & (F.col("split") != "test"))


def write_report(report: DataFrame, path: str) -> None:
    """A report as one JSON file: it has a row for each value that it tells of."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_episodes(episodes: DataFrame, path: str, append: bool = False, compression: str | None = None) -> None:
    """JSON lines by dataset, split and shard, plain or by a codec of Spark's text files (gzip), which Spark tells by the files' names."""
    shards(episodes).write.mode("append" if append else "overwrite").partitionBy("dataset", "split", "shard").json(path, compression=compression)


def freeze_ids(ids: DataFrame, path: str, column: str = "original_id") -> None:
    ids.select(F.col(column).cast("string")).distinct().orderBy(column).write.mode("overwrite").text(path)


def frozen_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("original_id"))
