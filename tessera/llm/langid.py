"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are n-grams of 1 to 3 characters of the lower-cased text, hashed to DIM slots; runs of characters that are no
letters count as one space. A feature's value is its relative frequency times its inverse document frequency, which is counted
over all training rows by Spark. Weights are trained by follow-the-regularised-leader with elastic-net penalties on a
bounded sample, FIT texts of each language, the first in order of a hash of id and text; CALIBRATE more of each set the
temperature. Executors turn the sample into counts, DIM of a row at most, so that no text goes to the driver. Prediction reads
whole texts.

Text that is null or has no letter is `und` with score 0, as is every text if no row can be learned from. Rows without
doc_id are not held out and not learned from. Ties go to the language that sorts first. Repeated rows are judged one by
one and learned from once; a doc_id with several texts or languages counts with each. Only text, lang and doc_id are
read; `identify` wants the names of its two results to be free. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpoint, free_names, small_batches

DIM = 1 << 15
ORDERS = (1, 2, 3)
#: Rows of a language that weights are fitted on, and that the temperature is fitted on, at most.
FIT, CALIBRATE = 1500, 300
#: Times the sample that a hash picks of each language, by its count, before rows are ranked; rows that are broadcast at most.
OVER, BROADCAST_ROWS = 3, 100_000
EPOCHS, BATCH = 3, 16
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
RUN = re.compile(r"[^\W\d_]+")


def features(text: str) -> np.ndarray:
    """The slot of each n-gram of a text, with repeats; none if it has no letter."""
    found = RUN.findall(text)
    if not any(c.isalpha() for w in found for c in w):
        return np.zeros(0, np.uint32)
    c = np.frombuffer(f" {' '.join(found).lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(c) - n + 1] * np.uint32(0x01000193)) ^ (c[n - 1 :] * np.uint32(0x9E3779B1))
        if n in ORDERS:
            x = h + np.uint32(n)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append((x >> np.uint32(7)) & np.uint32(DIM - 1))
    return np.concatenate(out)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def document_frequency(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each slot occurs, over all rows. The result has DIM entries, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, seen = np.zeros(DIM, np.int64), 0, np.zeros(DIM, bool)
        for b in batches:
            for t in b.column(0).to_pylist():
                seen[:] = False
                seen[features(t or "")] = True
                df += seen
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], ["slot", "n"])

    rows = docs.select(text).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    df, total = np.zeros(DIM), 0
    for r in rows.collect():
        if r["slot"] < 0:
            total = r["n"]
        else:
            df[r["slot"]] = r["n"]
    return df, total


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (counts * self.idf[slots]) @ self.weights[slots] / counts.sum() * SCALE

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        table = (self.idf[:, None] * self.weights * SCALE).astype(np.float32)
        langs, scores = [], []
        for t in texts:
            x = features(t or "")
            if not len(x) or not self.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            p = softmax((np.bincount(x, minlength=DIM).astype(np.float32) @ table).astype(float)[None] / len(x) / self.temperature)[0]
            langs.append(self.langs[int(p.argmax())])
            scores.append(float(p.max()))
        return langs, scores


#: Values are relative frequencies; this brings them to the order of 1.
SCALE = 30.0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


Counts = tuple[np.ndarray, np.ndarray]


def counted(text: str) -> Counts:
    """The distinct slots of a text and how often it has each."""
    return np.unique(features(text), return_counts=True)


def train(rows: list[Counts], langs: list[str], idf: np.ndarray) -> Model:
    """Follow the regularised leader, proximal form, a learning rate for each coordinate. Rows have at least one slot."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    sparse = [(x, n * idf[x] / n.sum() * SCALE) for x, n in rows]
    z, s = np.zeros((DIM, len(names))), np.zeros((DIM, len(names)))
    weights = np.zeros((DIM, len(names)))
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            slots = np.unique(np.concatenate([sparse[k][0] for k in part]))
            w = weights[slots]
            grad = np.zeros_like(w)
            for k in part:
                at = np.searchsorted(slots, sparse[k][0])
                p = softmax((sparse[k][1] @ w[at])[None])[0]
                p[y[k]] -= 1
                grad[at] += sparse[k][1][:, None] * p
            grad /= len(part)
            sigma = (np.sqrt(s[slots] + grad**2) - np.sqrt(s[slots])) / ALPHA
            z[slots] += grad - sigma * w
            s[slots] += grad**2
            zs = z[slots]
            weights[slots] = np.where(np.abs(zs) <= L1, 0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(s[slots])) / ALPHA + L2))
    return Model(names, idf, weights)


def calibrate(model: Model, rows: list[Counts], langs: list[str]) -> Model:
    """The temperature of least log loss on rows that the weights haven't seen."""
    known = [(model.logits(*r), model.langs.index(x)) for r, x in zip(rows, langs, strict=True) if x in model.langs]
    if known:
        z, y = np.array([a for a, _ in known]), np.array([b for _, b in known])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def sample(known: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, lang -> lang, r, slots, counts of the first `rows` distinct rows of each language, in order of their hashes.
    A hash keeps about OVER times as many of each language before they are ranked, so that no task ranks a whole one."""
    keys = known.where(F.length("text") > 0).select("lang", "doc_id", F.xxhash64("text").alias("t")).distinct()
    size = keys.groupBy(F.col("lang").alias("l")).agg(F.count(F.lit(1)).alias("k"))
    h = F.xxhash64("doc_id", "t")
    some = keys.join(size, F.col("lang") == F.col("l")).where(F.pmod(h, F.lit(1 << 40)) * F.col("k") < OVER * rows * float(1 << 40))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(h, F.lit(1 << 40)), h, "doc_id", "t"))
    chosen = checkpoint(some.select("lang", "doc_id", "t", rank.alias("r")).where(F.col("r") <= rows))
    chosen = chosen.toDF("cl", "ci", "ct", "r")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    found = known.join(chosen, (F.col("lang") == F.col("cl")) & (F.col("doc_id") == F.col("ci")) & (F.xxhash64("text") == F.col("ct")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [counted(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.astype("<u4").tobytes() for x, _ in got], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in got], pa.binary())], ["lang", "r", "slots", "counts"])

    return found.select("lang", "r", "text").mapInArrow(run, "lang string, r int, slots binary, counts binary").dropDuplicates(["lang", "r"]).where("length(slots) > 0")


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT, calibrate_rows: int = CALIBRATE) -> Model:
    """docs are the rows that may be learned from."""
    known = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    df, n = document_frequency(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = sorted(sample(known, fit_rows + calibrate_rows).collect(), key=lambda r: (r["r"], r["lang"]))
    counts = lambda part: [(np.frombuffer(r["slots"], "<u4").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(np.int64)) for r in part]
    first, rest = [r for r in rows if r["r"] <= fit_rows], [r for r in rows if r["r"] > fit_rows]
    if not first:
        return Model([], idf, np.zeros((DIM, 0)))
    model = train(counts(first), [r["lang"] for r in first], idf)
    return calibrate(model, counts(rest), [r["lang"] for r in rest])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score."""
    (both,) = free_names(docs, "both")
    small_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            langs, scores = model.predict(part.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn(both, run(F.col(text))).select(*(F.col(f"`{c}`") for c in docs.columns), f"{both}.*")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
