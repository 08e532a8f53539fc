"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths give, for each text, the characters inside n-grams and lines that repeat
earlier ones. A text fails if the covered share is above the limit of any length, or of lines.

Null and empty texts have no words and fail the base rule. Texts of any length are judged whole; one text is the unit of
memory. Repeated rows are judged one by one, other columns stay, whatever their names (the struct that `with_quality` adds takes
the place of a column of its name). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _words as W
from tessera.session import free_names, give_back, small_batches

# Limits on the share of word characters inside repeated n-grams, by words, and inside repeated lines. What passes the base
# rule has a quarter of its words in later copies at most, if each is found twice; limits stand below that, and above what the rows of
# good label have on the tables of sf0.1.
LIMITS = ((5, 0.15), (7, 0.14), (10, 0.10))
LINE_LIMIT = 0.20
MIN_WORDS = 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_chars array<double>, dup_line_chars double, base_failed boolean, kept boolean"


def per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[d]:at[d + 1]]."""
    acc = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=acc[1:])
    return acc[at[1:]] - acc[at[:-1]]


def repeated(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, whether its document has it elsewhere too, and whether it has it earlier."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    own = W.mix(keys + docs.astype(W.U) * W.Q)
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    later = np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_ = later.copy()
    any_[order[:-1]] |= same
    return any_, later


def cover(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the words are in a window of n words that begins at one of starts."""
    d = np.bincount(starts, minlength=total + 1) - np.bincount(starts + n, minlength=total + 1)
    return np.cumsum(d[:-1]) > 0


def measure(b: W.Block) -> dict[str, np.ndarray]:
    n, data = len(b), b.data
    hashes, docs = b.hashes(), b.doc_of_word()
    inside = ~W.SEP[data]
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside & ((data & 0xC0) != 0x80), out=chars[1:])
    word_chars = chars[b.end] - chars[b.start]
    total = per_doc(word_chars, b.first)
    out = {"n_words": b.counts, "word_chars": total, "n_symbols": per_doc(SYMBOLS[data], b.offsets)}

    starts, keys = W.ngrams(hashes, b.first, 3)
    any_, _ = repeated(keys, docs[starts])
    out["n_repeat_words"] = per_doc(cover(starts[any_], 3, len(hashes)), b.first)

    # a line ends at a line feed or where its text does
    cut = np.zeros(len(data) + 1, bool)
    cut[np.flatnonzero(data == 10) + 1] = True
    cut[b.offsets] = True
    lo = np.flatnonzero(cut)[:-1]
    hi = np.flatnonzero(cut)[1:]
    hi = hi - (data[hi - 1] == 10) if len(hi) else hi
    has = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=has[1:])
    full = has[hi] > has[lo]
    lo, hi = lo[full], hi[full]
    line_doc = np.searchsorted(b.offsets, lo, "right") - 1
    _, later = repeated(W.span_hash(W.BYTE[data], lo, hi), line_doc)
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n)
    line_chars = np.bincount(line_doc[later], weights=(chars[hi] - chars[lo])[later], minlength=n)

    def share(x: np.ndarray) -> np.ndarray:
        return np.divide(x, total, out=np.zeros(n), where=total > 0)

    out["dup_line_chars"] = share(line_chars)
    bad = out["dup_line_chars"] > LINE_LIMIT
    shares = []
    for k, limit in LIMITS:
        starts, keys = W.ngrams(hashes, b.first, k)
        _, later = repeated(keys, docs[starts])
        got = share(per_doc(np.where(cover(starts[later], k, len(hashes)), word_chars, 0), b.first))
        shares.append(got)
        bad |= got > limit
    out["dup_chars"] = np.stack(shares, 1)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def _struct(texts: pa.Array) -> pa.Array:
    parts = [measure(b) for b in W.blocks(texts)]
    names = [f.split()[0] for f in FIELDS.split(", ")]
    cols = []
    for name in names:
        x = np.concatenate([p[name] for p in parts]) if parts else np.zeros((0, len(LIMITS)) if name == "dup_chars" else 0)
        if name == "dup_chars":
            cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(LIMITS), pa.int32()), pa.array(x.ravel(), pa.float64())))
        else:
            kind = pa.bool_() if name in ("kept", "base_failed") else pa.float64() if name == "dup_line_chars" else pa.int64()
            cols.append(pa.array(x.astype(kind.to_pandas_dtype()), kind))
    return pa.StructArray.from_arrays(cols, names)


def with_quality(docs: DataFrame, text: str = "text", column: str = "quality") -> DataFrame:
    """Adds a struct of the measures and verdicts; the text is the only column that goes to Python."""

    small_batches(docs.sparkSession)

    @F.arrow_udf(f"struct<{', '.join(f.replace(' ', ':', 1) for f in FIELDS.split(', '))}>")
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield _struct(part)
            give_back()

    return docs.withColumn(column, judge(F.col(text)))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = with_quality(docs).select("doc_id", "quality.*")
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars", *(F.col("dup_chars")[i].alias(f"dup_{k}gram_chars") for i, (k, _) in enumerate(LIMITS)))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, unchanged."""
    (name,) = free_names(docs, "quality")
    return with_quality(docs, column=name).where(F.col(f"{name}.kept")).drop(name)


def op9_sql() -> str:
    """Words, lines and n-grams as rows; a word is covered if one of the last n windows begins a repetition."""
    gram = lambda n: f"CASE WHEN k + {n - 1} <= n_words THEN array_to_string(ws[k : k + {n - 1}], ' ') END"
    later = ", ".join(f"CASE WHEN g{n} IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g{n} ORDER BY k) > 1 THEN 1 ELSE 0 END AS d{n}" for n, _ in LIMITS)
    frame = lambda n: f"OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    covered = ", ".join(f"max(d{n}) {frame(n)} AS c{n}" for n, _ in LIMITS)
    shares = ", ".join(f"coalesce(sum(CASE WHEN c{n} = 1 THEN length(word) END), 0)::DOUBLE / sum(length(word)) AS dup_{n}gram_chars" for n, _ in LIMITS)
    zeros = ", ".join(f"coalesce(dup_{n}gram_chars, 0) AS dup_{n}gram_chars" for n, _ in LIMITS)
    bad = " OR ".join(f"coalesce(dup_{n}gram_chars, 0) > {limit}" for n, limit in LIMITS)
    word = "[^\\x20\\x09-\\x0D]+"
    return f"""
    WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
    e AS (SELECT doc_id, ws, len(ws) AS n_words, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
    g AS (SELECT doc_id, k, word, {gram(3)} AS g3, {", ".join(f"{gram(n)} AS g{n}" for n, _ in LIMITS)} FROM e),
    d AS (SELECT *, CASE WHEN g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1 THEN 1 ELSE 0 END AS r3, {later} FROM g),
    c AS (SELECT doc_id, word, max(r3) {frame(3)} AS again, {covered} FROM d),
    s AS (SELECT doc_id, sum(length(word))::BIGINT AS word_chars, sum(again)::BIGINT AS n_repeat_words, {shares} FROM c GROUP BY 1),
    l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS k FROM w),
    m AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS late FROM l WHERE regexp_matches(line, '{word}')),
    n AS (SELECT doc_id, count(*) FILTER (late) AS n_dup_lines, coalesce(sum(length(array_to_string(regexp_extract_all(line, '{word}'), ''))) FILTER (late), 0) AS chars FROM m GROUP BY 1),
    j AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        coalesce(chars::DOUBLE / word_chars, 0) AS dup_line_chars, {zeros}, {bad} OR coalesce(chars::DOUBLE / word_chars, 0) > {LINE_LIMIT} AS bad FROM w LEFT JOIN s USING (doc_id) LEFT JOIN n USING (doc_id)),
    b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
    SELECT * EXCLUDE (bad), NOT base_failed AND NOT bad AS kept FROM b"""
