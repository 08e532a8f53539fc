"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

Spark cuts each text into words by the tokenizer's pattern, in the JVM. In Python, the distinct words of a batch that
are no token as a whole become token-position rows, one a byte. A recursive query joins neighbouring rows with the
merge table - every split of every token into two tokens - and contracts each word's leftmost pair of least rank, until no word
has a pair left. Decoding joins id rows with the vocabulary and aggregates the pieces in order of position.

Null text counts as empty: no ids, empty bytes. Texts of any length are encoded whole; the longest word, not the longest text,
bounds the recursion. Repeated rows are encoded one by one, other columns are not read, an empty table gives an empty result.
"""

from __future__ import annotations

import atexit
import base64
import hashlib
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _words as W
from tessera.session import give_back, small_batches

RANKS = "byte_bpe_50k.tiktoken"
#: public_tokenizers.PATTERN in Java's notation: `\s` is any Unicode white space.
SPACE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Words that a worker remembers at most, and bytes of these and their ids, with ENTRY bytes of offsets for each; longest short word;
#: words and bytes of a recursive query, and ids that one query decodes.
KNOWN, MEMO, ENTRY, SHORT, WORDS, BYTES, IDS = 1 << 18, 16 << 20, 16, 48, 20_000, 1 << 19, 200_000

#: One pair a word and round; every round's rows are kept, which short words can afford.
SHORT_WORDS = """
WITH RECURSIVE step(i, key, id, nxt) AS (
    SELECT 0, key, id, key + 1 FROM symbols
    UNION ALL
    SELECT i + 1, key, CASE WHEN key = best THEN least_rank ELSE id END, CASE WHEN key = best THEN after ELSE nxt END
    FROM (
        WITH pair AS (
            SELECT a.i, a.key, a.id, a.nxt, b.nxt AS after, m.rank
            FROM step a LEFT JOIN step b ON a.nxt = b.key LEFT JOIN merges m ON m.pair = (a.id::BIGINT << 20) + b.id
        ), least AS (
            SELECT key >> 32 AS word, min(rank) AS least_rank, arg_min(key, (rank::HUGEINT << 64) + key) AS best, arg_min(nxt, (rank::HUGEINT << 64) + key) AS gone
            FROM pair WHERE rank IS NOT NULL GROUP BY 1
        )
        SELECT * FROM pair JOIN least ON key >> 32 = word
    ) WHERE key <> gone
)
SELECT step.key >> 32 AS word, list(step.id ORDER BY step.key) AS ids
FROM step JOIN (SELECT key >> 32 AS word, max(i) AS i FROM step GROUP BY 1) last ON last.word = step.key >> 32 AND last.i = step.i
GROUP BY 1
"""
#: All pairs of a rank in one round, and one row a byte throughout.
LONG_WORDS = """
WITH RECURSIVE step(key, id, nxt) USING KEY (key) AS (
    SELECT key, id, key + 1 FROM symbols
    UNION ALL
    (
        WITH live AS (
            SELECT s.key, s.id, s.nxt FROM recurring.step s SEMI JOIN (SELECT DISTINCT key >> 32 AS word FROM step) changed ON s.key >> 32 = changed.word WHERE s.id >= 0
        ), pair AS (
            SELECT a.key >> 32 AS word, a.key, a.nxt, b.nxt AS after, m.rank, m.early, m.twice
            FROM live a JOIN live b ON a.nxt = b.key JOIN merges m ON m.pair = (a.id::BIGINT << 20) + b.id
        ), hit AS (
            SELECT *, row_number() OVER w AS nth, lag(nxt) OVER w IS DISTINCT FROM key AS head
            FROM pair JOIN (SELECT word, min(rank) AS rank FROM pair GROUP BY word) least USING (word, rank) WINDOW w AS (PARTITION BY word ORDER BY key)
        ), run AS (
            SELECT *, nth - max(CASE WHEN head THEN nth END) OVER (PARTITION BY word ORDER BY key) AS inside FROM hit
        ), even AS (
            SELECT * FROM run WHERE inside % 2 = 0
        ), lower AS (
            SELECT e.word, e.nth FROM even e JOIN live l ON l.nxt = e.key JOIN merges m ON m.pair = (l.id::BIGINT << 20) + e.rank WHERE e.early AND m.rank < e.rank
            UNION ALL
            SELECT e.word, e.nth FROM even e JOIN live l ON l.key = e.after JOIN merges m ON m.pair = (e.rank::BIGINT << 20) + l.id WHERE e.early AND m.rank < e.rank
        ), chosen AS (
            SELECT even.* FROM even LEFT JOIN (SELECT word, min(nth) AS stop FROM lower GROUP BY word) USING (word) WHERE nth <= CASE WHEN twice THEN 1 ELSE coalesce(stop, nth) END
        )
        SELECT key, rank, after FROM chosen UNION ALL SELECT nxt, -1, 0 FROM chosen
    )
)
SELECT key >> 32 AS word, list(id ORDER BY key) AS ids FROM step WHERE id >= 0 GROUP BY 1
"""
DECODE = "SELECT doc, string_agg(piece, '' ORDER BY pos) AS bytes FROM ids JOIN vocabulary USING (id) GROUP BY doc"


def java_pattern(pattern: str = public_tokenizers.PATTERN) -> str:
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s+", f"[{SPACE}]+")


def words(text: Column) -> Column:
    """The matches of the tokenizer's pattern."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern()), F.lit(0))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (n of them), for each pair one behind the other."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


class Codec:
    """One DuckDB connection with merge table and vocabulary, and two Arrow arrays of the words met last and their ids, as Python
    objects would take several times their memory."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        folder = tempfile.mkdtemp(prefix="bpe-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": folder})
        rows = [(a, b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        early = {x for a, b, r in rows for x in (a, b) if r < x}  # tokens that are part of one of lower rank
        twice = {a for a, b, r in rows if a == b and r < a}
        merges = pa.table({"pair": pa.array([a << 20 | b for a, b, _ in rows], pa.int64()), "rank": pa.array([r for *_, r in rows], pa.int32()), "early": pa.array([r in early for *_, r in rows]), "twice": pa.array([r in twice for *_, r in rows])})
        # a piece as text: each byte is the character of that number
        vocabulary = pa.table({"id": pa.array(ranks.values(), pa.int32()), "piece": pa.array([t.decode("latin-1") for t in ranks], pa.string())})
        for name, t in (("merges", merges), ("vocabulary", vocabulary)):
            self.con.register("t", t)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM t")
            self.con.unregister("t")
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.tokens, self.token_ids = pa.array(list(ranks), pa.large_binary()), np.array(list(ranks.values()), np.int32)
        self.known, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_list(pa.int32()))

    def look_up(self, names: pa.Array) -> pa.Array:
        """The ids of each of some distinct words. What was met longest ago is forgotten first."""
        at = pc.index_in(names, value_set=self.known)
        new = names.filter(pc.is_null(at))
        at = at.to_numpy(zero_copy_only=False)
        missing = np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), bool)
        where = np.where(missing, len(self.known) + np.cumsum(missing) - 1, at).astype(np.int64)
        ids = pa.concat_arrays([self.ids, self._contract(new)]).take(pa.array(where))
        others = np.ones(len(self.known), bool)
        others[where[~missing]] = False
        words, lists = pa.concat_arrays([names, self.known.filter(others)]), pa.concat_arrays([ids, self.ids.filter(others)])
        held = np.cumsum(pc.binary_length(words).to_numpy() + 4 * pc.list_value_length(lists).to_numpy() + ENTRY)
        most = min(KNOWN, int(np.searchsorted(held, MEMO, "right")))
        first = pa.array(np.arange(most))  # a copy, as a slice keeps all
        self.known, self.ids = words.take(first), lists.take(first)
        return ids

    def _contract(self, words: pa.Array) -> pa.Array:
        """The ids of each word: its own if it is a token, else what is left of its bytes."""
        data, offs = W.raw(words)
        size, at = np.diff(offs), pc.fill_null(pc.index_in(words.cast(pa.large_binary()), value_set=self.tokens), -1).to_numpy()
        whole, whole_ids = np.flatnonzero(at >= 0), self.token_ids[at[at >= 0]]
        found = [(whole, np.ones(len(whole), np.int64), whole_ids)]
        for rows, query in ((np.flatnonzero((at < 0) & (size <= SHORT)), SHORT_WORDS), (np.flatnonzero((at < 0) & (size > SHORT)), LONG_WORDS)):
            ends, lo = np.cumsum(size[rows]), 0
            while lo < len(rows):
                hi = max(lo + 1, min(lo + WORDS, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BYTES, "right"))))
                part = rows[lo:hi]
                lo = hi
                n = size[part]
                symbols = self.byte[data[spans(offs[part], n)]]
                key = (np.repeat(np.arange(len(part)), n) << 32) + spans(np.zeros(len(part), np.int64), n)
                self.con.register("symbols", pa.table({"key": pa.array(key), "id": pa.array(symbols)}))
                got = self.con.sql(query).to_arrow_table()
                lists = got["ids"].combine_chunks()
                found.append((part[got["word"].to_numpy()], pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten().to_numpy()))
                self.con.unregister("symbols")
        n = np.zeros(len(words) + 1, np.int64)
        for rows, count, _ in found:
            n[rows + 1] = count
        begin = np.cumsum(n)
        flat = np.empty(begin[-1], np.int32)
        for rows, count, ids in found:
            flat[spans(begin[rows], count)] = ids
        return pa.LargeListArray.from_arrays(pa.array(begin), pa.array(flat))

    def encode(self, lists: pa.ListArray) -> list[bytes]:
        """The ids of each list of words, as little-endian 32-bit integers."""
        flat = lists.flatten()
        flat = flat.cast(pa.large_string()) if not pa.types.is_large_string(flat.type) else flat
        coded = flat.dictionary_encode()
        ids = self.look_up(coded.dictionary).take(coded.indices)
        ends = np.cumsum(np.append(0, pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))
        at = (4 * np.cumsum(np.append(0, pc.list_value_length(ids).to_numpy()))[ends]).tolist()
        raw = ids.flatten().to_numpy().astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def decode(self, docs: list[bytes]) -> list[bytes]:
        """The bytes of each document's ids."""
        out, lo = [b""] * len(docs), 0
        while lo < len(docs):
            hi, n = lo, 0
            while hi < len(docs) and (hi == lo or n + len(docs[hi]) // 4 <= IDS):
                n += len(docs[hi]) // 4
                hi += 1
            ids = np.frombuffer(b"".join(docs[lo:hi]), "<u4").astype(np.int32)
            doc = np.repeat(np.arange(lo, hi, dtype=np.int32), [len(x) // 4 for x in docs[lo:hi]])
            self.con.register("ids", pa.table({"doc": doc, "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
            for k, text in self.con.execute(DECODE).fetchall():
                out[k] = text.encode("latin-1")
            self.con.unregister("ids")
            lo = hi
        return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """A worker keeps its codec from task to task."""
    if path not in _codecs:
        _codecs[path] = Codec(load_ranks(path))
    return _codecs[path]


def _slices(lists: pa.ListArray, most: int = 250_000) -> Iterator[pa.ListArray]:
    """Runs of documents of about so many words."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    lo = 0
    while lo < len(lists):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + most, "right")))
        yield lists.slice(lo, hi - lo)
        lo = hi


def encode(docs: DataFrame, text: str = "text", column: str = "ids", ranks: str | None = None) -> DataFrame:
    """Adds the ids of each text as an array."""
    path = ranks or public_tokenizers.path(RANKS)
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for part in parts:
            got = [x for s in _slices(part) for x in c.encode(s)]
            give_back()
            offs = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(got), "<u4").astype(np.int32)))

    return docs.withColumn(column, run(words(F.col(text))))


def decode(docs: DataFrame, ids: str = "ids", column: str = "decoded", ranks: str | None = None) -> DataFrame:
    """Adds the bytes that the ids stand for. They are valid UTF-8 if the ids are those of a text."""
    path = ranks or public_tokenizers.path(RANKS)
    small_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for part in parts:
            give_back()
            yield pa.array(c.decode([np.asarray(x or [], "<u4").tobytes() for x in part.to_pylist()]), pa.binary())

    return docs.withColumn(column, run(F.col(ids)))


def round_trip(docs: DataFrame, text: str = "text", column: str = "bpe", ranks: str | None = None) -> DataFrame:
    """Encodes and decodes in one pass; adds a struct of n_tokens, ids_sha256 and decoded_sha256."""
    path = ranks or public_tokenizers.path(RANKS)
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for part in parts:
            n, ids, back = [], [], []
            for s in _slices(part):
                got = c.encode(s)
                give_back()
                n += [len(x) // 4 for x in got]
                ids += map(sha, got)
                back += map(sha, c.decode(got))
                give_back()
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn(column, run(words(F.col(text))))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs).select("doc_id", "bpe.*")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, as op2."""
    return round_trip(docs.select("doc_id", "text")).select("doc_id", "bpe.*")
