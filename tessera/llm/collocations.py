"""Phrase collocations from a weighted de Bruijn graph of the longest n-grams.

Graphs. A run of texts becomes a graph: its nodes are the (n - 1)-grams that lie within pieces, its edges the n-grams,
each from its first n - 1 words to its last, weighted by its occurrences. A node with one edge in and one out, where no
piece begins or ends, hands its weight on, so the edges along such unary paths have one weight. The graph is stored as
walks: the words of stretches of text whose edges have not been met before in the run, paths with their lengths and weights, and the last
n - 1 words of pieces with the numbers of pieces that end so. Copies within a run cost nothing but a weight.

Shorter counts. What flows out of a node, and the pieces that end there, is the count of its (n - 1)-gram; inner nodes of a path have
the weight of the path. Of the counts of m-grams follow those of (m - 1)-grams in the same way: all that begin with it, and the pieces
that end with it.

Sums over runs. Runs send the hashes and counts of their n-grams, of all lengths, to ranges of hashes; a range adds them, and
tells one run of each n-gram that is frequent enough, which looks up its words. The parts of a frequent phrase are frequent, so
the table of named n-grams has all that the scores need. A hot word, pair, language or text is one number a run.

Phrases. Each cut of a candidate into two parts scores floor(1000000 a a / (l r)), in decimals; its lowest cut counts. A candidate
goes if a longer one around it has at least half of its count. The first of each language are ranked.

Null text counts as empty and has no pieces; null lang is `und`, one language with rows that say so. Empty pieces have no words. Texts
of any length are read whole; one text is the unit of memory. Repeated rows count again, ties go by count, then by the phrase's bytes,
other columns are not read, and an empty table gives an empty result. N-grams are told apart by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _ranges as R
from tessera.llm import _words as W
from tessera.session import checkpoint, discard

SHORTEST, LONGEST, LEAST, SHARE, TOP = 2, 3, 10, 50, 2000
UNKNOWN = "und"
#: Words of a run.
RUN = 1 << 20
#: Parts of a language that are ranked by themselves first.
PARTS_OF_LANG = 8
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(10, 14)]] = True
BETWEEN = ENDS.copy()
BETWEEN[[9, 32]] = True

GRAPH = "run long, langs array<string>, spoken array<long>, vocabulary binary, sizes binary, words binary, walks binary, walk_lang binary, paths binary, weights binary, tails binary, tail_lang binary, ending binary"


def gram_keys(words: np.ndarray, langs: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the m-grams at places; the language is part of them."""
    return W.mix(W.span_hash(words, at, at + m, W.Q, W.Q_INV) + langs[at])


def summed(keys: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the first place given of each, and the sums of n."""
    if not len(keys):
        return keys, at, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], at[order[first]], np.add.reduceat(n[order], first)


def lang_keys(langs: list[str]) -> np.ndarray:
    data, offs = W.raw(pa.array(langs, pa.string()))
    return W.mix(W.span_hash(W.BYTE[data], offs[:-1], offs[1:]) * W.P)


class Run:
    """Words of some texts, in order: hash, language, whether a piece ends with it; and their bytes."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, b: W.Block, langs: list[str | None]) -> None:
        number = np.array([self.langs.setdefault(UNKNOWN if x is None else x, len(self.langs)) for x in langs], np.int32)
        breaks = np.append(0, np.cumsum(ENDS[b.data]))
        last = np.ones(len(b.start), bool)
        last[:-1] = breaks[b.start[1:]] > breaks[b.end[:-1]]
        last[b.first[1:][b.counts > 0] - 1] = True
        self.parts.append((b.hashes(), np.repeat(number, b.counts), last, b.data, b.start, b.end))
        self.size += len(b.start)

    def graph(self, number: int, longest: int) -> tuple:
        """The row of GRAPH."""
        hashes, lang, last = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        base = np.cumsum([0, *(len(p[3]) for p in self.parts[:-1])])
        data = np.concatenate([p[3] for p in self.parts])
        start, end = (np.concatenate([p[k] + x for p, x in zip(self.parts, base.tolist(), strict=True)]) for k in (4, 5))
        total = len(hashes)
        langs = list(self.langs)
        own = lang_keys(langs)[lang]
        stop = np.flatnonzero(last)
        begin = np.append(0, stop[:-1] + 1)
        size = stop - begin + 1
        left = np.repeat(stop, size) - np.arange(total) + 1  # words from here to the end of the piece

        at = np.flatnonzero(left >= longest)
        _, first, weight = summed(gram_keys(hashes, own, at, longest), at, np.ones(len(at), np.int64))
        order = np.argsort(first)
        first, weight = first[order], weight[order]
        nodes = np.concatenate([gram_keys(hashes, own, first, longest - 1), gram_keys(hashes, own, first + 1, longest - 1)])
        names, node = np.unique(nodes, return_inverse=True)
        tail, head = node[: len(first)], node[len(first) :]
        plain = (np.bincount(tail, minlength=len(names)) == 1) & (np.bincount(head, minlength=len(names)) == 1)
        whole = size >= longest - 1
        for places in (begin[whole], stop[whole] - longest + 2):
            k = gram_keys(hashes, own, places, longest - 1)
            found = np.minimum(np.searchsorted(names, k), max(len(names) - 1, 0))
            if len(names):
                plain[found[names[found] == k]] = False
        joined = np.append(False, first[1:] == first[:-1] + 1) if len(first) else np.zeros(0, bool)
        on = joined.copy()
        on[1:] &= plain[head[:-1]]
        walk = np.flatnonzero(~joined)
        path = np.flatnonzero(~on)
        walks = np.diff(np.append(walk, len(first)))
        # ends of pieces
        short = np.minimum(size, longest - 1)
        from_ = stop - short + 1
        groups = [summed(gram_keys(hashes, own, from_[k], m), from_[k], np.ones(len(k), np.int64)) + (m,) for m in range(1, longest) if len(k := np.flatnonzero(short == m))]
        tails = np.concatenate([np.zeros(0, np.int64), *(np.full(len(g[1]), g[3]) for g in groups)])
        ended = np.concatenate([np.zeros(0, np.int64), *(g[1] for g in groups)])
        ending = np.concatenate([np.zeros(0, np.int64), *(g[2] for g in groups)])

        lengths = np.concatenate([walks + longest - 1, tails])
        places = np.concatenate([first[walk], ended])
        used = spread(places, lengths)
        words, one, index = np.unique(hashes[used], return_index=True, return_inverse=True)
        one = used[one]
        wide = end[one] - start[one]
        vocabulary = data[spread(start[one], wide)]
        spoken = np.bincount(lang, minlength=len(langs))
        return (number, langs, spoken.tolist(), vocabulary.tobytes(), R.pack(wide), R.pack(index), R.pack(walks), R.pack(lang[first[walk]]), R.pack(np.diff(np.append(path, len(first)))), R.pack(weight[path]), R.pack(tails), R.pack(lang[ended]), R.pack(ending))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Graph:
    """A stored graph: its words, with walks first and ends of pieces behind them, and the places of its edges."""

    def __init__(self, row: tuple, longest: int):
        langs, vocabulary, sizes, words, walks, walk_lang, paths, weights, tails, tail_lang, ending = row
        self.langs, self.longest = langs, longest
        self.vocabulary, wide = np.frombuffer(vocabulary, np.uint8), R.unpack(sizes).astype(np.int64)
        self.offsets = np.append(0, np.cumsum(wide))
        self.index = R.unpack(words).astype(np.int64)
        walks, self.tails = R.unpack(walks).astype(np.int64), R.unpack(tails).astype(np.int64)
        self.ending = R.unpack(ending).astype(np.int64)
        lengths = np.concatenate([walks + longest - 1, self.tails])
        self.lang = np.repeat(np.concatenate([R.unpack(walk_lang), R.unpack(tail_lang)]).astype(np.int64), lengths)
        starts = np.cumsum(lengths) - lengths
        self.edges = spread(starts[: len(walks)], walks)
        self.stop = (starts + lengths)[len(walks) :]
        self.left = np.repeat(starts + lengths, lengths) - np.arange(len(self.lang))
        paths = R.unpack(paths).astype(np.int64)
        self.weight = np.repeat(R.unpack(weights).astype(np.int64), paths)
        self.leads = np.zeros(len(self.edges), bool)
        self.leads[np.cumsum(paths) - paths] = True
        self.hashes = W.span_hash(W.BYTE[self.vocabulary], self.offsets[:-1], self.offsets[1:])[self.index] if len(self.index) else np.zeros(0, np.uint64)
        self.own = lang_keys(langs)[self.lang] if langs else np.zeros(0, np.uint64)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams up to the longest, in order, and their counts."""
        key = lambda at, m: gram_keys(self.hashes, self.own, at, m)
        keys, n = [key(self.edges, self.longest)], [self.weight]
        at, flow = self.edges, self.weight
        inner = ~self.leads
        for m in range(self.longest - 1, 0, -1):
            ends = self.tails >= m
            last = self.stop[ends] - m
            # an inner node of a path begins one edge and ends no piece: its flow is there already
            held = ~inner if m == self.longest - 1 else np.ones(len(at), bool)
            places = np.concatenate([at[held], last])
            k, places, total = summed(key(places, m), places, np.concatenate([flow[held], self.ending[ends]]))
            k = np.concatenate([k, key(at[~held], m)])
            at, flow = np.concatenate([places, at[~held]]), np.concatenate([total, flow[~held]])
            keys.append(k)
            n.append(flow)
        keys, n = np.concatenate(keys), np.concatenate(n)
        order = np.argsort(keys)
        return keys[order], n[order]

    def named(self, wanted: np.ndarray, n: np.ndarray) -> Iterator[tuple[str, int, str, int]]:
        """lang, length, phrase and count of the wanted n-grams; wanted is in order."""
        text, lo, hi = self.vocabulary.tobytes(), self.offsets[:-1][self.index], self.offsets[1:][self.index]
        for m in range(1, self.longest + 1):
            at = np.flatnonzero(self.left >= m)
            keys = gram_keys(self.hashes, self.own, at, m)
            found = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
            hit = wanted[found] == keys
            which, one = np.unique(found[hit], return_index=True)
            at = at[hit][one]
            spans = [list(zip(lo[at + k].tolist(), hi[at + k].tolist(), strict=True)) for k in range(m)]
            for w, lang, *words in zip(which.tolist(), self.lang[at].tolist(), *spans, strict=True):
                yield self.langs[lang], m, " ".join(text[a:b].decode() for a, b in words), int(n[w])


def graphs(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """text, lang -> stored graphs of runs of texts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, run = R.Numbers(), Run()
        kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 10]
        names = [c.split()[0] for c in GRAPH.split(", ")]

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(run.graph(numbers.next(), longest), kinds, strict=True)], names)

        for batch in batches:
            langs = batch.column(1)
            for b in W.blocks(batch.column(0), lower=True, separators=BETWEEN):
                run.add(b, langs.slice(b.row, len(b)).to_pylist())
                if run.size >= RUN:
                    yield flush()
                    run = Run()
        if run.size:
            yield flush()

    return checkpoint(docs.select("text", "lang").mapInArrow(build, GRAPH))


PARTS = [c.split()[0] for c in GRAPH.split(", ") if c.split()[0] not in ("run", "spoken")]


def frequent(stored: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, m, phrase, f of all n-grams of at most the longest length that occur often enough."""
    ranges = R.RANGES * R.shuffles(stored)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, *row in R.rows_of(batch):
                keys, n = Graph(row, longest).counts()
                rows = [(r, run, x, R.pack(n[lo:hi])) for r, lo, hi, x in R.cut(keys, ranges)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["range", "run", "gaps", "n"])

    def merge(held: list[tuple]) -> Iterator[tuple]:
        parts = [R.keys_of(x) for _, _, x, _ in held]
        keys = np.concatenate(parts)
        who = np.repeat(np.arange(len(held)), [len(p) for p in parts])
        keys, who, n = summed(keys, who, np.concatenate([R.unpack(y).astype(np.int64) for *_, y in held]))
        often = n >= least
        keys, who, n = keys[often], who[often], n[often]
        for k in np.unique(who).tolist():
            own = who == k
            yield held[k][1], R.pack(np.diff(keys[own], prepend=np.uint64(0))), R.pack(n[own])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in R.grouped(batches):
            told = [x for x in held if x[1] is not None]
            if not told:
                continue
            keys = np.concatenate([R.keys_of(x[1]) for x in told])
            n = np.concatenate([R.unpack(x[2]) for x in told])
            order = np.argsort(keys)
            graph = next(x[3:] for x in held if x[1] is None)
            out = list(Graph(graph, longest).named(keys[order], n[order]))
            for lo in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 20_000], strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "m", "phrase", "f"])

    sent = stored.select("run", *PARTS).mapInArrow(send, "range int, run long, gaps binary, n binary")
    told = R.meet(sent, merge, "run long, keys binary, n binary", pa.schema([("run", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())]))
    empty = [F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in PARTS]
    none = F.lit(None).cast("binary")
    both = stored.select("run", none.alias("keys"), none.alias("n"), *PARTS).union(told.select("run", "keys", "n", *empty))
    both = both.repartition(R.shuffles(stored), "run").sortWithinPartitions("run")
    return both.mapInArrow(name, "lang string, m int, phrase string, f long")


def score(a: str, left: str, right: str):
    """floor(1000000 a a / (l r)), exactly: counts below 10**15."""
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * whole(a) * whole(a), whole(left) * whole(right))


def scored(grams: DataFrame, shortest: int = SHORTEST, share: int = SHARE) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one stands for."""
    words = F.split("phrase", " ")
    whole = grams.where(F.col("m") >= shortest).select("lang", "phrase", "m", F.col("f").alias("a"))
    text = lambda lo, n: F.array_join(F.slice(words, lo, n), " ")
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", text(F.lit(1), F.col("k")).alias("x"), text(F.col("k") + 1, F.col("m") - F.col("k")).alias("y"))
    part = lambda x, n: grams.select(F.col("lang"), F.col("phrase").alias(x), F.col("f").alias(n))
    cuts = cuts.join(part("x", "l"), ["lang", "x"]).join(part("y", "r"), ["lang", "y"])
    best = cuts.select("lang", "phrase", "a", F.struct(score("a", "l", "r").alias("score"), "k", "l", "r").alias("c")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("c").alias("c"))
    # phrases inside longer ones
    inner = whole.where(F.col("m") > shortest).withColumn("n", F.explode(F.sequence(F.lit(shortest), F.col("m") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("n") + 1)))
    around = inner.select("lang", text(F.col("at"), F.col("n")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    best = best.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    return best.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", shortest: int = SHORTEST, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language."""
    if not 2 <= shortest <= longest:
        raise ValueError("phrases have two words at least")
    stored = graphs(docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")), longest)
    grams = checkpoint(frequent(stored, longest, least))
    spoken = checkpoint(stored.select(F.explode(F.map_from_arrays("langs", "spoken")).alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("n")))
    discard(stored)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # the first of each part of a language, then of these, so that no task sees more than PARTS_OF_LANG * top rows of one
    first = scored(grams, shortest, share).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS_OF_LANG)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return first.join(spoken, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


OP13_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM d),
    g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i : i + m - 1], ' '))) AS phrase FROM w, range(1, {LONGEST} + 1) t(m) WHERE len(ws) >= m),
    f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
    c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m >= {SHORTEST} AND f >= {LEAST}),
    k AS (SELECT c.*, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
        JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1 : k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1 :], ' ')),
    b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    i AS (SELECT lang, array_to_string(ws[p : p + q - 1], ' ') AS phrase, max(a) AS longer FROM c, range({SHORTEST}, {LONGEST}) t(q), range(1, {LONGEST} + 1) s(p) WHERE q < m AND p + q - 1 <= m GROUP BY ALL),
    o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * longer < {SHARE} * a)
    SELECT o.lang, rank, o.phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= {TOP}"""
