"""Near duplicates: an n-gram Jaccard self-join with rare-first prefix filtering.

A document's set holds the hashes of its distinct shingles of five words (A-Z folded; of a shorter text, one of all
its words). Equal sets, by 128 bits of hash, are one set from the start; the rest compares distinct sets.

Lone shingles. In a set of n, at least ceil(0.75 n) must be in the other one too. So a set with more than
n - ceil(0.75 n) shingles that no other document has is linked with nothing. Such shingles are looked for among the
LOOK lowest part of all hashes first, which settles most sets; those left are compared among each other only.

Prefixes. Shingles are ordered rare first: by the number of sets left that have them, then by hash. Two sets that link
share one of the first n - ceil(0.75 n) + 1 shingles of the larger and one of the first n - ceil(6/7 n) + 1 of the smaller
(of equal sizes, the one of smaller key), its index prefix, in that order. Sets that share a prefix shingle are candidates
if their sizes are within 75 % (length filter) and what lies before and behind both positions can hold the overlap
(positional filter); lone shingles count for nothing.

Links. A prefix shingle of k sets has k (k - 1) / 2 pairs, which nothing may enumerate when k is large. So each set is
first compared with leaders only: of each shingle and size band the smallest set and two that a hash picks. Connected
components follow. A pair within one component can add nothing to the result, so what is left to compare is every pair
of different components that passes the filters, size band by size band; all of these are. No link between components is
lost, and components over the links of both rounds are the result.

Verification. A set's sketch has a bit for each of CELLS ranges of hashes, set if the set has a shingle there. Every bit that
one of two sets has alone stands for a shingle that the other lacks, which bounds their overlap (suffix filter, over the
whole sets). So do a pair's common prefix shingles and what stands behind the last of them. Pairs that pass are verified
once, by exact intersection.

Null or empty text has an empty set, n_shingles 0, and is linked with nothing. Rows that repeat a doc_id are one document
with several texts: it is linked with whatever one of them is. A null doc_id is smaller than all others. Other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _ranges as R
from tessera.llm import _words as W
from tessera.session import checkpoint, free_names, give_back

WORDS = 5
SHARE = 75
#: The part of all hashes in which lone shingles are looked for first; bits of a sketch; keys of a block.
LOOK = 0.35
CELLS = 1024
SKETCH = [f"w{k}" for k in range(CELLS // 64)]
BLOCK = 1 << 20
MISSING = -(2**63)
#: Parts that the members of a component are dealt out to.
SPREAD = 32
#: Keys, of 40 bytes, that are broadcast to pick texts at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000
NONE = np.uint32(0xFFFFFFFF)


def shingle_sets(b: W.Block, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block, end to end, and their offsets."""
    hashes = b.hashes()
    starts, keys = W.ngrams(hashes, b.first, words)
    docs = np.searchsorted(b.first, starts, "right") - 1
    n = b.counts
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        docs = np.concatenate([docs, short])
        keys = np.concatenate([keys, W.span_hash(hashes, b.first[short], b.first[short + 1], W.Q, W.Q_INV)])
    bits = len(b).bit_length()
    order = np.argsort((docs.astype(W.U) << W.U(64 - bits)) | (keys >> W.U(bits)))
    if np.any((keys[order[1:]] < keys[order[:-1]]) & (docs[order[1:]] == docs[order[:-1]])):  # hashes alike but for their last bits
        order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    docs, keys = docs[new], keys[new]
    return keys, np.searchsorted(docs, np.arange(len(b) + 1))


def set_hashes(keys: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits of hash of each set."""
    both = np.stack([W.span_hash(keys, at[:-1], at[1:], W.Q, W.Q_INV), W.span_hash(W.mix(keys ^ W.P), at[:-1], at[1:])], 1)
    return [x.tobytes() for x in both]


def need(x: np.ndarray, y: np.ndarray, share: int = SHARE) -> np.ndarray:
    """The least overlap of sets of sizes x and y that links them: 100 i >= share (x + y - i)."""
    return -((-share * (x + y)) // (100 + share))


def prefix(n: np.ndarray, share: int = SHARE) -> np.ndarray:
    """Length of the prefix of sets of size n."""
    return n + (-share * n) // 100 + 1


def measured(docs: DataFrame, words: int = WORDS, look: float = LOOK) -> tuple[DataFrame, DataFrame]:
    """id, text -> two stored tables: block, nth, id, n, hash of each row's set; and its keys in the part that is looked
    at, by range and block (range, block, gaps, nth of the row that has the key, NONE if several in the block do)."""
    ranges, limit = R.RANGES * R.shuffles(docs), int(look * (1 << 64))
    names = ["keys", "block", "nth", "id", "n", "x", "y"]
    types = [pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, nth, size = R.Numbers(), [], 0, 0
        block = numbers.next()

        def table(n: int, *cols) -> pa.RecordBatch:
            full = [pa.array(c, t) if c is not None else pa.nulls(n, t) for c, t in zip(cols, types, strict=True)]
            return pa.RecordBatch.from_arrays(full, names)

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([k for k, _ in held])
            doc = np.concatenate([d for _, d in held])
            order = np.argsort(keys)
            keys, doc = keys[order], doc[order]
            new = np.append(True, keys[1:] != keys[:-1])
            at = np.flatnonzero(new)
            once = np.diff(np.append(at, len(keys))) == 1
            keys, doc = keys[at], np.where(once, doc[at], NONE)
            rows = [(r, x, R.pack(doc[lo:hi])) for r, lo, hi, x in R.cut(keys, ranges, limit)]
            if rows:
                r, x, y = zip(*rows, strict=True)
                yield table(len(rows), [True] * len(rows), [block] * len(rows), r, None, None, x, y)

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for b in W.blocks(batch.column(1), lower=True):
                keys, at = shingle_sets(b, words)
                rows = len(b)
                yield table(rows, [False] * rows, [block] * rows, np.arange(nth, nth + rows), ids[b.row : b.row + rows], np.diff(at), set_hashes(keys, at), None)
                low = keys <= np.uint64(limit - 1)
                held.append((keys[low], (np.repeat(np.arange(nth, nth + rows, dtype=np.uint32), np.diff(at)))[low]))
                nth += rows
                size += int(low.sum())
                if size > BLOCK:
                    yield from flush()
                    held, nth, size, block = [], 0, 0, numbers.next()
            give_back()
        if size:
            yield from flush()

    out = checkpoint(docs.select("id", "text").mapInArrow(run, "keys boolean, block long, nth int, id long, n long, x binary, y binary"), by="keys")
    return out.where("NOT keys").select("block", "nth", "id", "n", F.col("x").alias("hash")), out.where("keys").select(F.col("nth").alias("range"), "block", F.col("x").alias("gaps"), F.col("y").alias("rows"))


def lone(keys: DataFrame) -> DataFrame:
    """block, nth, lone: of each row, how many of the keys that were looked at no other row has."""

    def merge(held: list[tuple]) -> Iterator[tuple]:
        rows = [R.unpack(y).astype(np.uint32) for *_, y in held]
        alone = R.singles([R.keys_of(x) for _, _, x, _ in held], [y == NONE for y in rows])
        for (_, block, *_), y, one in zip(held, rows, alone, strict=True):
            nth, n = np.unique(y[one], return_counts=True)
            if len(nth):
                yield block, R.pack(nth), R.pack(n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in R.grouped(batches):
            nth = np.concatenate([R.unpack(x) for _, x, _ in held]).astype(np.int64)
            total = np.bincount(nth, np.concatenate([R.unpack(x) for *_, x in held]).astype(float))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), held[0][0])), pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["block", "nth", "lone"])

    found = R.meet(keys, merge, "block long, nth binary, n binary", pa.schema([("block", pa.int64()), ("nth", pa.binary()), ("n", pa.binary())]))
    return found.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, nth int, lone long")


def blocks_of(docs: DataFrame, left: DataFrame, total: int, words: int = WORDS) -> DataFrame:
    """id, text and the sets left (rep, s, hash) -> stored blocks of sets: block, s, n, keys of many sets each."""
    picked = docs.select("id", "text").join(F.broadcast(left) if left.count() <= BROADCAST_IDS else left, F.col("id") == F.col("rep")).select("s", "hash", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, wanted = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for b in W.blocks(batch.column(2), lower=True):
                keys, at = shingle_sets(b, words)
                own = [k for k, x in enumerate(set_hashes(keys, at)) if x == wanted[b.row + k]]  # an id may have other texts
                yield pa.RecordBatch.from_arrays([pa.array(s[b.row + np.array(own, np.int64)]), pa.array([keys[at[k] : at[k + 1]].tobytes() for k in own], pa.binary())], ["s", "keys"])

    count = max(1, total // BLOCK)
    dealt = picked.mapInArrow(sets, "s long, keys binary").select(F.pmod(F.xxhash64("s"), F.lit(count)).alias("block"), "s", "keys")
    dealt = dealt.repartition(R.shuffles(docs), "block").dropDuplicates(["block", "s"]).sortWithinPartitions("block", "s")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in R.grouped(batches):
            s = np.array([x for _, x, _ in held], np.int64)
            n = np.array([len(x) // 8 for *_, x in held], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int64()), pa.array([s.tobytes()]), pa.array([n.tobytes()]), pa.array([b"".join(x for *_, x in held)])], ["block", "s", "n", "keys"])

    return checkpoint(dealt.mapInArrow(gather, "block long, s binary, n binary, keys binary"))


def _unpacked(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, n, keys = row
    return np.frombuffer(s, np.int64), np.frombuffer(n, np.int64), np.frombuffer(keys, np.uint64)


def set_rows(blocks: DataFrame) -> DataFrame:
    """s, keys of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in R.rows_of(batch):
                s, n, keys = _unpacked(row)
                at = np.append(0, np.cumsum(n)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.view(np.int64)))], ["s", "keys"])

    return blocks.select("s", "n", "keys").mapInArrow(run, "s long, keys array<long>")


def sketches(blocks: DataFrame) -> DataFrame:
    """s, n and the sketch of each set, as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in R.rows_of(batch):
                s, n, keys = _unpacked(row)
                bits = np.zeros(len(s) * CELLS, bool)
                bits[np.repeat(np.arange(len(s)), n) * CELLS + (keys >> W.U(65 - CELLS.bit_length())).astype(np.int64)] = True
                words = np.packbits(bits, bitorder="little").view(np.int64).reshape(-1, len(SKETCH))
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n.astype(np.int32)), *(pa.array(np.ascontiguousarray(w)) for w in words.T)], ["s", "n", *SKETCH])

    return blocks.select("s", "n", "keys").mapInArrow(run, f"s long, n int, {', '.join(f'{w} long' for w in SKETCH)}")


def entries(blocks: DataFrame, share: int = SHARE) -> DataFrame:
    """Prefix entries g, s, n, pos, held: shingle, set, its size, the shingle's place in the set's order, and how many
    shared ones stand before it. Lone shingles come first in every set and make no entries."""
    ranges = R.RANGES * R.shuffles(blocks)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys in R.rows_of(batch):
                own, n = np.unique(np.frombuffer(keys, np.uint64), return_counts=True)
                rows = [(r, block, x, R.pack(n[lo:hi])) for r, lo, hi, x in R.cut(own, ranges)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["range", "block", "gaps", "n"])

    def merge(held: list[tuple]) -> Iterator[tuple]:
        keys = np.concatenate([R.keys_of(x) for _, _, x, _ in held])
        n = [R.unpack(y).astype(np.int64) for *_, y in held]
        _, to = np.unique(keys, return_inverse=True)
        total = np.bincount(to, np.concatenate(n)).astype(np.int64)[to]
        for (r, block, *_), part in zip(held, np.split(total, np.cumsum([len(x) for x in n])[:-1]), strict=True):
            yield block, r, R.pack(part)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in R.grouped(batches):
            s, n, keys = _unpacked(held[0][2:5])
            count = np.concatenate([R.unpack(x[5]) for x in held[1:]]).astype(np.int64)
            count = count[np.unique(keys, return_inverse=True)[1]]
            own = np.repeat(np.arange(len(s)), n)
            shared = np.flatnonzero(count > 1)
            alone = n - np.bincount(own[shared], minlength=len(s))
            at = shared[np.lexsort((keys[shared], count[shared], own[shared]))]
            doc = own[at]
            rank = np.arange(len(at)) - np.searchsorted(doc, np.arange(len(s)))[doc]
            pos = alone[doc] + rank
            keep = pos < prefix(n, share)[doc]
            at, doc, rank, pos = at[keep], doc[keep], rank[keep], pos[keep]
            for lo in range(0, len(at), 100_000):
                k = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at[k]].view(np.int64)), pa.array(s[doc[k]]), pa.array(n[doc[k]].astype(np.int32)), pa.array(pos[k].astype(np.int32)), pa.array(rank[k].astype(np.int32))], ["g", "s", "n", "pos", "held"])

    sent = blocks.select("block", "keys").mapInArrow(send, "range int, block long, gaps binary, n binary")
    told = R.meet(sent, merge, "block long, range int, count binary", pa.schema([("block", pa.int64()), ("range", pa.int32()), ("count", pa.binary())]))
    empty = F.lit(None).cast("binary")
    both = blocks.select("block", F.lit(-1).alias("range"), "s", "n", "keys", empty.alias("count")).union(told.select("block", "range", empty, empty, empty, "count"))
    return both.repartition(R.shuffles(blocks), "block").sortWithinPartitions("block", "range").mapInArrow(order, "g long, s long, n int, pos int, held int")


def passes(a: str, b: str, share: int = SHARE) -> Column:
    """Length and positional filter on sizes n and positions pos of a common shingle, `held` shared ones before it."""
    n, m = F.col(f"n{a}").cast("long"), F.col(f"n{b}").cast("long")
    rest = F.least(n - F.col(f"pos{a}"), m - F.col(f"pos{b}")) + F.least(F.col(f"held{a}"), F.col(f"held{b}"))
    return (100 * F.least(n, m) >= share * F.greatest(n, m)) & (rest >= F.ceil(share * (n + m) / (100 + share)))


def indexed(n: str, pos: str, share: int = SHARE) -> Column:
    """Whether a position is in a set's index prefix."""
    return F.col(pos) <= F.col(n) - F.ceil(F.lit(2 * share) * F.col(n) / (100 + share))


def suffix_filter(a: str, b: str, share: int = SHARE) -> Column:
    """Whether the sketches of sets of sizes n{a} and n{b} leave room for the overlap that links them."""
    n, m = F.col(f"n{a}").cast("long"), F.col(f"n{b}").cast("long")
    alone = lambda x, y: sum((F.bit_count(F.col(f"{w}{x}").bitwiseAND(F.bitwise_not(F.col(f"{w}{y}")))) for w in SKETCH), F.lit(0))
    return F.least(n - alone(a, b), m - alone(b, a)) >= F.ceil(share * (n + m) / (100 + share))


def verify(pairs: DataFrame, sets: DataFrame, share: int = SHARE) -> DataFrame:
    """a, b -> a, b of the pairs that link, by exact intersection, in the JVM: pairs of long texts are wide rows."""
    both = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    return both.where(100 * common >= share * (F.size("xa") + F.size("xb") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """a, b -> node, root: the smallest node reachable, for nodes that have an edge. Labels spread by hooking and pointer
    jumping, in about log(n) rounds, each a checkpoint."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    edges = checkpoint(both)
    labels = checkpoint(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("c")))
    while True:
        # the least label of the neighbours, told also to one's own label
        seen = edges.join(labels.toDF("b", "cb"), "b").groupBy("a").agg(F.min("cb").alias("m"))
        new = labels.join(seen, labels["id"] == seen["a"]).select("id", "c", F.least("c", "m").alias("m"))
        told = new.where("m < c").groupBy(F.col("c").alias("id2")).agg(F.min("m").alias("t"))
        new = new.join(told, F.col("id") == F.col("id2"), "left").select("id", "c", F.least("m", F.coalesce("t", "m")).alias("m"))
        jump = new.select(F.col("id").alias("r"), F.col("m").alias("up"))
        new = checkpoint(new.join(jump, F.col("m") == F.col("r"), "left").select("id", "c", F.least("m", F.coalesce("up", "m")).alias("m")))
        if new.where("m < c").isEmpty():
            return new.select(F.col("id").alias("node"), F.col("c").alias("root"))
        labels = new.select("id", F.col("m").alias("c"))


def link_sets(blocks: DataFrame, share: int = SHARE) -> DataFrame:
    """Blocks of sets -> node, root of the sets that are linked with others."""
    found = checkpoint(entries(blocks, share).withColumn("band", F.floor(F.log("n") / math.log(100 / share)).cast("int")))
    row = F.struct("n", "s", "pos", "held")
    index = F.when(indexed("n", "pos", share), row)
    by = lambda salt: F.min(F.when(indexed("n", "pos", share), F.struct(F.xxhash64("s", F.lit(salt)).alias("h"), *(F.col(c) for c in ("n", "s", "pos", "held")))))
    leaders = found.groupBy("g", "band").agg(F.count(F.lit(1)).alias("k"), F.min(index).alias("o1"), by(1).alias("o2"), by(2).alias("o3")).where("k > 1")
    leaders = leaders.select(F.col("g").alias("gl"), F.col("band").alias("bl"), F.explode(F.array_distinct(F.array("o1", F.struct("o2.n", "o2.s", "o2.pos", "o2.held"), F.struct("o3.n", "o3.s", "o3.pos", "o3.held")))).alias("o")).where("o.s IS NOT NULL")
    near = leaders.withColumn("bl", F.explode(F.array(F.col("bl"), F.col("bl") + 1)))  # of a set's own band, and of the one below
    star = found.join(near, (F.col("g") == F.col("gl")) & (F.col("band") == F.col("bl"))).select("s", "n", "pos", "held", F.col("o.s").alias("so"), F.col("o.n").alias("no"), F.col("o.pos").alias("poso"), F.col("o.held").alias("heldo"))
    star = star.where((F.col("s") != F.col("so")) & passes("", "o", share)).select(F.least("s", "so").alias("a"), F.greatest("s", "so").alias("b")).distinct()
    drawn = checkpoint(sketches(blocks))
    of = lambda x: drawn.select(F.col("s").alias(x), F.col("n").alias(f"n{x}"), *(F.col(w).alias(f"{w}{x}") for w in SKETCH))
    star = checkpoint(star.join(of("a"), "a").join(of("b"), "b").where(suffix_filter("a", "b", share)).select("a", "b"))
    first = checkpoint(verify(star, set_rows(blocks), share))
    parts = components(first)
    # what is left: pairs of different components
    labelled = found.join(parts, F.col("s") == F.col("node"), "left").select("g", "s", "n", "pos", "held", "band", F.coalesce("root", "s").alias("c"))
    mixed = labelled.groupBy("g").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select(F.col("g").alias("gm"))
    left = labelled.join(mixed, F.col("g") == F.col("gm"), "left_semi")
    left = checkpoint(left.join(drawn.drop("n").withColumnRenamed("s", "sd"), F.col("s") == F.col("sd")).drop("sd"))
    small = left.where(indexed("n", "pos", share))
    large = left.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1))).toDF("g", "so", "no", "poso", "heldo", "band", "co", *(f"{w}o" for w in SKETCH))
    pairs = small.join(large, ["g", "band"]).where((F.struct("n", "s") < F.struct("no", "so")) & (F.col("c") != F.col("co")) & passes("", "o", share) & suffix_filter("", "o", share))
    # the common shingles of the index prefix, and what is behind the last of them
    pairs = pairs.groupBy("s", "so", "n", "no").agg(F.count(F.lit(1)).alias("common"), F.max("pos").alias("pos"), F.max("poso").alias("poso"))
    room = F.col("common") + F.least(F.col("n") - F.col("pos"), F.col("no") - F.col("poso")) - 1
    pairs = pairs.where(room >= F.ceil(share * (F.col("n").cast("long") + F.col("no")) / (100 + share)))
    pairs = pairs.select(F.least("s", "so").alias("a"), F.greatest("s", "so").alias("b"))
    pairs = checkpoint(pairs.join(star, ["a", "b"], "left_anti"))  # what was verified against a leader isn't verified again
    more = verify(pairs, set_rows(blocks), share)
    # components are nodes now, named by their roots
    named = lambda x: F.coalesce(F.col(f"{x}r"), F.col(x))
    joint = more.join(parts.toDF("an", "ar"), F.col("a") == F.col("an"), "left").join(parts.toDF("bn", "br"), F.col("b") == F.col("bn"), "left").select(named("a").alias("a"), named("b").alias("b")).where("a <> b")
    return checkpoint(parts.select(F.col("node").alias("a"), F.col("root").alias("b")).union(joint))


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    rows = docs.select(F.coalesce(F.col(doc_id), F.lit(MISSING)).cast("long").alias("id"), F.col(text).alias("text"))
    every, keys = measured(rows, words)
    reps = every.where("n > 0").groupBy("hash").agg(F.min(F.struct("id", "block", "nth")).alias("r"), F.min("n").alias("n"))
    reps = checkpoint(reps.select("hash", F.col("r.id").alias("rep"), "n", "r.block", "r.nth", F.monotonically_increasing_id().alias("s")))
    single = lone(keys)
    left = reps.join(single, ["block", "nth"], "left").where(F.coalesce("lone", F.lit(0)) <= F.col("n") - F.ceil(F.lit(share) * F.col("n") / 100))
    left = checkpoint(left.select("rep", "s", "hash", "n"))
    total = left.agg(F.sum("n")).first()[0] or 0
    edges = link_sets(blocks_of(rows, left.drop("n"), total, words), share)
    # rows that repeat an id tie their sets together
    members = checkpoint(every.join(reps.select(F.col("hash").alias("rh"), "rep", "s"), F.col("hash") == F.col("rh"), "left").select("id", "n", "s", "rep"))
    tied = members.where("s IS NOT NULL").groupBy("id").agg(F.min("s").alias("b"), F.max("s").alias("z")).where("b < z")
    tied = members.join(tied.select(F.col("id").alias("ti"), "b"), F.col("id") == F.col("ti")).select(F.col("s").alias("a"), "b").where("a <> b").distinct()
    parts = components(edges.union(tied))
    named = parts.join(reps.select("s", "rep"), F.col("node") == F.col("s")).select("node", "root", "rep")
    # a component may hold a third of all sets, so its name goes to its members in SPREAD parts
    least = named.groupBy("root").agg(F.min("rep").alias("least")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    named = named.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(SPREAD)).cast("int")).join(least, ["root", "part"]).select("node", "least")
    out = members.join(named, F.col("s") == F.col("node"), "left")
    back = lambda c: F.nullif(c, F.lit(MISSING))
    return out.select(back(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.coalesce("least", "rep", "id")).alias("component_id"))


def op8(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one whose id names it; documents without words stay all. Rows that repeat the
    id that stays stay too. Other columns are carried, whatever their names."""
    found = link(docs.select("doc_id", "text"))
    gone = found.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.coalesce("doc_id", F.lit(MISSING)).alias("gone")).distinct()
    (gone_id,) = free_names(docs, "gone")
    gone = gone.withColumnRenamed("gone", gone_id)
    return docs.join(gone, F.coalesce(docs["doc_id"], F.lit(MISSING)) == gone[gone_id], "left_anti").select(*(docs[f"`{c}`"] for c in docs.columns))


OP8_SQL = f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, md5(unnest(CASE WHEN len(ws) >= {WORDS} THEN list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i : i + {WORDS - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {SHARE} * (x.n + y.n - i)),
    t AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT t.a, l.b FROM t JOIN l ON l.a = t.b)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.b AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS b FROM t GROUP BY 1) c ON c.a = w.doc_id"""
