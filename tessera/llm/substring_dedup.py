"""Substring deduplication: FM-indexes of shards answer which passages start earlier in the corpus.

A word is removed if a window of WINDOW words covers it whose word sequence also starts earlier. Two windows can only be
equal if their least-hash m-gram (their anchor) is, so a document falls into runs of windows with one anchor, and
anchors that occur once need no look. Equal runs of an anchor are told by hash: all but the first of them are copies from end to end.
The first runs of anchors that have several different ones go, as texts, to the shard of their anchor; those of an anchor
with more than HOT different runs are cut further, by the least DEEP m-grams of each window.

A shard builds a compressed FM-index - a wavelet matrix over the Burrows-Wheeler transform of its runs in corpus
order, and the first place of each sequence that repeats, for a suffix array - and streams the runs through it: backward
search gives the matching statistics, the number of words before each place that occur elsewhere, up to WINDOW. Places whose
statistic reaches WINDOW, and whose match is first found before them, are reported as intervals of words.

A shard is cut at anchors into blocks of about BLOCK words. A key with more words than that is indexed in several
blocks, earlier ones kept beside the current one, compressed, so nothing is dropped. Texts of documents cross the network
once, for extracting runs and for removing words alike.

Null or empty text has no words. Documents are ordered by doc_id, null first; rows that repeat a doc_id with other text are
documents of their own, ordered by a hash of the text, and rows that repeat both are one document with one result
each. Texts are read whole. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _ranges as R
from tessera.llm import _words as W
from tessera.session import checkpoint, discard

WINDOW, GRAM = 20, 6
#: Words of an index; runs that a task looks over at once; different runs from which on an anchor is hot, and how many
#: m-grams then make the key.
BLOCK, RUNS, HOT, DEEP = 1_000_000, 200_000, 5000, 3
MISSING = -(2**63)


def runs(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of a text with one anchor: first window, windows, anchor hash, and whether the run
    has its anchor at several places."""
    at, keys = W.ngrams(hashes, first, gram)
    starts, _ = W.ngrams(hashes, first, window)
    if not len(starts):
        return starts, starts, np.zeros(0, W.U), np.zeros(0, bool)
    # grams of a text lie one after another, so a window's grams do too
    where = np.searchsorted(at, starts)
    span = window - gram + 1
    least = keys.copy()
    step = 1
    while step * 2 <= span:
        least = np.minimum(least[: len(least) - step], least[step:])
        step *= 2
    anchor = np.minimum(least[where], least[where + span - step])
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(starts)))
    lo, hi, own = where[head], where[head] + n - 1, anchor[head]
    left, right = lo.copy(), hi.copy()
    for k in range(1, span):
        left = np.where(keys[left] == own, left, lo + k)
        right = np.where(keys[hi + k] == own, hi + k, right)
    return starts[head], n, own, left < right


FOUND = "kind byte, block long, range int, anchor long, run long, did long, th long, start int, n int, several boolean, x binary, runs binary, docs binary, starts binary, ns binary"
COPY, RUN, DOCS, KEYS = range(4)
_TYPES = {"byte": pa.int8(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
_FOUND = pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in FOUND.split(", "))])


def anchors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """did, th, text -> stored rows of four kinds, by blocks of documents: COPY, runs that their block has earlier; RUN, first
    runs of anchors that the block has several times; KEYS, the anchors of a block, sorted and cut into ranges, with
    the run of each (ns is 0 where the block has several); DOCS, did and th of the block's documents."""
    ranges = R.RANGES * R.shuffles(docs)

    def rows(count: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(count, f.type) for f in _FOUND], schema=_FOUND)

    def flush(block: int, held: list[tuple], did: np.ndarray, th: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc, start, n, anchor, run, several = (np.concatenate(x) for x in zip(*held, strict=True))
        yield rows(1, kind=[DOCS], block=[block], range=[-1], x=[did.tobytes()], runs=[th.tobytes()])
        by_place = np.lexsort((th, did))
        rank = np.empty(len(did), np.int64)
        new = np.append(False, (np.diff(did[by_place]) != 0) | (np.diff(th[by_place]) != 0))[: len(did)]
        rank[by_place] = np.cumsum(new)  # rows that repeat a document have one place
        order = np.lexsort((start, rank[doc], run, anchor))
        doc, start, n, anchor, run, several = (x[order] for x in (doc, start, n, anchor, run, several))
        other = np.append(True, (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1]))
        first = np.flatnonzero(other)[np.cumsum(other) - 1]
        late = np.flatnonzero((rank[doc] != rank[doc[first]]) | (start != start[first]))
        if len(late):
            yield rows(len(late), kind=np.full(len(late), COPY, np.int8), did=did[doc[late]], th=th[doc[late]], start=start[late], n=n[late])
        doc, start, n, anchor, run, several = (x[other] for x in (doc, start, n, anchor, run, several))
        at = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        many = np.repeat(np.diff(np.append(at, len(anchor))) > 1, np.diff(np.append(at, len(anchor)))) | several
        k = np.flatnonzero(many)
        if len(k):
            yield rows(len(k), kind=np.full(len(k), RUN, np.int8), anchor=anchor[k].view(np.int64), run=run[k].view(np.int64), did=did[doc[k]], th=th[doc[k]], start=start[k], n=n[k], several=several[k])
        size = np.where(many[at], 0, n[at])
        cuts = [(r, x, run[at[lo:hi]].tobytes(), R.pack(doc[at[lo:hi]]), R.pack(start[at[lo:hi]]), R.pack(size[lo:hi])) for r, lo, hi, x in R.cut(anchor[at], ranges)]
        r, x, own, d, s, z = zip(*cuts, strict=True)
        yield rows(len(r), kind=[KEYS] * len(r), block=[block] * len(r), range=r, x=x, runs=own, docs=d, starts=s, ns=z)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, size = R.Numbers(), [], 0
        dids, ths, base = [], [], 0
        for batch in batches:
            did, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for b in W.blocks(batch.column(2)):
                hashes = b.hashes()
                start, n, anchor, several = runs(hashes, b.first, window, gram)
                doc = np.searchsorted(b.first, start, "right") - 1
                whole = W.span_hash(hashes, start, start + n + window - 1, W.P, W.P_INV)
                held.append((base + doc, start - b.first[doc], n, anchor, whole, several))
                dids.append(did[b.row : b.row + len(b)])
                ths.append(th[b.row : b.row + len(b)])
                base += len(b)
                size += len(start)
                if size > RUNS:
                    yield from flush(numbers.next(), held, np.concatenate(dids), np.concatenate(ths))
                    held, size, dids, ths, base = [], 0, [], [], 0
        if size:
            yield from flush(numbers.next(), held, np.concatenate(dids), np.concatenate(ths))

    return checkpoint(docs.select("did", "th", "text").mapInArrow(run, FOUND), by="kind")


def repeated(found: DataFrame) -> DataFrame:
    """The runs whose anchor occurs more than once: anchor, run, did, th, start, n, several."""

    def merge(held: list[tuple]) -> Iterator[tuple]:
        keys, sizes = [R.keys_of(h[2]) for h in held], [R.unpack(h[6]) for h in held]
        alone = R.singles(keys, [n == 0 for n in sizes])
        for (_, block, _, own, docs, starts, _), key, n, one in zip(held, keys, sizes, alone, strict=True):
            k = np.flatnonzero(~one & (n > 0))
            if len(k):
                yield block, key[k].tobytes(), np.frombuffer(own, np.uint64)[k].tobytes(), R.pack(R.unpack(docs)[k]), R.pack(R.unpack(starts)[k]), R.pack(n[k])

    packed = [("block", pa.int64()), ("x", pa.binary()), ("runs", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary()), ("ns", pa.binary())]
    told = R.meet(found.where(F.col("kind") == KEYS).select("range", "block", "x", "runs", "docs", "starts", "ns"), merge, "block long, x binary, runs binary, docs binary, starts binary, ns binary", pa.schema(packed))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in R.grouped(batches):
            did, th = np.frombuffer(held[0][2], np.int64), np.frombuffer(held[0][3], np.int64)
            for _, _, anchor, own, docs, starts, ns in held[1:]:
                doc = R.unpack(docs).astype(np.int64)
                cols = [np.frombuffer(anchor, np.int64), np.frombuffer(own, np.int64), did[doc], th[doc], R.unpack(starts).astype(np.int32), R.unpack(ns).astype(np.int32), np.zeros(len(doc), bool)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "run", "did", "th", "start", "n", "several"])

    docs = found.where(F.col("kind") == DOCS).select("block", F.lit(0).alias("k"), "x", "runs", "docs", "starts", "ns")
    both = docs.union(told.select("block", F.lit(1).alias("k"), "x", "runs", "docs", "starts", "ns"))
    named = both.repartition(R.shuffles(found), "block").sortWithinPartitions("block", "k").mapInArrow(name, "anchor long, run long, did long, th long, start int, n int, several boolean")
    return named.union(found.where(F.col("kind") == RUN).select("anchor", "run", "did", "th", "start", "n", "several"))


def passages(docs: DataFrame, lists: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Documents and their runs (start, n, anchor, hot) -> key, did, th, start, words of each run as text."""

    def cut(hashes: np.ndarray, n: int, anchor: int) -> list[tuple[int, int, int]]:
        """Runs of windows of one hot run that have the same least DEEP m-grams: key, first window, windows."""
        grams = W.ngrams(hashes, np.array([0, len(hashes)]), gram)[1]
        least = np.sort(np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1), 1)[:, :DEEP]
        key = np.zeros(n, W.U)
        for k in range(least.shape[1]):
            key = W.mix(key * W.P + least[:, k])
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return list(zip(key[head].view(np.int64).tolist(), head.tolist(), np.diff(np.append(head, n)).tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            flat, offs = lists.flatten(), np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())))
            start, n, anchor = (flat.field(k).to_numpy() for k in range(3))
            hot = flat.field(3).to_numpy(zero_copy_only=False)
            for b in W.blocks(batch.column(2)):
                lo, hi = offs[b.row], offs[b.row + len(b)]
                doc = np.searchsorted(offs, np.arange(lo, hi), "right") - 1
                start_, n_, key = start[lo:hi], n[lo:hi], anchor[lo:hi]
                if hot[lo:hi].any():
                    hashes, parts = b.hashes(), []
                    for k, (d, s, m, a, h) in enumerate(zip(doc, start_.tolist(), n_.tolist(), key.tolist(), hot[lo:hi], strict=True)):
                        w = b.first[d - b.row] + s
                        parts += [(k, x, s + i, c) for x, i, c in cut(hashes[w : w + m + window - 1], m, a)] if h else [(k, a, s, m)]
                    k, key, start_, n_ = (np.array(x, np.int64) for x in zip(*parts, strict=True))
                    doc = doc[k]
                w = b.first[doc - b.row] + start_
                a, z = b.start[w], b.end[w + n_ + window - 2]
                data = b.data.tobytes()
                text = pa.array([data[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(did[doc]), pa.array(th[doc]), pa.array(start_.astype(np.int32)), text], ["key", "did", "th", "start", "words"])

    return docs.join(lists, ["did", "th"]).select("did", "th", "text", "runs").mapInArrow(run, "key long, did long, th long, start int, words binary")


class FMIndex:
    """Index of a sequence of symbols for patterns of up to `depth` symbols. Symbol 0 separates and is never searched."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        n = len(text)
        rank = text.astype(np.int64)
        step, order, new = 1, np.argsort(rank, kind="stable"), None
        while step < depth:  # prefix doubling up to the depth asked for; what is still equal stays in text order
            ahead = min(step, depth - step)
            key = rank * (n + sigma + 2)
            key[:-ahead] += rank[ahead:] + 1
            order = np.argsort(key, kind="stable")
            new = np.append(True, key[order[1:]] != key[order[:-1]])
            del key
            rank[order] = np.cumsum(new) - 1
            step += ahead
        del rank
        # the first place of each sequence of `depth` symbols that repeats, by the start of its range
        heads = np.flatnonzero(new) if new is not None else np.arange(n)
        heads = heads[np.diff(np.append(heads, n)) > 1]
        self.heads, self.places = heads.astype(np.int32), order[heads].astype(np.int32)
        self.size = n
        bwt = text[order - 1].astype(np.int32)
        del order
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=sigma))).astype(np.int32)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.ones, self.rest, self.zeros = [], [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level & 1).astype(bool)
            pad = np.zeros(-(-(n + 1) // 512) * 512, bool)
            pad[:n] = bit
            words = np.packbits(pad, bitorder="little").view(np.uint64)
            upto = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))[:-1]
            self.bits.append(words)
            self.ones.append(upto[::8].astype(np.int32))  # of every eighth word, and of the words since
            self.rest.append((upto - np.repeat(upto[::8], 8)).astype(np.uint16))
            self.zeros.append(n - int(bit.sum()))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        self.base = self._walk(np.arange(sigma), np.zeros(sigma, np.int64)).astype(np.int32)

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            one = self.ones[k][word >> 3] + self.rest[k][word].astype(np.int64) + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + one, at - one)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the ranges of symbol + pattern."""
        skip = (self.first[symbol] - self.base[symbol]).astype(np.int64)
        n = len(symbol)
        both = self._walk(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return both[:n] + skip, both[n:] + skip

    def statistics(self, text: np.ndarray, ends: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics: of each end, how many symbols of text before it, up to depth, occur at least `least`
        times in the index, and where their range starts."""
        length, start = np.zeros(len(ends), np.int16), np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        lo = np.zeros(len(ends), np.int64)
        hi = np.full(len(ends), self.size, np.int64)
        for k in range(1, depth + 1):
            lo, hi = self.extend(text[ends[live] - k], lo, hi)
            keep = hi - lo >= least
            live, lo, hi = live[keep], lo[keep], hi[keep]
            if not len(live):
                break
            length[live] = k
            start[live] = lo
        return length, start

    def place(self, start: np.ndarray) -> np.ndarray:
        """The first place of the sequences whose ranges start there; -1 of such as occur once."""
        if not len(self.heads):
            return np.full(len(start), -1, np.int64)
        k = np.minimum(np.searchsorted(self.heads, start), len(self.heads) - 1)
        return np.where(self.heads[k] == start, self.places[k], -1).astype(np.int64)


class Shard:
    """The runs of some keys. Blocks of one key that are too many for one index follow each other."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.older: list[tuple[FMIndex, np.ndarray]] = []
        self.met = np.zeros(0, W.U)

    def stream(self, words: pa.Array) -> list[np.ndarray]:
        """Flags of each run's windows; then the block is part of the shard."""
        hashes, sizes = [], []
        for b in W.blocks(words):
            hashes.append(b.hashes())
            sizes.append(b.counts)
        flat, size = np.concatenate(hashes), np.concatenate(sizes)
        offs = np.append(0, np.cumsum(size))
        whole = W.span_hash(flat, offs[:-1], offs[1:], W.Q, W.Q_INV)
        own, at, to = np.unique(whole, return_index=True, return_inverse=True)  # equal runs share one search
        copy = np.isin(own, self.met)[to] | (at[to] != np.arange(len(to)))
        order = np.sort(at)
        place = np.searchsorted(order, at)[to]  # of each run, its place among the distinct ones
        n = size[order]
        # distinct runs in corpus order, a separator before each
        text_at = np.cumsum(n + 1) - n
        total = int((n + 1).sum())
        source = np.repeat(offs[order] - text_at, n)
        inside = np.repeat(text_at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        taken = flat[inside + source]
        alphabet, symbol = np.unique(taken, return_inverse=True)
        text = np.zeros(total, np.int32)
        text[inside] = symbol + 1
        index = FMIndex(text, len(alphabet) + 1, self.window)
        windows = n - self.window + 1
        start = np.repeat(text_at, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        length, at_ = index.statistics(text, start + self.window, self.window, 2)
        early = length >= self.window
        early[early] = index.place(at_[early]) < start[early]
        for other, letters in self.older:
            k = np.minimum(np.searchsorted(letters, alphabet), len(letters) - 1)
            known = np.append(0, np.where(letters[k] == alphabet, k + 1, 0))[text]
            cum = np.append(0, np.cumsum(known == 0))
            full = np.flatnonzero(~early & (cum[start + self.window] == cum[start]))
            early[full] |= other.statistics(known, start[full] + self.window, self.window, 1)[0] >= self.window
        ends = np.cumsum(windows)
        out = []
        for k, c in zip(place.tolist(), copy.tolist(), strict=True):
            out.append(np.ones(int(windows[k]), bool) if c else early[ends[k] - windows[k] : ends[k]])
        self.last = (index, alphabet)
        self.new = own
        return out

    def keep(self) -> None:
        self.older.append(self.last)
        self.met = np.union1d(self.met, self.new)


def intervals(found: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """key, did, th, start, words -> did, th, a, z: words a to z (exclusive) of a document that are to go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        shard, last = Shard(window), np.array([[0, 0, 0, -1]])

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal last
            t = pa.Table.from_batches(parts)
            ids = np.stack([t.column(k).to_numpy().astype(np.int64) for k in range(4)], 1)
            once = np.any(np.diff(ids, axis=0, prepend=last) != 0, axis=1)  # rows that repeat a document
            last = ids[-1:]
            if not once.any():
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2 + [pa.array([], pa.int32())] * 2, ["did", "th", "a", "z"])
            t = t.filter(pa.array(once)).combine_chunks()
            did, th, start = (t.column(k).to_numpy() for k in (1, 2, 3))
            flags = shard.stream(pa.concat_arrays(t.column(4).cast(pa.large_binary()).chunks))
            n = np.array([len(f) for f in flags])
            flat = np.append(np.concatenate(flags), False)
            run_of = np.repeat(np.arange(len(n)), n)
            edge = np.ones(len(run_of), bool)
            edge[1:] = run_of[1:] != run_of[:-1]
            before = np.append(False, flat[:-2])
            on = np.flatnonzero(flat[:-1] & (edge | ~before))
            after = np.append(edge[1:], True)
            off = np.flatnonzero(flat[:-1] & (after | ~flat[1:]))
            r, base = run_of[on], np.cumsum(n) - n
            a = start[r] + on - base[r]
            return pa.RecordBatch.from_arrays([pa.array(did[r]), pa.array(th[r]), pa.array(a.astype(np.int32)), pa.array((a + off - on + window).astype(np.int32))], ["did", "th", "a", "z"])

        key = None
        for batch in batches:
            # cut at keys, so that a block holds whole keys unless one alone is larger
            keys = batch.column(0).to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
            bytes_ = np.append(0, np.cumsum(np.array([len(x) for x in batch.column(4).to_pylist()])))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                new = keys[lo] != key
                key = keys[lo]
                if size > block * 6 and held:
                    yield flush(held)
                    if new:
                        shard = Shard(window)
                    else:
                        shard.keep()
                    held, size = [], 0
                elif new and shard.older and held:  # the large key is over
                    yield flush(held)
                    shard, held, size = Shard(window), [], 0
                held.append(batch.slice(lo, hi - lo))
                size += int(bytes_[hi] - bytes_[lo])
        if held:
            yield flush(held)

    rows = found.repartition("key").sortWithinPartitions("key", "did", "th", "start")
    return rows.mapInArrow(run, "did long, th long, a int, z int")


def strip(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents and what is to go of each (spans of a, z) -> doc_id, n_words, n_removed, kept_sha256, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2).to_pylist()
            n_words, removed, digest, kept = [], [], [], []
            for b in W.blocks(batch.column(1)):
                stay = np.ones(len(b.start), bool)
                for k in range(len(b)):
                    for x in spans[b.row + k] or ():
                        stay[b.first[k] + x["a"] : b.first[k] + x["z"]] = False
                words = np.flatnonzero(stay)
                doc = np.searchsorted(b.first, words, "right") - 1
                # the bytes of the words that stay, and of one separator behind each but the last of its text
                d = np.zeros(len(b.data) + 1, np.int8)
                d[b.start[words]] += 1
                d[b.end[words]] -= 1
                mask = np.cumsum(d, dtype=np.int8) > 0
                mask[b.end[words[:-1]][doc[1:] == doc[:-1]]] = True
                data = np.where(W.SEP[b.data], np.uint8(32), b.data)[mask[:-1]].tobytes()
                at = np.append(0, np.cumsum(mask))[b.offsets].tolist()
                texts = [data[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
                n_words.append(b.counts)
                removed.append(b.counts - np.bincount(doc, minlength=len(b)))
                digest += [hashlib.sha256(t).hexdigest() for t in texts]
                kept += texts
            n_words, removed = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n_words, removed))
            kept = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), kept], ["did", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return docs.join(gone, ["did", "th"], "left").select("did", "text", "spans").mapInArrow(run, "did long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of each row."""
    ident = F.coalesce(F.col(doc_id), F.lit(MISSING)).cast("long")
    rows = docs.select(ident.alias("did"), F.xxhash64(F.col(text)).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = anchors(rows, window, gram)
    again = checkpoint(repeated(found))
    copies = checkpoint(found.where(F.col("kind") == COPY).select("did", "th", "start", "n"))
    discard(found)
    place = F.struct("did", "th", "start")
    first = again.groupBy("anchor", "run").agg(F.min(place).alias("first"), F.min("n").alias("n"), F.max("several").alias("several"), F.count(F.lit(1)).alias("times"))
    first = checkpoint(first)
    later = first.where("times > 1").select(F.col("anchor").alias("fa"), F.col("run").alias("fr"), "first")
    later = again.join(later, (F.col("anchor") == F.col("fa")) & (F.col("run") == F.col("fr"))).where(F.struct("did", "th", "start") > F.col("first"))
    wide = first.groupBy(F.col("anchor").alias("wa")).agg(F.count(F.lit(1)).alias("k"), F.max("several").alias("any")).where("k > 1 OR any")
    wanted = first.join(wide, F.col("anchor") == F.col("wa")).select("first.*", "n", "anchor", (F.col("k") > hot).alias("hot"))
    lists = wanted.groupBy("did", "th").agg(F.sort_array(F.collect_set(F.struct("start", "n", "anchor", "hot"))).alias("runs"))
    dealt = rows.repartition("did", "th")  # used twice, shuffled once
    whole = later.select("did", "th", "start", "n").union(copies).select("did", "th", F.col("start").alias("a"), (F.col("start") + F.col("n") + window - 1).alias("z"))
    spans = intervals(passages(dealt, checkpoint(lists), window, gram), window).union(whole)
    gone = spans.groupBy("did", "th").agg(F.collect_set(F.struct("a", "z")).alias("spans"))
    out = strip(dealt, gone)
    return out.select(F.nullif("did", F.lit(MISSING)).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).drop("kept_text")


OP4_SQL = f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
    g AS (SELECT doc_id, k, md5(array_to_string(ws[k : k + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS k FROM w WHERE len(ws) >= {WINDOW})),
    f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) > 1 AS late FROM g),
    c AS (SELECT e.doc_id, e.k, e.word, max(CASE WHEN late THEN 1 ELSE 0 END) OVER (PARTITION BY e.doc_id ORDER BY e.k ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM e LEFT JOIN f USING (doc_id, k))
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY k) FILTER (gone = 0), '')) AS kept_sha256 FROM w LEFT JOIN c USING (doc_id) GROUP BY w.doc_id, len(ws)"""
