"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are put behind each other with their spaces as the model's space symbol. They are cut where no piece has the two characters beside each
other, first before spaces, then, in the distinct words only, everywhere; nothing can be merged across such a cut. All parts are
one flat numpy array of symbols. In each round, a segmented minimum gives each part its pair of best score, and its
occurrences are merged from the left, in all parts at once; the array is compacted, only pairs beside a merge are looked up
again, and parts without a pair leave, until none is left. What remains unknown falls back to bytes.

The order is the library's: the best score first, of equal ones the leftmost. Merging all occurrences of one pair at once gives
the same, unless a merge makes a pair of better score, in which case the round ends there for that part, or other pairs
have the same score, in which case one pair a round is merged (runs of one
character whose pieces all tie, as those of spaces do, are cut at once by a table of how short runs end).

Null text counts as empty: no ids, empty text. Texts of any length are encoded whole; one text is the unit of memory.
Repeated rows are encoded one by one, other columns are not read, an empty table gives an empty result. Models of another
kind (unigram, a normaliser of characters, pieces defined by users) are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _words as W
from tessera.session import small_batches

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, UNUSED, BYTE = 1, 2, 3, 5, 6
#: No pair; no symbol.
NEVER, DEAD = np.int32(2**31 - 1), np.int32(-(2**31))
#: Bytes of texts, and of distinct words, that are worked on at once; a longer text or word is a part of its own.
TEXTS, WORDS = 4 << 20, 1 << 20


class Lookup:
    """Values of pairs of symbols, by open addressing over whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(10, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys = np.array([a << 20 | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # of those that want one slot, the last to write has it
            free = self.keys[at[todo]] < 0
            self.keys[at[todo[free]]] = keys[todo[free]]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = at[todo] + 1 & self.mask
        self.values[at] = values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1 where there is no such pair. Negative symbols are in none."""
        out = np.full(len(a), -1, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        keys = a[todo].astype(np.int64) << 20 | b[todo]
        at = self._slot(keys)
        while len(todo):
            found = self.keys[at]
            hit = found == keys
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found >= 0)
            todo, keys, at = todo[on], keys[on], at[on] + 1 & self.mask
        return out


def run_cuts(known: np.ndarray) -> np.ndarray | None:
    """How a run of one character is merged when all its pieces, of the known lengths, tie: for each length of run below twice
    the longest piece, the lengths of the pieces at the places where they begin. A longer run begins with longest pieces until
    so much is left; None if it doesn't."""
    most = len(known) - 1

    def cut(n: int) -> list[int]:
        parts = [1] * n
        while True:
            at = next((i for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) <= most and known[x]), None)
            if at is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    out = np.zeros((2 * most, 2 * most), np.int64)
    for n in range(4 * most):
        parts = cut(n)
        if n >= 2 * most and parts != [most, *cut(n - most)]:
            return None
        if n < 2 * most:
            out[n, np.cumsum([0, *parts[:-1]])[: len(parts)]] = parts
    return out


class Model:
    """Tables of a model file. Symbols are numbers of pieces; characters that are none have numbers behind them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec, norm = m.trainer_spec, m.normalizer_spec
        kinds = np.array([p.type for p in m.pieces], np.int8)
        if spec.model_type != spec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.treat_whitespace_as_suffix or not spec.byte_fallback or not set(kinds.tolist()) <= {NORMAL, UNKNOWN, CONTROL, UNUSED, BYTE}:
            raise ValueError(f"{path}: not a BPE model with byte fallback and plain text")
        if UNUSED in kinds:
            raise ValueError(f"{path}: unused pieces")
        self.prefix = norm.add_dummy_prefix
        names = [p.piece for p in m.pieces]
        symbol = {p: k for k, p in enumerate(names) if kinds[k] == NORMAL}
        count = len(names)
        for c in sorted({c for p in symbol for c in p} - set(symbol)):
            symbol[c], count = count, count + 1
        self.pieces = len(names)
        self.char = np.full(0x110000, -1, np.int32)
        for p, k in symbol.items():
            if len(p) == 1:
                self.char[ord(p)] = k
        self.char = np.where(self.char < 0, -1 - np.arange(len(self.char), dtype=np.int32), self.char)  # unknown: by code point
        score = {p: m.pieces[k].score for p, k in symbol.items() if k < len(names)}
        place = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        splits = [(p[:i], p[i:], p) for p in score for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol]
        self.merged = Lookup({(symbol[a], symbol[b]): symbol[p] for a, b, p in splits})
        self.beside = Lookup({(symbol[x], symbol[y]): 1 for p in score for x, y in zip(p, p[1:], strict=False)})
        self.rank = np.full(count + 1, NEVER, np.int32)  # the last one is that of no pair
        for p in score:
            self.rank[symbol[p]] = place[score[p]]
        # symbols that are part of a better one; of one of themselves twice; and ranks of several pieces
        self.early, self.twice = np.zeros(count, bool), np.zeros(count, bool)
        for a, b, p in splits:
            for x in (a, b):
                self.early[symbol[x]] |= x in score and score[p] > score[x]
            self.twice[symbol[a]] |= a == b and a in score and score[p] >= score[a]
        held = np.bincount(self.rank[[symbol[p] for p in score if len(p) > 1]], minlength=len(place) + 1)
        self.tied = held > 1
        # a tied rank, the worst one, whose pieces are runs of one character: how runs of it are cut
        self.runs: dict[int, np.ndarray] = {}
        for r in np.flatnonzero(self.tied).tolist():
            own = {p for p in score if len(p) > 1 and place[score[p]] == r}
            c = min(own)[0]
            if c in symbol and all(p == c * len(p) for p in own) and not any(c + c in p and p not in own for p in score) and r == max(place[score[p]] for p in score if len(p) > 1):
                name = np.full(max(map(len, own)) + 1, -1, np.int32)
                name[[1, *map(len, own)]] = [symbol[c], *(symbol[p] for p in own)]
                cuts = run_cuts(name >= 0)
                if cuts is not None:
                    self.runs[r] = np.where(cuts, name[cuts], -1)
        byte = {int(p[3:5], 16): k for k, p in enumerate(names) if kinds[k] == BYTE}
        self.byte = np.array([byte[k] for k in range(256)], np.int32)
        text = [b"" if t == CONTROL else spec.unk_surface.encode() if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() for p, t in zip(names, kinds, strict=True)]
        self.text = pa.array(text, pa.large_binary())
        self.kinds = kinds
        self.opens = np.array([p.startswith(SPACE) and t == NORMAL for p, t in zip(names, kinds, strict=True)])
        self.digits = pa.array([f"{k}," for k in range(len(names))], pa.large_binary())

    # -- encoding

    def contract(self, sym: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Merges parts of so many symbols each; DEAD where a symbol went into the one before it."""
        out, pos = np.full(len(sym), DEAD, np.int32), np.arange(len(sym))
        first = np.cumsum(size) - size
        new = np.append(self.merged(sym[:-1], sym[1:]), -1) if len(sym) else sym
        new[first + size - 1] = -1
        rank = self.rank[new]
        while len(sym):
            best = np.minimum.reduceat(rank, first)
            done = best == NEVER
            if done.any():
                gone = np.repeat(done, size)
                out[pos[gone]] = sym[gone]
                sym, pos, new, rank = sym[~gone], pos[~gone], new[~gone], rank[~gone]
                size, best = size[~done], best[~done]
                if not len(sym):
                    break
                first = np.cumsum(size) - size
            part = np.repeat(np.arange(len(size)), size)
            at = np.flatnonzero(rank == best[part])
            own, r = part[at], rank[at]
            leads = np.append(True, own[1:] != own[:-1])
            head = np.append(True, at[1:] != at[:-1] + 1)
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            last = first + size - 1
            take = nth % 2 == 0
            alone = self.tied[r] | self.twice[new[at]]
            take &= ~alone | leads
            low = np.flatnonzero(take & self.early[new[at]])
            if len(low):  # a merge that makes a better pair is the part's last one of this round
                a, n = at[low], new[at[low]]
                before = np.where(a > first[own[low]], sym[a - 1], -1)
                after = np.where(a + 1 < last[own[low]], sym[np.minimum(a + 2, len(sym) - 1)], -1)
                better = np.minimum(self.rank[self.merged(before, n)], self.rank[self.merged(n, after)]) < r[low]
                stop = np.full(len(size), len(at))
                np.minimum.at(stop, own[low[better]], low[better])
                take &= np.arange(len(at)) <= stop[own]
            keep = np.ones(len(sym), bool)
            for k, names in self.runs.items():
                mine = r == k
                if mine.any():  # the symbols of a run are those of its pairs and one more
                    width = len(names) // 2
                    heads = np.flatnonzero(head)
                    own_heads = mine[heads]
                    length = np.diff(np.append(heads, len(at)))[own_heads] + 1
                    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                    where = np.repeat(at[heads[own_heads]], length) + inside
                    whole = np.repeat(np.maximum(length // width - 1, 0) * width, length)
                    rest = np.repeat(length, length) - whole
                    name = np.where(inside < whole, np.where(inside % width == 0, names[width, 0], -1), names[rest, np.maximum(inside - whole, 0)])
                    chunk = name >= 0
                    sym[where[chunk]] = name[chunk]
                    keep[where[~chunk]] = False
                    new[where], rank[where] = -1, NEVER
                    take &= ~mine
            at = at[take]
            sym[at] = new[at]
            keep[at + 1] = False
            to = np.cumsum(keep) - 1
            size = size - np.bincount(part[~keep], minlength=len(size))
            sym, pos, new, rank, part = sym[keep], pos[keep], new[keep], rank[keep], part[keep]
            first = np.cumsum(size) - size
            at = to[at]
            look = np.unique(np.concatenate([at, at[at > first[part[at]]] - 1]))
            inner = look < (first + size - 1)[part[look]]
            new[look] = -1
            look_in = look[inner]
            new[look_in] = self.merged(sym[look_in], sym[look_in + 1])
            rank[look] = self.rank[new[look]]
        return out

    def words(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each of some words, end to end, and their offsets."""
        data, offs = W.raw(words)
        data = data[offs[0] : offs[-1]]
        offs = offs - offs[0]
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        code = np.where(code == 32, np.uint32(ord(SPACE)), code)
        chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offs]
        sym = self.char[code]
        cut = np.zeros(len(sym) + 1, bool)
        cut[chars] = True
        if len(sym):
            cut[1:-1] |= self.beside(sym[:-1], sym[1:]) < 0
        at = np.flatnonzero(cut)
        got = self.contract(sym.copy(), np.diff(at))
        at = np.flatnonzero(got != DEAD)
        got, ends = got[at], np.searchsorted(at, chars)
        strange = (got < 0) | (got >= self.pieces)
        if not strange.any():
            return got, ends
        # characters that are no piece, as their bytes
        lead = np.flatnonzero(np.append((data & 0xC0) != 0x80, True))
        many = np.where(strange, (lead[1:] - lead[:-1])[at], 1)
        to = np.cumsum(many) - many
        out = np.repeat(got, many)
        odd = np.repeat(strange, many)
        # a space that is no piece stands for three bytes
        raw = np.repeat(lead[at], many) + np.arange(len(out)) - np.repeat(to, many)
        out[odd] = self.byte[data[raw[odd]]]
        return out, np.append(to, len(out))[ends]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text, end to end, and their offsets."""
        texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), SPACE, " ")
        if self.prefix:
            empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
            texts = pc.if_else(pc.equal(texts, empty), empty, pc.binary_join_element_wise(space, texts, empty))
        data, offs = W.raw(texts)
        data, offs = data[offs[0] : offs[-1]], offs - offs[0]
        cut = np.zeros(len(data) + 1, bool)
        cut[offs] = True
        space = data == 32
        cut[1:-1] |= space[1:] & ~space[:-1]
        at = np.flatnonzero(cut) if len(data) else np.zeros(1, np.int64)
        coded = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        names = coded.dictionary
        ends = W.raw(names)[1]
        flat, many, lo = [], [], 0
        while lo < len(names):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + WORDS, "right")) - 1)
            ids, to = self.words(names.slice(lo, hi - lo))
            flat.append(ids)
            many.append(np.diff(to))
            lo = hi
        flat, many = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (flat, many))
        start = np.cumsum(many) - many
        index = coded.indices.to_numpy().astype(np.int64)
        size = many[index]
        end = np.append(0, np.cumsum(size))
        ids = flat[np.repeat(start[index] - end[:-1], size) + np.arange(end[-1])]
        return ids, end[np.searchsorted(at, offs)]

    # -- decoding

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The text of each run ids[at[k] : at[k + 1]], in UTF-8."""
        data, offs = W.raw(self.text.take(pa.array(ids)))
        data = data.tobytes()
        said = np.flatnonzero(self.kinds[ids] != CONTROL)
        begins = np.searchsorted(said, at[:-1])  # of each run, the first id that is more than a mark
        has = begins < np.searchsorted(said, at[1:])
        skip = np.zeros(len(at) - 1, np.int64)
        skip[has] = self.opens[ids[said[begins[has]]]] if self.prefix else 0
        raw = np.append(0, np.cumsum(self.kinds[ids] == BYTE))
        raw = raw[at[1:]] > raw[at[:-1]]
        out = []
        for k, (lo, hi, s) in enumerate(zip(offs[at[:-1]].tolist(), offs[at[1:]].tolist(), skip.tolist(), strict=True)):
            text = data[lo + s : hi]
            if raw[k]:
                try:
                    text.decode()
                except UnicodeDecodeError:
                    text = self._mended(ids[at[k] : at[k + 1]])[s:]
            out.append(text)
        return out

    def _mended(self, ids: np.ndarray) -> bytes:
        """Bytes that are no character become U+FFFD, one by one, in each run of byte ids."""
        out, run = [], b""
        for k, piece in zip(ids.tolist() + [-1], self.text.take(pa.array(ids)).to_pylist() + [b""], strict=True):
            if k >= 0 and self.kinds[k] == BYTE:
                run += piece
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode().encode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�".encode())
                    run = run[1:]
            out.append(piece)
        return b"".join(out)


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """A worker keeps its model from task to task."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about TEXTS bytes."""
    ends, lo = W.raw(texts)[1], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + TEXTS, "right")) - 1)
        yield texts.slice(lo, hi - lo)
        lo = hi


def encode(docs: DataFrame, text: str = "text", column: str = "ids", path: str | None = None) -> DataFrame:
    """Adds the ids of each text as an array."""
    path = path or public_tokenizers.path(MODEL)
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model(path)
        for part in parts:
            got = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)) for ids, at in map(m.encode, _slices(part))]
            yield pa.concat_arrays(got) if got else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(column, run(F.col(text)))


def decode(docs: DataFrame, ids: str = "ids", column: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds the text that the ids stand for; null ids stand for no text, an id that is none of the model's is an error."""
    path = path or public_tokenizers.path(MODEL)
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model(path)
        for part in parts:
            many = pc.fill_null(pc.list_value_length(part), 0).to_numpy()
            yield pa.array([x.decode() for x in m.decode(pc.drop_null(part.flatten()).to_numpy().astype(np.int32), np.append(0, np.cumsum(many)))], pa.string())

    return docs.withColumn(column, run(F.filter(F.col(ids), lambda k: k.isNotNull()).cast("array<int>")))


def round_trip(docs: DataFrame, text: str = "text", column: str = "pieces", path: str | None = None) -> DataFrame:
    """Encodes and decodes in one pass; adds a struct of n_tokens, ids_sha256 and decoded_sha256."""
    path = path or public_tokenizers.path(MODEL)
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for part in parts:
            n, told, back = [], [], []
            for s in _slices(part):
                ids, at = m.encode(s)
                n += np.diff(at).tolist()
                data, offs = W.raw(m.digits.take(pa.array(ids)))
                data = memoryview(data)
                told += [sha(data[lo : max(lo, hi - 1)]) for lo, hi in zip(offs[at[:-1]].tolist(), offs[at[1:]].tolist(), strict=True)]
                back += map(sha, m.decode(ids, at))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(back, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn(column, run(F.col(text)))


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs).select("doc_id", "pieces.*")
