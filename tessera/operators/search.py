"""Vector retrieval: filtered scoring, grouped top-k, and the shared pool of a bucket."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import policies, vectors
from tessera.session import checkpoint, small_batches

#: Scores are compared and ranked at this many places, so that the order doesn't depend on the order of additions.
PLACES = 9
#: Parts that the rows of a scope are dealt out to; units go to each.
SALTS = 16


def top_k(scored: DataFrame, by: list[str], k: int, order: list[Column], rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts groups on the map side too."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def ranked(scored: DataFrame, by: list[str], k: int, rank: str = "rank") -> DataFrame:
    return top_k(scored, by, k, [F.col("score").desc(), F.col("memory_id")], rank)


def units(requests: DataFrame, scopes: Column, policy: Column | None = None) -> DataFrame:
    """What a search needs: unit, vector, and the filters; a null policy lets everything pass."""
    return requests.select(F.col("request_id").alias("unit"), F.col("qvec"), scopes.alias("scopes"), F.col("types"), (policy if policy is not None else F.lit(None).cast("array<string>")).alias("asked"))


def candidates(units: DataFrame, memory: DataFrame) -> DataFrame:
    """Memory rows that a unit may see: scope in its list (an equi-join on the exploded list; an empty list sees all, part by
    part), type in its list (empty: all), visibilities overlapping."""
    ok = (F.size("types") == 0) | F.array_contains("types", F.col("memory_type"))
    ok = ok & policies.readable(F.col("visibility"), F.col("asked"))
    dealt = memory.withColumn("_salt", F.pmod(F.xxhash64("memory_id"), F.lit(SALTS)))  # a scope may hold a third of all rows
    parts = units.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = F.col("_part") == F.col("_salt")
    some = parts.where(F.size("scopes") > 0).withColumn("_scope", F.explode(F.array_distinct("scopes")))
    found = some.join(dealt, (F.col("_scope") == F.col("scope_id")) & same & ok).drop("_scope")
    return found.unionByName(parts.where(F.size("scopes") == 0).join(dealt, same & ok)).drop("_part", "_salt")


def search(units: DataFrame, memory: DataFrame, k: int = 50, similarity: str = "cosine", rank: str = "rank", as_of: Column | None = None) -> DataFrame:
    """unit, memory_id, score, rank. Rows without a vector score 0 and stay. Expired rows go only if as_of is given.

    What a unit may see is what `candidates` gives, but pairs are scored by matrix products: rows of a scope and units that ask for it are
    packed to blocks, which meet by an equi-join on the scope and one of SALTS parts. A task keeps the first k rows of each unit of
    the blocks at hand, and only these leave it."""
    rows = memory if as_of is None else memory.where(~policies.expired(F.col("created_at"), F.col("ttl"), as_of))
    found = blocks_met(unit_blocks(units), row_blocks(rows), units.schema["unit"].dataType, memory.schema["memory_id"].dataType, k, similarity)
    return ranked(found, ["unit"], k, rank)


#: Units and rows of a block; blocks of units whose best rows a task holds at once.
UNIT_ROWS, MEMORY_ROWS, HELD = 1024, 4096, 64


def dim(vector: Column) -> Column:
    """The length of a vector; -1 without one, or with a null in it."""
    return F.coalesce(F.when(F.exists(vector, lambda x: x.isNull()), -1).otherwise(F.size(vector)), F.lit(-1))


def _packed(rows: DataFrame, ident: str, vector: str, kind: list[str], size: int) -> DataFrame:
    """Rows of one scope, and of vectors of one length, as blocks: scope, ids, dim, x (the vectors), kinds (the distinct values of the
    columns `kind`, as JSON) and which each row has. dim is -1 without a vector or with a null in it."""
    element = "<f4" if rows.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    ident_type = rows.schema[ident].dataType.simpleString()
    flat = rows.select("scope", F.col(ident).alias("id"), dim(F.col(vector)).alias("dim"), F.col(vector).alias("v"), F.to_json(F.struct(*kind), {"ignoreNullFields": "false"}).alias("kind"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            d, kinds = last[1], t.column("kind").combine_chunks().dictionary_encode()
            x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(element) if d > 0 else np.zeros(0, element)
            one = lambda v, t: pa.array([v], t)
            return pa.RecordBatch.from_arrays(
                [one(last[0], pa.string()), one(t.column("id").to_pylist(), pa.list_(t.schema.field("id").type)), one(d, pa.int32()), one(x.tobytes(), pa.binary()), one(kinds.dictionary.to_pylist(), pa.list_(pa.string())), one(kinds.indices.to_numpy().astype("<i4").tobytes(), pa.binary())],
                ["scope", "ids", "dim", "x", "kinds", "kind"])

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            lo = 0
            while lo < len(keys):
                count = sum(b.num_rows for b in held)
                if held and (keys[lo] != last or count == size):
                    yield block()
                    held, count = [], 0
                last, hi = keys[lo], lo
                while hi < len(keys) and hi - lo < size - count and keys[hi] == last:
                    hi += 1
                held.append(batch.slice(lo, hi - lo))
                lo = hi
        if held:
            yield block()

    small_batches(rows.sparkSession)
    return flat.sortWithinPartitions("scope", "dim", "id").mapInArrow(pack, f"scope string, ids array<{ident_type}>, dim int, x binary, kinds array<string>, kind binary")


def unit_blocks(units: DataFrame) -> DataFrame:
    """Blocks of the units that ask for a scope, numbered; those that ask for all have a null scope."""
    each = units.withColumn("scope", F.explode_outer(F.array_distinct("scopes"))).where("scope IS NOT NULL OR size(scopes) = 0")
    return checkpoint(_packed(each, "unit", "qvec", ["types", "asked"], UNIT_ROWS).withColumn("n", F.monotonically_increasing_id()))


def row_blocks(memory: DataFrame) -> DataFrame:
    """Blocks of the rows of a scope, dealt out over parts."""
    rows = _packed(memory.withColumn("scope", F.col("scope_id")), "memory_id", "embedding", ["memory_type", "visibility"], MEMORY_ROWS)
    return rows.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int")).repartition("scope", "part")


def _passes(asked: str, row: str) -> bool:
    """The filters of `candidates`, on a unit's and a row's kind."""
    a, r = json.loads(asked), json.loads(row)
    kind, seen, types, wanted = r.get("memory_type"), r.get("visibility"), a.get("types"), a.get("asked")
    ok = types is not None and (not types or (kind is not None and kind in types))
    return ok and (not wanted or (seen is not None and any(v is not None and v in wanted for v in seen)))


def blocks_met(units: DataFrame, rows: DataFrame, unit_type, id_type, k: int, similarity: str, best: type[Best] | None = None) -> DataFrame:
    """unit_blocks, row_blocks -> unit, memory_id, score: of each task the first k of each unit. `best` scores a block of units, Best
    unless it is given."""
    if similarity not in vectors.SIMILARITIES:
        raise ValueError(f"unknown similarity {similarity!r}")
    best = best or Best
    parts = units.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sides = [F.col(f"q.{c}").alias(f"q_{c}") for c in ("n", *best.COLUMNS)] + [F.col(f"r.{c}").alias(f"r_{c}") for c in Best.COLUMNS]
    met = rows.alias("r").join(parts.where("scope IS NOT NULL").alias("q"), ["scope", "part"]).select(*sides)
    if best.OPEN and not units.where("scope IS NULL").isEmpty():  # every scope is asked for by units without one
        met = met.unionByName(rows.alias("r").join(parts.where("scope IS NULL").alias("q"), F.col("r.part") == F.col("q.part")).select(*sides))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Best] = {}
        for batch in batches:
            kinds = [batch.schema.field(c).type.value_type for c in ("q_ids", "r_ids")]
            for at in range(batch.num_rows):
                read = lambda side, columns: {c: batch.column(f"{side}_{c}")[at].as_py() for c in columns}  # noqa: B023, E731
                n = batch.column("q_n")[at].as_py()
                if n not in held:
                    if len(held) == HELD:
                        yield from held.pop(next(iter(held))).told(kinds)
                    held[n] = best(read("q", best.COLUMNS), k, similarity)
                held[n].add(read("r", Best.COLUMNS))
        for one in held.values():
            yield from one.told(kinds)

    return met.mapInArrow(meet, f"unit {unit_type.simpleString()}, memory_id {id_type.simpleString()}, score double")


class Best:
    """The first k rows of each unit of a block among the blocks of rows added."""

    #: What is read of a block, and whether units may ask for all scopes.
    COLUMNS, OPEN = ("ids", "dim", "x", "kinds", "kind"), True

    def __init__(self, block: dict, k: int, similarity: str):
        self.k, self.similarity, self.units, self.kinds = k, similarity, block["ids"], block["kinds"]
        self.kind, self.x, self.dim = np.frombuffer(block["kind"], "<i4"), self.matrix(block), block["dim"]
        self.at, self.score, self.ids = np.zeros(0, int), np.zeros(0), np.zeros(0, object)
        self.least = np.full(len(self.units), -np.inf)
        with np.errstate(all="ignore"):
            self.squares = self.ordered(self.x, self.x)
            self.unit, self.odd = self.scaled(self.x, self.squares)

    @staticmethod
    def matrix(block: dict) -> np.ndarray:
        n, dim = len(block["ids"]), max(block["dim"], 0)
        return np.frombuffer(block["x"], "<f8" if len(block["x"]) == 8 * n * dim else "<f4").astype(float).reshape(n, dim)

    @staticmethod
    def ordered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Dot products of rows, added up from left to right as columns' `vectors.dot` does."""
        out = np.zeros(len(a))
        for lo in range(0, len(a), 1 << 16):
            p = a[lo : lo + (1 << 16)] * b[lo : lo + (1 << 16)]
            for place in range(p.shape[1]):
                out[lo : lo + len(p)] += p[:, place]
        return out

    def similar(self, dots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Scores by dot products and squared lengths, as in `vectors`."""
        if self.similarity == "dot":
            return dots
        if self.similarity == "euclid":
            return -(a + b - 2 * dots) / 1.0
        eps = 1e-8 if self.similarity == "cosine_eps" else 0.0
        n = (np.sqrt(a) + eps) * (np.sqrt(b) + eps)
        return np.where(n == 0, 0.0, dots / np.where(n == 0, 1.0, n))

    def scaled(self, x: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors over their lengths as the cosine takes them, and which of them are too long or short, or not finite, for that."""
        length = np.sqrt(squares)
        odd = ~((length == 0) | ((length > 1e-100) & (length < 1e100)))
        n = length + (1e-8 if self.similarity == "cosine_eps" else 0.0)
        return x / np.where(odd | (n == 0), 1.0, n)[:, None], odd

    def near(self, rows: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """Scores up to rounding, inf where they may be off by more: one product for the cosine."""
        if not self.similarity.startswith("cosine"):
            s = self.similar(self.x @ rows.T, self.squares[:, None], squares[None, :])
            return np.where(np.isnan(s), np.inf, s)
        unit, odd = self.scaled(rows, squares)
        s = self.unit @ unit.T
        s[self.odd], s[:, odd] = np.inf, np.inf
        return s

    def add(self, block: dict) -> None:
        with np.errstate(all="ignore"):
            self._add(block)

    def _add(self, block: dict) -> None:
        ok, kind = np.array([[_passes(a, r) for r in block["kinds"]] for a in self.kinds]), np.frombuffer(block["kind"], "<i4")
        n, blank = len(block["ids"]), self.dim < 0 or self.dim != block["dim"]
        if blank:
            s, margin = np.zeros((len(self.units), n)), np.zeros((len(self.units), 1))
        else:
            rows = self.matrix(block)
            squares = self.ordered(rows, rows)
            s = self.near(rows, squares)
            size = np.ones((len(self.units), 1)) if self.similarity.startswith("cosine") else (np.sqrt(self.squares)[:, None] + np.sqrt(squares.max())) ** 2
            margin = 2 * 10.0**-PLACES + 1e-12 * size  # what rounding and another order of additions can be off
        least = self.least
        few = np.flatnonzero(np.isneginf(least))
        if len(few) and n > self.k:
            least = least.copy()
            known = ok[self.kind[few]][:, kind] & (s[few] < np.inf)
            least[few] = np.partition(np.where(known, s[few], -np.inf), n - self.k, 1)[:, n - self.k]
        bar = np.where(np.isfinite(margin), least[:, None] - margin, -np.inf)
        may = s >= bar
        low = np.flatnonzero(np.isneginf(bar[:, 0]))
        may[low] &= ok[self.kind[low]][:, kind]
        at, row = np.nonzero(may)
        fits = ok[self.kind[at], kind[row]]
        at, row = at[fits], row[fits]
        if not len(at):
            return
        score = np.zeros(len(at))
        if not blank:
            for lo in range(0, len(at), 1 << 16):
                i, j = at[lo : lo + (1 << 16)], row[lo : lo + (1 << 16)]
                score[lo : lo + len(i)] = self.similar(self.ordered(self.x[i], rows[j]), self.squares[i], squares[j])
            places = np.round(score, PLACES)
            score = np.where(np.isfinite(places), places, score) + 0.0
        ids = np.empty(n, object)
        ids[:] = block["ids"]
        self.keep(np.concatenate([self.at, at]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids[row]]))

    def keep(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """NaN is a score above all, and a null id comes first, as in Spark's order."""
        keys = (-score, ~np.isnan(score), at)
        order = np.lexsort(keys)
        a, b = order[:-1], order[1:]
        same = (at[a] == at[b]) & ((score[a] == score[b]) | (np.isnan(score[a]) & np.isnan(score[b])))
        if same.any():  # ids are looked at where scores are equal
            tied = order[np.append(same, False) | np.insert(same, 0, False)]
            place = {x: p for p, x in enumerate(sorted(set(ids[tied]), key=lambda x: (x is not None, x)))}
            nth = np.zeros(len(ids), int)
            nth[tied] = [place[x] for x in ids[tied]]
            order = np.lexsort((nth, *keys))
        at = at[order]
        nth = np.arange(len(at)) - np.searchsorted(at, np.arange(len(self.units)))[at]
        first = nth < self.k
        self.at, self.score, self.ids = at[first], score[order][first], ids[order][first]
        last = nth[first] == self.k - 1
        self.least[self.at[last]] = np.where(np.isnan(self.score[last]), np.inf, self.score[last])

    def told(self, types: list) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(self.at), 1 << 15):
            at = self.at[lo : lo + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array([self.units[i] for i in at], types[0]), pa.array(self.ids[lo : lo + (1 << 15)].tolist(), types[1]), pa.array(self.score[lo : lo + (1 << 15)])], ["unit", "memory_id", "score"])


def mean_vectors(members: DataFrame) -> DataFrame:
    """bucket, qvec -> bucket, qvec: the L2-normalised mean; a zero mean stays zero."""
    parts = members.select("bucket", F.posexplode("qvec").alias("i", "x")).groupBy("bucket", "i").agg((F.sum(F.col("x").cast("double")) / F.count(F.lit(1))).alias("x"))
    rows = parts.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("qvec"))
    return rows.withColumn("qvec", vectors.normalise(F.col("qvec")))


def bucket_bases(members: DataFrame, rank: int = 64) -> DataFrame:
    """bucket, member_ord, qvec (array) -> bucket, basis, lead, size: the span of a bucket's unit query vectors.

    The second moment M = sum of q q' has as many rows and columns as a vector has places, however many members a bucket
    has: each partition adds up its own, one task per bucket adds those. Its eigenvectors span the queries; values
    under 1e-6 of the largest are dropped, `rank` are kept at most. lead is the projection of the first member."""
    shape = "bucket string, moment binary, lead array<double>"

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moments: dict[str, np.ndarray] = {}
        leads: dict[str, list[float]] = {}
        for f in frames:
            q = np.array(f["qvec"].tolist(), float)
            norms = np.linalg.norm(q, axis=1) if len(f) else np.zeros(0)
            q = q / np.where(norms == 0, 1, norms)[:, None] if len(f) else q
            for name, at in f.groupby("bucket").indices.items():
                moments[name] = moments.get(name, 0) + q[at].T @ q[at]
                leads |= {name: q[k].tolist() for k in at if f["member_ord"].iloc[k] == 0}
        if moments:
            yield pd.DataFrame({"bucket": list(moments), "moment": [m.tobytes() for m in moments.values()], "lead": [leads.get(n) for n in moments]})

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        lead = next(np.array(x) for x in f["lead"] if x is not None)
        m = sum(np.frombuffer(x).reshape(len(lead), len(lead)) for x in f["moment"])
        values, u = np.linalg.eigh(m)
        keep = values > 1e-6 * max(values.max(), 1e-300)
        basis = u[:, keep][:, ::-1][:, :rank].T
        z = basis @ lead
        return pd.DataFrame([(f["bucket"].iloc[0], basis.tolist(), z.tolist(), float(np.linalg.norm(z)))], columns=["bucket", "basis", "lead", "size"])

    parts = members.select("bucket", "member_ord", "qvec").mapInPandas(add, shape)
    return parts.groupBy("bucket").applyInPandas(solve, "bucket string, basis array<array<double>>, lead array<double>, size double")


def pool(buckets: DataFrame, members: DataFrame, memory: DataFrame, as_of: Column, k: int = 50, rank: int = 64, mode: str = "parity") -> DataFrame:
    """bucket, memory_id, score, rank of each bucket's shared pool.

    buckets: bucket, scope, types, asked; members: bucket, member_ord, qvec. Two members compare the first min(rank, dim)
    coordinates, three or more the projections on their common span. `parity` ranks by the first member; `balanced` takes
    each row's best member."""
    live = memory.where(~policies.expired(F.col("created_at"), F.col("ttl"), as_of)).select("memory_id", "scope_id", "memory_type", "visibility", "embedding")
    # a null in a vector makes a score null and NaN makes it NaN, which both count as 0
    number = live.schema["embedding"].dataType.elementType
    live = live.withColumn("embedding", F.transform("embedding", lambda x: F.coalesce(x, F.lit(float("nan")).cast(number))))
    n = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    b = buckets.join(n, "bucket").select(F.col("bucket").alias("unit"), "scope", "types", "asked", "n")
    asks = F.to_json(F.struct("types", "asked"), {"ignoreNullFields": "false"})
    b = b.select("unit", "scope", F.array("unit").alias("ids"), F.array(asks).alias("kinds"), F.lit(rank).alias("places"), "n")
    who = (members if mode == "balanced" else members.where("member_ord = 0")).select(F.col("bucket").alias("unit"), "member_ord", "qvec")
    bases = bucket_bases(members.join(n.where("n >= 3"), "bucket"), rank).withColumnRenamed("bucket", "unit")
    # leads of a bucket, some at a time: unit, piece, leads
    def pieces(leads: DataFrame) -> DataFrame:
        return leads.groupBy("unit", F.floor(F.col("member_ord") / UNIT_ROWS).alias("piece")).agg(F.collect_list(F.struct("lead", "size")).alias("leads"))

    own = vectors.normalise(F.slice("qvec", 1, rank))
    small = pieces(who.join(b.where("n < 3").select("unit"), "unit").select("unit", "member_ord", own.alias("lead"), vectors.norm(own).alias("size")))
    small = small.withColumn("basis", F.lit(None).cast("array<array<double>>"))
    if mode == "balanced":
        bases = checkpoint(bases.select("unit", "basis"))
        onto = F.transform("basis", lambda x: vectors.dot(x, vectors.normalise(F.col("qvec"))))
        known = bases.join(who, "unit").select("unit", "member_ord", onto.alias("lead"))
        large = pieces(known.withColumn("size", vectors.norm(F.col("lead")))).join(bases, "unit")
    else:
        large = bases.select("unit", F.lit(0).cast("long").alias("piece"), F.array(F.struct("lead", "size")).alias("leads"), "basis")
    units = small.unionByName(large).join(b.drop("n"), "unit").withColumn("n", F.to_json(F.struct("unit", "piece")))
    found = blocks_met(units, row_blocks(live), units.schema["unit"].dataType, memory.schema["memory_id"].dataType, k, "cosine_eps", PoolBest)
    scored = found.groupBy("unit", "memory_id").agg(F.max("score").alias("score"))
    return ranked(scored, ["unit"], k).withColumnRenamed("unit", "bucket")


class PoolBest(Best):
    """The first k memories of a bucket by the best of its leads, among the blocks of rows added. Rows are projected on the bucket's
    basis, or cut to its first places without one."""

    COLUMNS, OPEN = ("ids", "kinds", "basis", "leads", "places"), False

    def __init__(self, block: dict, k: int, similarity: str):
        self.k, self.similarity, self.units, self.kinds, self.places = k, similarity, block["ids"], block["kinds"], block["places"]
        self.basis = None if block["basis"] is None else np.array(block["basis"], float)
        whole = [x for x in block["leads"] if x["lead"] is not None and x["size"] is not None and None not in x["lead"]]
        self.leads: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length
        for width in {len(x["lead"]) for x in whole}:
            same = [x for x in whole if len(x["lead"]) == width]
            self.leads[width] = np.array([x["lead"] for x in same], float).reshape(len(same), width), np.array([x["size"] for x in same], float)
        self.at, self.score, self.ids, self.least = np.zeros(0, int), np.zeros(0), np.zeros(0, object), -np.inf

    def best(self, dots: np.ndarray, size: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Leads by rows -> the best lead's score of each row; NaN is above all, what is not finite counts 0."""
        s = (dots / ((size[:, None] + 1e-8) * (z + 1e-8)[None, :])).max(0)
        return np.where(np.isfinite(s), s, 0.0)

    def exact(self, rows: np.ndarray, leads: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Scores, added up from left to right as columns' `vectors.dot` does."""
        z = rows if self.basis is None else np.zeros((len(rows), len(self.basis)))
        if self.basis is not None:
            for place in range(rows.shape[1]):
                z += rows[:, place, None] * self.basis[None, :, place]
        dots = np.zeros((len(leads), len(rows)))
        for place in range(z.shape[1]):
            dots += leads[:, place, None] * z[None, :, place]
        return np.round(self.best(dots, size, np.sqrt(self.ordered(z, z))), PLACES) + 0.0

    def _add(self, block: dict) -> None:
        ok = np.array([_passes(self.kinds[0], r) for r in block["kinds"]])[np.frombuffer(block["kind"], "<i4")]
        at = np.flatnonzero(ok)
        ids = np.empty(len(block["ids"]), object)
        ids[:] = block["ids"]
        rows = None if block["dim"] < 0 else self.matrix(block)
        if rows is not None and self.basis is None:
            rows = rows[:, : self.places]
        fits = rows is not None and (self.basis is None or self.basis.shape[1] == rows.shape[1])
        leads, size = self.leads.get(rows.shape[1] if self.basis is None else len(self.basis), (None, None)) if fits else (None, None)
        if leads is None:
            self.keep(at, np.zeros(len(at)), ids[at])
            return
        rows = rows[at]
        z = rows if self.basis is None else rows @ self.basis.T
        length = np.linalg.norm(z, axis=1)
        s = self.best(leads @ z.T, size, length)
        # what rounding and another order of additions can be off; of a row far from the span, little but that is left
        margin = 2 * 10.0**-PLACES + 1e-12 * (1 + np.linalg.norm(rows, axis=1) / (length + 1e-8))
        margin = np.where(np.isfinite(margin), margin, np.inf)
        least = self.least
        if np.isneginf(least) and len(at) > self.k and len(set(ids[at])) == len(at):
            least = np.partition(s - margin, len(at) - self.k)[len(at) - self.k]
        may = np.flatnonzero(s + margin >= least)
        for lo in range(0, len(may), UNIT_ROWS):
            i = may[lo : lo + UNIT_ROWS]
            self.keep(at[i], self.exact(rows[i], leads, size), ids[at[i]])

    def keep(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """A memory that is met twice has its better score; a row that can't be scored counts 0."""
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        place = {x: p for p, x in enumerate(sorted(set(ids), key=lambda x: (x is not None, x)))}
        order = np.lexsort((np.fromiter((place[x] for x in ids), int, len(ids)), -score))
        first = {}
        for o in order:
            if len(first) == self.k:
                break
            first.setdefault(ids[o], o)
        kept = np.fromiter(first.values(), int, len(first))
        self.at, self.score, self.ids = np.zeros(len(kept), int), score[kept], ids[kept]
        if len(kept) == self.k:
            self.least = self.score[-1]


#: Vectors of a block of queries, and of rows.
QUERY_BLOCK, ROW_BLOCK = 1024, 4096


def nearest(queries: DataFrame, rows: DataFrame, k: int, similarity: str = "cosine") -> DataFrame:
    """queries and rows: id long, vec array -> qid, id, score, rank: the first k rows of each query, all pairs scored.

    Both sides are packed to matrices; each block of rows meets each block of queries by an equi-join on the block's
    number, a matrix product scores the pairs, and only the first k of a query leave a block."""
    def pack(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, size):
                    part = batch.slice(lo, size)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                    yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().astype("<i8").tobytes()]), pa.array([x.tobytes()])], ["ids", "x"])

        return run

    def scaled(ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(ids, "<i8")
        x = np.frombuffer(x, "<f8").reshape(len(ids), -1)
        length = (x * x).sum(1)
        if similarity == "cosine":
            x = x / np.where(length == 0, 1, np.sqrt(length))[:, None]
        return ids, x, length

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qx, ri, rx in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                (qi, q, ql), (ri, r, rl) = scaled(qi, qx), scaled(ri, rx)
                s = q @ r.T
                if similarity == "euclid":
                    s = -(ql[:, None] + rl[None, :] - 2 * s)
                s = np.round(s, PLACES) + 0.0
                least = np.partition(s, max(0, len(ri) - k), 1)[:, max(0, len(ri) - k)]
                at, row = np.nonzero(s >= least[:, None])
                order = np.lexsort((ri[row], -s[at, row], at))
                at, row = at[order], row[order]
                keep = np.arange(len(at)) - np.searchsorted(at, np.arange(len(qi)))[at] < k
                at, row = at[keep], row[keep]
                yield pa.RecordBatch.from_arrays([pa.array(qi[at]), pa.array(ri[row]), pa.array(s[at, row])], ["qid", "id", "score"])

    q = checkpoint(queries.select("id", "vec").where("vec IS NOT NULL").mapInArrow(pack(QUERY_BLOCK), "ids binary, x binary").withColumn("n", F.monotonically_increasing_id()))
    blocks = q.select(F.col("n").alias("block"))
    r = rows.select("id", "vec").where("vec IS NOT NULL").mapInArrow(pack(ROW_BLOCK), "ids binary, x binary").withColumn("n", F.lit(1))
    numbers = blocks.agg(F.sort_array(F.collect_list("block")).alias("blocks")).withColumn("n", F.lit(1))  # one number for QUERY_BLOCK queries
    pairs = r.join(numbers, "n").select(F.explode("blocks").alias("n"), F.col("ids").alias("ri"), F.col("x").alias("rx")).join(q, "n").select(F.col("ids").alias("qi"), F.col("x").alias("qx"), "ri", "rx")
    return top_k(pairs.mapInArrow(score, "qid long, id long, score double"), ["qid"], k, [F.col("score").desc(), F.col("id")])


#: Words of all items that a broadcast may hold, and cells of a block of texts by items.
ITEM_WORDS, CELLS = 2_000_000, 4_000_000


def best_overlaps(texts_: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """texts_: id long, ws (distinct words); items: item_id long, ws -> item_id, id, hits, n (the item's words), rank: the k texts
    of each item that share most words with it, lower ids first. Texts without a shared word are none.

    An index of the items' words goes to every task, which counts whole texts and sends the first k of each item only.
    Beyond ITEM_WORDS words the items are dealt out by hash, a part of the index at a time, so that no index outgrows it."""
    items = checkpoint(items.select("item_id", "ws"))
    total = items.agg(F.coalesce(F.sum(F.size("ws")), F.lit(0))).first()[0]
    parts = -(-max(total, 1) // ITEM_WORDS)
    sc = items.sparkSession.sparkContext
    out = None
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        index: dict[str, list[int]] = {}
        for at, r in enumerate(rows):
            for w in r["ws"]:
                index.setdefault(w, []).append(at)
        shared = sc.broadcast(({w: np.array(x, np.int32) for w, x in index.items()}, np.array([r["item_id"] for r in rows], np.int64), np.array([len(r["ws"]) for r in rows], np.int64)))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, ids, sizes = shared.value
            if not len(ids):
                return
            best_id, best = np.zeros((0, len(ids)), np.int64), np.zeros((0, len(ids)), np.int64)
            step = max(1, CELLS // len(ids))
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    piece = batch.slice(lo, step)
                    hits = np.zeros((piece.num_rows, len(ids)), np.int64)
                    for row, ws in enumerate(piece.column(1).to_pylist()):
                        found = [x for w in ws or () if (x := index.get(w)) is not None]
                        if found:
                            hits[row] = np.bincount(np.concatenate(found), minlength=len(ids))
                    both = np.concatenate([best, hits])
                    who = np.concatenate([best_id, np.broadcast_to(piece.column(0).to_numpy()[:, None], hits.shape)])
                    order = np.lexsort((who, -both), axis=0)[:k]
                    best, best_id = np.take_along_axis(both, order, 0), np.take_along_axis(who, order, 0)
            at, item = np.nonzero(best > 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[item]), pa.array(best_id[at, item]), pa.array(best[at, item]), pa.array(sizes[item])], ["item_id", "id", "hits", "n"])

        one = texts_.select("id", "ws").mapInArrow(count, "item_id long, id long, hits long, n long")
        out = one if out is None else out.unionByName(one)
    return top_k(out, ["item_id"], k, [F.col("hits").desc(), F.col("id")])


def numbered(rows: DataFrame, by: list[str], order: list, column: str = "at") -> DataFrame:
    """Adds the place of each row in its group, from 1, and `n`, the group's size, without bringing a group into one task: rows
    are sorted by ranges, and ranges are numbered behind those before them."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = [*by, *order]
    dealt = checkpoint(rows.repartitionByRange(ranges, *line).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_k"))
    group = Window.partitionBy(*by)
    sizes = sizes.select(*by, "_part", F.coalesce(F.sum("_k").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_k").over(group).alias("n"))
    at = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return dealt.withColumn(column, at).join(sizes, [*by, "_part"]).withColumn(column, (F.col(column) + F.col("_before")).cast("int")).drop("_part", "_before")


def random_projection(vectors_: np.ndarray, rank: int, width: int, keep: float = 1.0, init: str = "gauss", seed: int = 0) -> np.ndarray:
    """A fixed projection for `transform(embedding)`: a masked random map of a sample of query vectors, cut by SVD."""
    rng = np.random.default_rng(seed)
    dim = vectors_.shape[1]
    scale = np.sqrt(6 / (width + dim))
    w = rng.uniform(-scale, scale, (width, dim)) if init == "xavier" else rng.standard_normal((width, dim))
    w = w * (rng.random(w.shape) < keep)
    _, _, v = np.linalg.svd(w @ vectors_.T @ vectors_ / len(vectors_), full_matrices=False)
    return v[:rank]


def project(rows: DataFrame, basis: np.ndarray, column: str = "embedding", out: str = "projected") -> DataFrame:
    cols = [vectors.dot(F.col(column), F.array(*[F.lit(float(x)) for x in b])) for b in basis]
    return rows.withColumn(out, F.array(*cols))
