"""Reasoning graphs: templates as a dimension table, closure, checks, overlap of accessible artifacts, subset labels."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint

GRAPH_TYPES = ("LINEAR", "FORK", "MERGE", "FORK_MERGE", "INDEPENDENT", "POLICY_ISOLATED")
REASONING = {"GoT": None, "CoT": "LINEAR", "ToT": "FORK"}
NODE, EDGE = ["node", "node_type", "hop"], ["src", "dst", "edge_type"]
S1_ABOVE, S2_ABOVE = 0.6, 0.4
#: Solvers of a block of overlaps.
BLOCK = 1024


def template(kind: str, hops: int) -> tuple[list[tuple], list[tuple]]:
    """Nodes (id, type, hop) and edges (from, to, type) of one template. A chain is grown from a root; branches are the
    lists of roots that a stage hangs on."""
    nodes: list[tuple] = [("planner", "PLANNER", None)]
    edges: list[tuple] = []

    def solver(name: str, hop: int, *parents: str) -> str:
        nodes.append((f"solver_{name}", "SOLVER", hop))
        edges.extend((p, f"solver_{name}", "AGGREGATES" if len(parents) > 1 else "DEPENDS_ON") for p in parents)
        return f"solver_{name}"

    def grow(root: str, lo: int, suffix: str = "") -> None:
        for k in range(lo, hops + 1):
            root = solver(f"{k}{suffix}", k, root)

    hops = max(hops, 3 if kind == "MERGE" else 2)
    if kind in ("LINEAR", "POLICY_ISOLATED"):
        grow("planner", 1)
    elif kind == "INDEPENDENT":
        grow("planner", 1, "a")
        grow("planner", 1, "b")
    elif kind == "MERGE":
        grow(solver("3", 3, solver("1", 1, "planner"), solver("2", 2, "planner")), 4)
    elif kind in ("FORK", "FORK_MERGE"):
        at = 1 if hops == 2 else 2
        root = "planner" if hops == 2 else solver("1", 1, "planner")
        sides = [solver(f"{at}{x}", at, root) for x in "ab"]
        if kind == "FORK":
            grow(sides[0], 3)
        else:
            grow(solver(str(at + 1), at + 1, *sides), at + 2)
    else:
        raise ValueError(f"unknown graph type {kind!r}")
    if kind == "POLICY_ISOLATED":
        nodes.append(("verifier", "VERIFIER", None))
    return nodes, edges


def templates(spark: SparkSession, kinds=GRAPH_TYPES, hops=(2, 3, 4, 5)) -> tuple[DataFrame, DataFrame]:
    """nodes: graph_type, hops, node, node_type, hop, node_ord; edges: graph_type, hops, src, dst, edge_type."""
    n = [(k, h, *x, i) for k in kinds for h in hops for i, x in enumerate(template(k, h)[0])]
    e = [(k, h, *x) for k in kinds for h in hops for x in template(k, h)[1]]
    return spark.createDataFrame(n, "graph_type string, hops int, node string, node_type string, hop int, node_ord int"), spark.createDataFrame(e, "graph_type string, hops int, src string, dst string, edge_type string")


def templates_of(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for the distinct (graph_type, hops) of a table, without a limit to hops; executors draw them."""

    def draw(part: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for k, h in zip(batch["graph_type"], batch["hops"], strict=True):
                    rows = pd.DataFrame(template(k, h)[part], columns=NODE if part == 0 else EDGE).assign(graph_type=k, hops=h)
                    yield rows.astype({"hop": "Int32"}).assign(node_ord=range(len(rows))) if part == 0 else rows

        return run

    keys = checkpoint(keys.select("graph_type", "hops").distinct())
    return keys.mapInPandas(draw(0), "graph_type string, hops int, node string, node_type string, hop int, node_ord int"), keys.mapInPandas(draw(1), "graph_type string, hops int, src string, dst string, edge_type string")


def ancestors(edges: DataFrame, key: list[str]) -> DataFrame:
    """key, node, ancestor, distance (least): the transitive closure; a node is its own ancestor on a cycle only. A round
    appends all paths to those of exactly `step` edges, so it finds up to twice as many; it ends where no path is that
    long, on cycles too. Each round is a stored table."""
    reach = checkpoint(edges.select(*key, F.col("dst").alias("node"), F.col("src").alias("ancestor"), F.lit(1).alias("distance")).distinct())
    step = 1
    while not (far := reach.where(F.col("distance") == step)).isEmpty():
        longer = far.drop("distance").withColumnRenamed("ancestor", "via").join(reach.withColumnRenamed("node", "via"), [*key, "via"]).select(*key, "node", "ancestor", (F.col("distance") + step).alias("distance"))
        reach = checkpoint(reach.unionByName(longer).groupBy(*key, "node", "ancestor").agg(F.min("distance").alias("distance")))
        step *= 2
    return reach


def walks(edges: DataFrame, key: list[str]) -> tuple[list[tuple[int, DataFrame]], DataFrame]:
    """[(step, pairs)] and cyclic. pairs: key, node, ancestor joined by a walk of exactly 1, 2, 4, ... edges, as long as
    there are any; cyclic: keys of graphs with a cycle, which are those with a walk of as many edges as they have nodes."""
    ends = edges.select(*key, F.col("dst").alias("node")).union(edges.select(*key, F.col("src").alias("node"))).distinct()
    size = ends.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    pairs = checkpoint(edges.select(*key, F.col("dst").alias("node"), F.col("src").alias("ancestor")).distinct().join(size, key))
    found, cyclic, step = [], pairs.where(F.col("size") <= 1).select(*key), 1
    while not (pairs := pairs.where(F.col("size") > step)).isEmpty():
        found.append((step, pairs.drop("size")))
        on = pairs.drop("size").toDF(*key, "via", "ancestor")
        pairs, step = checkpoint(pairs.withColumnRenamed("ancestor", "via").join(on, [*key, "via"]).select(*key, "node", "ancestor", "size").distinct()), step * 2
        cyclic = cyclic.union(pairs.where(F.col("size") <= step).select(*key))
    return found, cyclic.distinct()


def wired(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """nodes with parents and children: those that a node names itself, then those that edges add; each once, in that order."""
    empty = F.array().cast("array<string>")
    side = lambda of, other, name: edges.groupBy(*key, F.col(of).alias("node")).agg(F.sort_array(F.collect_set(other)).alias(name))
    rows = nodes.join(side("dst", "src", "_in"), [*key, "node"], "left").join(side("src", "dst", "_out"), [*key, "node"], "left")
    own = lambda c: F.coalesce(F.col(c), empty) if c in nodes.columns else empty
    return rows.withColumns({"parents": F.array_union(own("parents"), F.coalesce("_in", empty)), "children": F.array_union(own("children"), F.coalesce("_out", empty))}).drop("_in", "_out")


def cached_rho(keys: DataFrame, path: str) -> DataFrame:
    """graph_type, hops, rho of the keys, kept in a table at path: what it has is read, what it lacks is worked out and added."""
    spark, template = keys.sparkSession, ["graph_type", "hops"]
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    have = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    todo = keys.select(*template).distinct()
    if have:
        todo = todo.join(spark.read.parquet(path).select(*template), template, "left_anti")
    todo = checkpoint(todo)
    if not have or not todo.isEmpty():
        nodes, edges = (checkpoint(t) for t in templates_of(todo))
        rho_v3(nodes, edges, template).select(*template, F.col("rho").cast("double").alias("rho")).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(keys.select(*template).distinct(), template, "left_semi")


def check(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """key, is_dag, orphan_solvers, bound_verifiers of each graph."""
    cyclic = walks(edges, key)[1].withColumn("cyclic", F.lit(True))
    parents = edges.groupBy(*key, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("parents"))
    touched = edges.select(*key, F.col("dst").alias("node")).union(edges.select(*key, F.col("src").alias("node"))).distinct().withColumn("touched", F.lit(True))
    per = nodes.join(parents, [*key, "node"], "left").join(touched, [*key, "node"], "left")
    per = per.groupBy(*key).agg(F.count_if((F.col("node_type") == "SOLVER") & F.col("parents").isNull()).alias("orphan_solvers"), F.count_if((F.col("node_type") == "VERIFIER") & F.col("touched").isNotNull()).alias("bound_verifiers"))
    return per.join(cyclic, key, "left").select(*key, F.col("cyclic").isNull().alias("is_dag"), "orphan_solvers", "bound_verifiers")


def levels(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """key, node, level: the longest path from a root; null in graphs with cycles, which have none."""
    found, cyclic = walks(edges, key)
    ends = edges.select(*key, F.col("dst").alias("node")).union(edges.select(*key, F.col("src").alias("node"))).distinct()
    far = ends.join(cyclic, key, "left_anti").withColumn("far", F.lit(0))
    for step, pairs in found:  # far: the longest path of less than step edges
        up = pairs.join(far.withColumnRenamed("node", "ancestor"), [*key, "ancestor"]).groupBy(*key, "node").agg((F.max("far") + step).alias("far"))
        far = checkpoint(far.unionByName(up).groupBy(*key, "node").agg(F.max("far").alias("far")))
    rows = nodes.join(far, [*key, "node"], "left").join(cyclic.withColumn("cyclic", F.lit(True)), key, "left")
    return rows.select(*key, "node", F.when(F.col("cyclic").isNull(), F.coalesce("far", F.lit(0))).alias("level"))


def _held(solvers: list[str], edges: list[tuple[str, str]]) -> np.ndarray:
    """Of each solver, a row of bits: itself and the solvers it can be reached from, over nodes of any type; on cycles, its own
    bit is set anyway."""
    bit = {name: 1 << k for k, name in enumerate(solvers)}
    parents: dict[str, set[str]] = {}
    children: dict[str, list[str]] = {}
    for src, dst in set(edges):
        parents.setdefault(dst, set()).add(src)
        children.setdefault(src, []).append(dst)
    waits = {x: len(parents.get(x, ())) for x in {*bit, *parents, *children}}
    have = dict.fromkeys(waits, 0)
    gather = lambda x: reduce(lambda acc, p: acc | have[p] | bit.get(p, 0), parents.get(x, ()), 0)
    ready, left = [x for x, n in waits.items() if not n], set(waits)
    while ready:
        x = ready.pop()
        left.discard(x)
        have[x] = gather(x)
        for y in children.get(x, ()):
            waits[y] -= 1
            if not waits[y]:
                ready.append(y)
    while left and any(have[x] != (new := gather(x)) and have.update({x: new}) is None for x in left):  # cycles, and what hangs on them
        pass
    wide = -(-max(len(solvers), 1) // 64) * 8
    rows = b"".join((have[x] | bit[x]).to_bytes(wide, "little") for x in solvers)
    return np.frombuffer(rows, np.uint64).reshape(len(solvers), wide // 8)


def overlaps(nodes: DataFrame, edges: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """key, total, pairs: the sum of the overlaps of all pairs of solvers, and their number, of graphs with two solvers at least.

    Ancestors are bit sets, so a graph's closure never becomes rows. A task gets a graph's nodes and edges and a block of its solvers, whose
    rows of bits it compares with those behind them, so that a long graph is shared by many tasks."""
    solvers = nodes.where("node_type = 'SOLVER'").select(*key, F.col("node").alias("a"), F.lit(None).cast("string").alias("b")).distinct()
    size = solvers.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    size = checkpoint(size.select(*key, F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int"))).alias("_block")))
    rows = solvers.unionByName(edges.select(*key, F.col("src").alias("a"), F.col("dst").alias("b"))).join(size, key)

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        alone = f["b"].isna()
        names = sorted(f.loc[alone, "a"])
        bits = _held(names, list(zip(f.loc[~alone, "a"], f.loc[~alone, "b"], strict=True)))
        k = np.bitwise_count(bits).sum(1, dtype=np.int64)
        total, pairs, lo = 0.0, 0, int(f["_block"].iloc[0]) * block
        for i in range(lo, min(lo + block, len(names))):
            both = np.bitwise_count(bits[i] & bits[i + 1 :]).sum(1, dtype=np.int64)
            total += float(((both + 1) / (k[i] + k[i + 1 :] - both + 1)).sum())  # the plan is shared by all
            pairs += len(both)
        return f.iloc[:1][key].assign(total=total, pairs=pairs)

    kinds = dict(rows.dtypes)
    parts = rows.groupBy(*key, "_block").applyInPandas(compare, ", ".join([*(f"`{c}` {kinds[c]}" for c in key), "total double", "pairs long"]))
    return parts.groupBy(*key).agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))


def rho_v3(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """key, rho: mean overlap, over solver pairs, of {plan} and the conclusions of the solver and its ancestors. One
    solver: 1; none: 0."""
    mean = overlaps(nodes, edges, key).select(*key, F.bround(F.col("total") / F.col("pairs"), 4).alias("mean"))
    n = nodes.groupBy(*key).agg(F.count_if(F.col("node_type") == "SOLVER").alias("solvers"))
    return n.join(mean, key, "left").select(*key, F.when(F.col("solvers") == 0, 0.0).when(F.col("solvers") == 1, 1.0).otherwise(F.col("mean")).alias("rho"))


def rho_static(access: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """access: key, node, memory_id that a solver can see -> key, rho: what all solvers see, over what any sees."""
    n = nodes.groupBy(*key).agg(F.count_if(F.col("node_type") == "SOLVER").alias("solvers"))
    per = access.groupBy(*key, "memory_id").agg(F.count_distinct("node").alias("seen")).join(n, key)
    r = per.groupBy(*key).agg((F.count_if(F.col("seen") == F.col("solvers")) / F.count(F.lit(1))).alias("r"))
    return n.join(r, key, "left").select(*key, F.bround(F.coalesce("r", F.lit(0.0)), 4).alias("rho"))


def label(rho: Column) -> Column:
    return F.when(rho > S1_ABOVE, "S1").when(rho > S2_ABOVE, "S2").otherwise("S3")
