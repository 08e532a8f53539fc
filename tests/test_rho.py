"""Overlaps of solvers by bit sets: plain Python on odd graphs, and a long conversation in a bounded time."""

import random
import time
from itertools import combinations

import pytest

from tessera.operators import graphs


def plain(nodes, edges):
    solvers = {n for n, t in nodes if t == "SOLVER"}
    up = {n: {s for s, d in edges if d == n} for n in {x for e in edges for x in e} | solvers}
    while True:
        more = {n: up[n].union(*(up[p] for p in up[n])) for n in up}
        if more == up:
            break
        up = more
    held = {n: (up[n] & solvers) | {n, "#plan"} for n in solvers}
    pairs = [len(held[a] & held[b]) / len(held[a] | held[b]) for a, b in combinations(sorted(solvers), 2)]
    return 0.0 if not solvers else 1.0 if len(solvers) == 1 else sum(pairs) / len(pairs)


@pytest.mark.parametrize("block", [3, 1024])
def test_equals_plain(spark, monkeypatch, block):
    r = random.Random(block)
    nodes, edges = {}, {}
    for g in range(12):
        n = r.choice([1, 2, 3, 9, 15])
        nodes[g] = [(f"n{k}", "PLANNER" if k == 0 else r.choice(["SOLVER", "SOLVER", "SOLVER", "VERIFIER"])) for k in range(n + 1)]
        some = [(a, b) for a, b in combinations([x for x, _ in nodes[g]], 2) if r.random() < 0.25]
        edges[g] = some + [(b, a) for a, b in some if g % 3 == 0 and r.random() < 0.2] + some[:2]
    nodes[20], edges[20] = [("p", "PLANNER")], []
    nodes[21], edges[21] = [("a", "SOLVER"), ("b", "SOLVER")], [("a", "a"), ("x", "b")]
    flat = lambda d: [(g, *x) for g, xs in d.items() for x in xs]
    n, e = spark.createDataFrame(flat(nodes), "g int, node string, node_type string"), spark.createDataFrame(flat(edges), "g int, src string, dst string")
    monkeypatch.setattr(graphs.overlaps, "__defaults__", (block,))
    got = {x.g: x.rho for x in graphs.rho_v3(n, e, ["g"]).collect()}
    assert got == pytest.approx({g: plain(nodes[g], edges[g]) for g in nodes}, abs=1e-4)


def test_long_conversation(spark):
    keys = spark.createDataFrame([("LINEAR", 5000), ("FORK", 5000)], "graph_type string, hops int")
    nodes, edges = graphs.templates_of(keys)
    began = time.time()
    got = {r.graph_type: r.rho for r in graphs.rho_v3(nodes, edges, ["graph_type", "hops"]).collect()}
    n = 5000
    assert got["LINEAR"] == pytest.approx(sum(sum(range(2, j + 1)) / (j + 1) for j in range(2, n + 1)) / (n * (n - 1) / 2), abs=1e-4)
    assert 0 < got["FORK"] <= got["LINEAR"] + 0.01 and time.time() - began < 120
