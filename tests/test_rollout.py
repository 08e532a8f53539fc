"""Rollouts against plain Python: order, failing writers, cycles, templates of graphs."""

import hashlib

import pytest

from tessera.operators import graphs, rollout


def writer():
    def write(rows):  # not of this module's names, which workers can't import
        assert len(rows) <= 5
        if any(r["node"].startswith("bad") for r in rows):
            raise RuntimeError("down")
        return [None if r["node"].startswith("mute") else hashlib.md5("|".join([r["prompt"] or "", *r["parents"]]).encode()).hexdigest() for r in rows]

    return write


def plain(nodes, edges):
    out, text = [], {}
    for ep in {n[0] for n in nodes}:
        own = {n[1]: n for n in nodes if n[0] == ep}
        up = {x: sorted({s for e, s, d in edges if e == ep and d == x and s in own}, key=lambda s: (own[s][2], s)) for x in own}
        left, at = set(own), 0
        level = {}
        while ready := {x for x in left if not any(s in left for s in up[x])}:
            for x in ready:
                level[x] = max((level[s] + 1 for s in up[x]), default=0)
                seen = [text[ep, s] for s in up[x]]
                fails = x.startswith(("bad", "mute"))
                text[ep, x] = (own[x][4] or "") if fails else hashlib.md5("|".join([own[x][3] or "", *seen]).encode()).hexdigest()
                out.append((ep, x, level[x], len(seen), text[ep, x], "template" if fails else "model"))
            left -= ready
            at += 1
        if left:
            out = [r for r in out if r[0] != ep] + [(ep, x, None, 0, own[x][4] or "", "template") for x in own]
    return sorted(out, key=repr)


@pytest.fixture
def world():
    nodes, edges = [], []
    for k, kind in enumerate(graphs.GRAPH_TYPES):
        n, e = graphs.template(kind, 5)
        nodes += [(k, name, place, f"p{k}{name}", f"t{name}") for place, (name, _, _) in enumerate(n)]
        edges += [(k, s, d) for s, d, _ in e]
    nodes += [(50, x, i, x, None) for i, x in enumerate(("a", "bad1", "mute1", "b", "bad2", "c", "d", "e"))]
    edges += [(50, "a", "bad1"), (50, "a", "bad1"), (50, "bad1", "b"), (50, "mute1", "b"), (50, "b", "c"), (50, "a", "c"), (50, "nowhere", "c"), (50, "c", "nowhere")]
    nodes += [(60, "x", 0, "x", "tx"), (60, "y", 1, None, "ty"), (60, "z", 2, "z", "tz"), (70, "alone", 0, None, None)]
    edges += [(60, "x", "y"), (60, "y", "x"), (60, "y", "z")]
    return nodes, edges


def test_equals_plain(spark, world):
    nodes, edges = world
    n = spark.createDataFrame(nodes, "ep long, node string, place int, prompt string, template string").repartition(3)
    e = spark.createDataFrame(edges, "ep long, src string, dst string")
    got = sorted((tuple(r) for r in rollout.rollout(n, e, ["ep"], writer(), batch=5).collect()), key=repr)
    assert got == plain(nodes, [x for x in edges if "nowhere" not in x])


def test_empty(spark, world):
    n = spark.createDataFrame([], "ep long, node string, place int, prompt string, template string")
    e = spark.createDataFrame([], "ep long, src string, dst string")
    assert rollout.rollout(n, e, ["ep"], writer()).count() == 0
