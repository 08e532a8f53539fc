"""Product codes against plain Python, and balls against comparing all entries."""

import hashlib
import math
import random

import numpy as np
import pytest

from tessera.llm import vector_codes as V


def plain(rows, parts=16, entries=64, rounds=2):
    """rows: id, vector, label -> what compressed() gives, by whole-number Python."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    coded = [r for r in kept if len(r[1]) == width and all(abs(x) < V.RANGE for x in r[1])]
    size = width // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[list(cut(r[1], p)) for r in coded[:entries]] for p in range(parts)]
    best = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v, _ in coded:
                held.setdefault(best(v, p)[1], []).append(cut(v, p))
            for e, own in held.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, total = [], {}
    for r in kept:
        got = [best(r[1], p) for p in range(parts)] if r in coded else None
        error = sum(d for d, _ in got) if got else None
        out.append((r[0], "".join(f"{e:02x}" for _, e in got) if got else None, error, r[2]))
        if got:
            total[r[2]] = total.get(r[2], 0) + error
    return sorted(((i, code, error, total.get(lab), sha) for i, code, error, lab in out), key=repr)


def vectors(n=400, width=32, seed=2, spread=0.01):
    r = random.Random(seed)
    centres = [[r.uniform(-0.3, 0.3) for _ in range(width)] for _ in range(30)]
    f32 = lambda x: float(np.float32(x))
    rows = [(k, [f32(x + r.gauss(0, spread)) for x in r.choice(centres)], r.choice([0, 0, 0, 1, 2, None])) for k in range(n)]
    same = rows[7][1]
    rows += [(n + k, same, 0) for k in range(100)] + [(3, rows[3][1], 1), (3, rows[4][1], 1), (None, rows[5][1], None)]
    bad = [None, [None] * width, [float("nan")] * width, [float("inf")] + [0.0] * (width - 1), same[:-1] + [float("-inf")]]
    rows += [(2000 + k, v, k) for k, v in enumerate(bad)]
    rows += [(3000, [0.0] * width, None), (3001, [-0.0] * width, 9), (3002, same[:16], 9), (3003, [], 10), (3004, [3e5] + same[1:], 9), (3005, [1000.0] * width, 9), (3006, [-3e38] * width, 9)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "width", "spread", "entries"), [(400, 32, 0.01, 64), (300, 16, 0.2, 64), (20, 32, 0.1, 64), (300, 32, 0.05, 1), (300, 48, 0.02, 200)])
def test_equals_plain(spark, n, width, spread, entries):
    rows = vectors(n, width, n, spread)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, code int").repartition(3)
    got = V.compressed(df, entries=entries)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, entries=entries)


def test_many_labels(spark, monkeypatch):
    rows = vectors(200, 32)
    monkeypatch.setattr(V, "LABELS", 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted((tuple(r) for r in V.compressed(df, rounds=1).collect()), key=repr) == plain(rows, rounds=1)


def test_nothing_to_code(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert V.compressed(spark.createDataFrame([], schema)).count() == 0
    assert V.compressed(spark.createDataFrame([(1, None, 1), (2, [None], 1)], schema)).count() == 0
    odd = V.compressed(spark.createDataFrame([(1, [0.5] * 5, 1), (2, [], 1)], schema)).collect()
    assert [(r.code, r.error, r.label_error) for r in odd] == [(None, None, None)] * 2


@pytest.mark.parametrize("spread", [3, 40, 400])
def test_balls_equal_all_entries(spread):
    r = np.random.default_rng(spread)
    c = r.integers(-300, 300, (2, 64, 4))
    x = c[0][r.integers(0, 64, 5000)] + r.integers(-spread, spread + 1, (5000, 4))
    x[:63] = (c[0][:-1] + c[0][1:]) // 2  # near ties
    x[63:126] = c[0][:-1]
    code, d = V.Book(c).nearest(x, 0)
    radius = np.zeros((2, 64), np.int64)
    np.maximum.at(radius[0], code, d)
    for moved in (0, 1, 5, 60):
        new = c.copy()
        new[0, :moved] += r.integers(-9, 10, (moved, 4))
        book = V.Book(new, c, radius)
        got, want = book.again(x, 0, code, d), V.Book(new).nearest(x, 0)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
        if moved == 0:
            assert book.still.all()
        elif moved == 1 and spread == 3:
            assert 0 < book.still[0].sum() < 64 and book.reach[0].mean() < 30
