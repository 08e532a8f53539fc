"""Blocks of very long and very short vectors against all pairs."""

import json

import numpy as np
import pytest

from tessera.operators.search import PLACES, Best


def block(ids, x, kinds, kind):
    return {"ids": ids, "dim": x.shape[1], "x": x.tobytes(), "kinds": kinds, "kind": np.array(kind, "<i4").tobytes()}


@pytest.mark.parametrize("similarity", ["cosine", "cosine_eps"])
def test_lengths(similarity):
    rng = np.random.default_rng(2)
    scales = np.array([1, 1, 1, 1, 0, 1e-161, 1e-120, 1e120, 1e200, np.nan, np.inf])
    x = rng.integers(-2, 3, (300, 4)) * rng.choice(scales, (300, 1))
    q = rng.integers(-2, 3, (22, 4)) * np.repeat(scales, 2)[:, None]
    asks, shows = [json.dumps({"types": ["x"], "asked": None}), json.dumps({"types": [], "asked": ["u"]})], [json.dumps({"memory_type": t, "visibility": v}) for t in "xy" for v in (["u"], [])]
    asked, shown, k = rng.integers(0, 2, 22), rng.integers(0, 4, 300), 6
    ids = [f"m{i:03d}" for i in rng.permutation(300)]
    best = Best(block([f"u{i}" for i in range(22)], q, asks, asked), k, similarity)
    for lo in range(0, 300, 60):
        best.add(block(ids[lo : lo + 60], x[lo : lo + 60], shows, shown[lo : lo + 60]))
    for u in range(22):
        with np.errstate(all="ignore"):
            s = best.similar(Best.ordered(np.repeat(q[u : u + 1], 300, 0), x), Best.ordered(q[u : u + 1], q[u : u + 1]), Best.ordered(x, x))
            s = np.where(np.isfinite(s), np.round(s, PLACES), s) + 0.0
        ok = [shown[i] < 2 if asked[u] == 0 else shown[i] % 2 == 0 for i in range(300)]
        want = sorted((i for i in range(300) if ok[i]), key=lambda i: (not np.isnan(s[i]), 0 if np.isnan(s[i]) else -s[i], ids[i]))[:k]
        got = best.at == u
        assert best.ids[got].tolist() == [ids[i] for i in want]
        assert np.array_equal(best.score[got], s[want], equal_nan=True)
