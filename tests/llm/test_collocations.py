"""Collocations against plain Python, and the stored graphs by themselves."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import _ranges as R
from tessera.llm import _words as W
from tessera.llm import collocations as C


def corpus():
    r = random.Random(5)
    vocab = [f"w{k}" for k in range(12)] + ["Été", "日本", "A", "B", "x\x1fy"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", " ", " ", "  ", "\t", "\n", ". ", ",", "!", "\x0b"]) for _ in range(n))
    langs = ["en", "de", None, "und", "", "fr"]
    rows = [(text(r.randint(0, 80)), langs[k % 6] if k % 3 else "en") for k in range(120)]
    copy = text(60)
    rows += [(copy, "en")] * 40 + [("a a a a a a a a a a a a a", "fr"), ("one", "fr"), ("one two", "fr"), ("...,,,\n", "fr"), ("", "en"), (None, "en"), (" \t", None), (text(4000), "de")]
    return rows


def plain(rows, shortest=2, longest=3, least=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[k : k + m]) for k in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        whole = {p: a for p, a in c.items() if len(p) >= shortest and a >= least}
        longer = Counter()
        for p, a in whole.items():
            for m in range(shortest, len(p)):
                for k in range(len(p) - m + 1):
                    longer[p[k : k + m]] = max(longer[p[k : k + m]], a)
        found = []
        for p, a in whole.items():
            if p in longer and 100 * longer[p] >= share * a:
                continue
            cuts = [(1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            found.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        found.sort()
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(found[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("run", "shortest", "longest", "least", "top"), [(1 << 20, 2, 3, 10, 2000), (50, 2, 3, 10, 7), (300, 2, 5, 6, 2000), (200, 3, 4, 3, 50), (100, 2, 2, 10, 2000)])
def test_equals_plain(spark, monkeypatch, run, shortest, longest, least, top):
    rows = corpus()
    monkeypatch.setattr(C, "RUN", run)
    df = spark.createDataFrame([(t, x, 1) for t, x in rows], "text string, lang string, phrase int").repartition(3)
    got = C.collocations(df, shortest=shortest, longest=longest, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(x) for x in got.collect()) == plain(rows, shortest, longest, least, top=top)


def test_empty(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert C.collocations(df).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_counts_past_64_bits(spark):
    big = 10**12
    grams = [("en", 1, "a", 3 * big), ("en", 1, "b", 2 * big), ("en", 2, "a b", big + 1)]
    (row,) = C.scored(spark.createDataFrame(grams, "lang string, m int, phrase string, f long")).collect()
    assert row.score == 10**6 * (big + 1) ** 2 // (6 * big * big)


def test_copies_cost_a_weight():
    """Unary paths are folded: forty copies of a text take the room of one, and its inner nodes need no sum."""
    text = " ".join(f"v{k}" for k in range(500))
    sizes, rows = [], []
    for copies in (1, 40):
        run = C.Run()
        for b in W.blocks(pa.array([text] * copies), separators=C.BETWEEN):
            run.add(b, ["en"] * len(b))
        row = run.graph(0, 3)
        rows.append(row)
        sizes.append(sum(len(x) for x in row[3:]))
    assert sizes[0] == sizes[1]
    g = C.Graph(tuple(rows[1][k] for k in (1, *range(3, 13))), 3)
    assert len(R.unpack(rows[1][8])) == 1 and set(g.weight.tolist()) == {40}
    keys, n = g.counts()
    assert len(np.unique(keys)) == len(keys) == 500 + 499 + 498 and set(n.tolist()) == {40}
