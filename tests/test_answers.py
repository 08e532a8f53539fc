"""Answer quality against plain Python, the exclusive draw, relevance windows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import policies
from tessera.operators import answers, rules


def bag(text):
    plain = re.sub(r"[!-/:-@\[-`{-~]", "", (text or "").lower())
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", plain) if w not in ("", "a", "an", "the")]


def test_matches(spark):
    r = random.Random(2)
    text = lambda: " ".join(r.choice(["The", "cat", "cat,", "Dog!", "an", "é", "x"]) for _ in range(r.randint(0, 6)))
    rows = [(k, text(), text()) for k in range(200)] + [(300, None, None), (301, "the", ""), (302, None, "cat"), (303, "A cat.", "cat"), (304, "x " * 5000, "x " * 4000)]
    got = {x.id: (x.em, x.f1) for x in answers.matches(spark.createDataFrame(rows, "id long, predicted string, gold string")).collect()}
    for k, p, g in rows:
        p, g = bag(p), bag(g)
        both = sum((Counter(p) & Counter(g)).values())
        want = 2 * both / (len(p) + len(g)) if p and g else float(p == g)
        assert got[k][0] == (p == g) and got[k][1] == pytest.approx(want, abs=1e-6)


def test_hits_and_support(spark):
    requests = spark.createDataFrame([(1, "Big cat"), (2, "cat"), (3, "no"), (4, "the")], "id long, gold string")
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1), (2, 10, 3), (4, 10, 1)], "id long, doc long, rank int")
    gold = spark.createDataFrame([(1, 11), (1, 11), (2, 10), (3, 10)], "id long, doc long")
    texts = spark.createDataFrame([(10, "A big, the cat!"), (11, None), (12, "cats concatenated")], "doc long, text string")
    hit = {r.id: r.hit for r in answers.evidence_hits(requests, results, gold, 2).collect()}
    assert hit == {1: True, 2: False, 3: False, 4: None}
    told = {r.id: r.supported for r in answers.supported(requests, results, texts, 2).collect()}
    assert told == {1: True, 2: False, 3: False, 4: False}
    mean = answers.rates(answers.evidence_hits(requests, results, gold, 2), answers.supported(requests, results, texts, 2)).first()
    assert (mean.requests, mean.supported) == (4, 0.25) and mean.hit == pytest.approx(1 / 3)


@pytest.mark.parametrize("n", [0, 6, 11, 50])
def test_exclusive_draw(spark, n):
    rows = [(f"e{k}", "S1" if k < 3 else "S2" if k < 12 else None if k == 12 else "S3") for k in range(30)]
    got = {r.episode_id: r.label for r in rules.exclusive_draw(spark.createDataFrame(rows, "episode_id string, label string"), n).collect()}
    assert len(got) == min(n, 30)
    order = lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest()
    for label in ("S1", "S2", "S3"):  # those of a stratum are its first by the hash
        own = sorted((k for k, x in rows if x == label), key=order)
        assert {k for k in got if got[k] == label} == set(own[: sum(x == label for x in got.values())])
    if n == 11:
        assert Counter(got.values()) == {"S1": 3, "S2": 4, "S3": 3, None: 1} or Counter(got.values()) == {"S1": 3, "S2": 3, "S3": 4, None: 1}


def test_windows(spark):
    df = spark.sql("SELECT stack(5, 'working', timestamp'2024-01-01 00:00:00', 'working', timestamp'2024-01-01 01:00:00', 'other', timestamp'2000-01-01 00:00:00', 'semantic', timestamp'2023-12-27 00:00:00', 'episodic', null) AS (t, at)")
    now = F.lit("2024-01-01 02:00:00").cast("timestamp")
    got = [(r.t, r.ok, r.kept) for r in df.select("t", policies.relevant(F.col("t"), F.col("at"), now).alias("ok"), policies.retention(F.col("t")).alias("kept")).collect()]
    assert got == [("working", False, "ephemeral"), ("working", True, "ephemeral"), ("other", True, "adaptive"), ("semantic", True, "persistent"), ("episodic", False, "adaptive")]


def test_find_scopes(spark):
    import fnmatch

    from tessera.operators import scopes

    r = random.Random(1)
    ids = ["".join(r.choice("ab/1.]") for _ in range(r.randint(0, 7))) for _ in range(150)] + ["task/alpha/shared", "x*y", "é/日本"]
    patterns = ["".join(r.choice("ab/1**?.]") for _ in range(r.randint(1, 6))) for _ in range(80)] + ["*", "**", "*[ab]*", "[!a]*", "[*", "*[]a]*", "x*y", "x[*]y", "task/*/shared", "*/日本", "nowhere*", "a", "?"]
    df, ps = spark.createDataFrame([(x,) for x in ids] + [(None,), ("a",), ("a",)], "scope_id string"), spark.createDataFrame([(p,) for p in patterns] + [(None,), ("*",)], "pattern string")
    got = sorted((x.pattern, x.scope_id) for x in scopes.find(df, ps).collect())
    want = sorted({(p, x) for p in patterns for x in {*ids, "a"} if (fnmatch.fnmatchcase(x, p) if "*" in p else x == p)})
    assert got == want
    for p in patterns[-13:]:
        assert sorted({x.scope_id for x in scopes.matching(df, p).collect()}) == sorted({x for q, x in want if q == p})


def test_only_retrieved_texts_are_read_into_words(spark):
    texts = spark.createDataFrame([(k, f"text {k}") for k in range(50)] + [(60, None)], "doc long, text string")
    results = spark.createDataFrame([(1, 7, 1), (2, 7, 1), (2, 60, 2), (3, 99, 1)], "id long, doc long, rank int")
    for at_most in (0, 10):
        assert sorted((r.doc, r.text) for r in answers.retrieved(results, texts, at_most).collect()) == [(7, "text 7"), (60, None)]
    both = results.join(texts, "doc").select("id", F.col("text").alias("predicted"), F.lit("text 7").alias("gold"))
    plan = answers.matches(both.where("id < 2"))._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "size(" in x]  # no text is cut into words to be filtered below a join
