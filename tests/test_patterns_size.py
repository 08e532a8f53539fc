"""Patterns meet scopes on grams as long as the names they hold."""

import fnmatch
import random

from tessera.operators import scopes


def test_long_names_and_short(spark):
    rng = random.Random(7)
    ids = [f"{rng.choice(['order', 'task', 'o'])}/{rng.randrange(5000)}{rng.choice(['', '/x', '-averyverylongname'])}" for _ in range(800)]
    patterns = [f"*/{rng.randrange(500)}?" for _ in range(60)] + [f"ord*{rng.randrange(300)}[0-4]*" for _ in range(40)] + ["*", "*?", "o*", "*averyverylongname", "*-averyverylongnames*", "*veryverylong*task*", "t*k/1*"]
    got = scopes.find(spark.createDataFrame([(x,) for x in ids], "scope_id string"), spark.createDataFrame([(x,) for x in patterns], "pattern string"))
    assert sorted(map(tuple, got.select("pattern", "scope_id").collect())) == sorted({(p, x) for p in patterns for x in ids if fnmatch.fnmatchcase(x, p)})


def test_names_are_kept_whole(spark):
    """A pattern met each scope that has three letters of the name it holds: of these 2000, 20 have `123` and one has `/12345`."""
    assert scopes.GRAM >= len("/12345678")
    ids = spark.range(12000, 14000).selectExpr("concat('c/', cast(id as string)) as scope_id")
    found = scopes.find(ids, spark.createDataFrame([("*/1234?",)], "pattern string"))
    assert sorted(r["scope_id"] for r in found.collect()) == [f"c/1234{k}" for k in range(10)]
