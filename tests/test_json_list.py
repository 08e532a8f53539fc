"""The splitting reader of JSON lists against json.loads, with ranges of a few bytes."""

import json
import random

import pytest

from tessera.session import scratch
from tessera.sources import json_list, readers

SCHEMA = "k long, s string, nested struct<a:array<struct<b:string>>,m:map<string,string>>, x double"


def rows(n, seed=1):
    r = random.Random(seed)
    odd = ['}', '{', '"', "\\", "[", "]", ",", ":", "é", "日", "🎉", "\n", '"data": [', "\\\\", '\\"', " ", "data"]
    word = lambda: "".join(r.choice(odd + list("abc")) for _ in range(r.randint(0, 30)))
    return [{"k": k, "s": word(), "nested": {"a": [{"b": word()} for _ in range(r.randint(0, 3))], "m": {word(): word(), "data": "["}}, "x": k / 4} for k in range(n)]


def plain(found):
    return sorted(json.dumps([r["k"], r["s"], (n := r["nested"]) and [[b["b"] for b in n["a"]], dict(n["m"])], r["x"]], sort_keys=True) for r in found)


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("layout", "size"), [("bare", 400), ("indented", 997), ("wrapped", 400), ("late", 997), ("late", 10_000_000), ("both", 10_000)])
def test_equals_json(spark, tmp_path, small_ranges, layout, size):
    want = rows(40 if size < 1000 else 400)
    other = [{"k": -1, "s": "other", "nested": None, "x": 0}]
    files = {
        "bare": {"a.json": json.dumps(want[:30]), "b.json": json.dumps(want[30:], ensure_ascii=False)},
        "indented": {"a.json": "\n  " + json.dumps(want, indent=2) + "\n"},
        "wrapped": {"a.json": json.dumps({"version": 1, "data": want})},
        "late": {"a.json": json.dumps({"meta": {"data": other, "x": {"k": -2, "s": "inner"}}, "list": other * 5, "data": want, "after": {"deep": {"k": -3}}, "end": other})},
        "both": {"a.json": json.dumps(want[:10]), "b.json": json.dumps({"data": want[10:]}), "c.json": "", "d.json": "[]", "e.json": '{"data": []}', "f.json": '[1, null, "x", {}]'},
    }[layout]
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    small_ranges(size)
    got = readers.read_json(spark, f"file://{tmp_path}", SCHEMA)
    assert plain(r.asDict(True) for r in got.collect()) == plain(want)
    if size == 400:
        assert spark.read.option("lineSep", "}").text(f"file://{tmp_path}").rdd.getNumPartitions() > 20


@pytest.mark.parametrize("size", [50, 10_000_000])
def test_single_rows(spark, tmp_path, small_ranges, size):
    want = rows(3)
    for k, r in enumerate(want):
        (tmp_path / f"{k}.json").write_text(json.dumps(r))
    small_ranges(size)
    assert plain(r.asDict(True) for r in readers.read_any(spark, f"file://{tmp_path}/2.json", SCHEMA).collect()) == plain(want[2:])
    assert plain(r.asDict(True) for r in readers.read_json(spark, f"file://{tmp_path}", SCHEMA).collect()) == plain(want)


@pytest.mark.parametrize("wrapped", [False, True])
def test_writes_what_it_reads(spark, wrapped):
    want = rows(300, 4)
    df = spark.createDataFrame(want, SCHEMA).repartition(3)
    path = scratch(spark, "list")
    json_list.write(df, path, wrapped)
    files = [json.loads(r.value) for r in spark.read.text(path, wholetext=True).collect()]
    assert sum(len(f["data"] if wrapped else f) for f in files) == len(want)
    assert plain(r.asDict(True) for r in json_list.read(spark, path, SCHEMA).collect()) == plain(want)
    empty = scratch(spark, "empty")
    json_list.write(df.limit(0), empty, wrapped)
    assert json_list.read(spark, empty, SCHEMA).count() == 0
