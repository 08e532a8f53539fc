"""Golden numbers, fixtures and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import embed, features, policies, texts
from tessera.operators import evaluation, fusion, graphs, memory, retrieval, routing, rules, search
from tessera.plans import views
from tessera.sources import normalise, readers

DATA = "/root/testdata/sf0.001"
# Golden values: overlap of each template by hops, artifact form and static form.
RHO = {
    "LINEAR": (0.6667, 0.6389, 0.6194, 0.6050), "FORK": (0.3333, 0.5806, 0.5617, 0.5490), "MERGE": (0.4444, 0.4444, 0.4889, 0.5100), "FORK_MERGE": (0.4444, 0.5722, 0.5600, 0.5543),
    "INDEPENDENT": (0.3944, 0.3829, 0.3687, 0.3564), "POLICY_ISOLATED": (0.6667, 0.6389, 0.6194, 0.6050),
}


def test_rho_golden(spark):
    n, e = graphs.templates(spark)
    got = {(r["graph_type"], r["hops"]): float(r["rho"]) for r in graphs.rho_v3(n, e, ["graph_type", "hops"]).collect()}
    for kind, values in RHO.items():
        for h, v in zip((2, 3, 4, 5), values, strict=True):
            assert got[kind, h] == pytest.approx(v, abs=1e-4), (kind, h)


def test_graph_checks(spark):
    nodes = spark.createDataFrame([(1, "a", "SOLVER"), (1, "b", "SOLVER"), (2, "p", "PLANNER"), (2, "s", "SOLVER"), (2, "v", "VERIFIER"), (2, "t", "SOLVER")], "g int, node string, node_type string")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (2, "p", "s"), (2, "s", "v")], "g int, src string, dst string")
    got = {r["g"]: tuple(r)[1:] for r in graphs.check(nodes, edges, ["g"]).collect()}
    assert got == {1: (False, 0, 0), 2: (True, 1, 1)}


def test_long_graphs(spark):
    """A chain of 200 nodes, a cycle of 100, a diamond with a long side, a loop, two nodes without edges."""
    links = [(1, k, k + 1) for k in range(199)] + [(2, k, (k + 1) % 100) for k in range(100)] + [(3, 0, 80), (3, 80, 81)] + [(3, k, k + 1) for k in range(80)] + [(4, 0, 0)]
    nodes = spark.createDataFrame([(g, k, "SOLVER") for g, n in ((1, 200), (2, 100), (3, 82), (4, 1), (5, 2)) for k in range(n)], "g int, node int, node_type string")
    edges = spark.createDataFrame(links, "g int, src int, dst int")
    want = {(1, b, a): b - a for b in range(200) for a in range(b)} | {(2, b, a): (b - a - 1) % 100 + 1 for b in range(100) for a in range(100)} | {(4, 0, 0): 1}
    want |= {(3, b, a): b - a for b in range(82) for a in range(b)} | {(3, 80, 0): 1, (3, 81, 0): 2}
    assert {tuple(r)[:3]: r["distance"] for r in graphs.ancestors(edges, ["g"]).collect()} == want
    assert {r["g"]: r["is_dag"] for r in graphs.check(nodes, edges, ["g"]).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}
    got = {(r["g"], r["node"]): r["level"] for r in graphs.levels(nodes, edges, ["g"]).collect()}
    assert got == {(g, k): v for g, n, f in ((1, 200, int), (2, 100, lambda k: None), (3, 82, int), (4, 1, lambda k: None), (5, 2, lambda k: 0)) for k in range(n) for v in [f(k)]}


def test_rho_of_all_turns(spark, tmp_path):
    """Conversations of up to 70 turns, against brute force over their templates."""
    from tessera.plans import graph_queries

    turns = {k: n for k, n in enumerate((1, 2, 3, 5, 6, 8, 9, 9, 7, 12, 6, 20, 70))}
    spark.createDataFrame([(k, t, "user", "x") for k, n in turns.items() for t in range(n)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    v3, static = {}, {}
    for k, n in turns.items():
        kind, hops = graphs.GRAPH_TYPES[k % 6], max(2, n)
        nodes, edges = graphs.template(kind, hops)
        solvers = [x[0] for x in nodes if x[1] == "SOLVER"]
        above = {}
        for x in nodes:
            above[x[0]] = {a for s, d, _ in edges if d == x[0] for a in {s} | above[s]}
        seen = {x: above[x] & set(solvers) for x in solvers}
        held = {x: seen[x] | {x, "#plan"} for x in solvers}
        v3[k] = (hops, np.mean([len(held[x] & held[y]) / len(held[x] | held[y]) for x in solvers for y in solvers if x < y]))
        any_ = set().union(*seen.values())
        static[k] = (hops, len(set.intersection(*seen.values())) / len(any_) if any_ else 0)
    for query, want in ((graph_queries.q46, v3), (graph_queries.q47, static)):
        got = {r["episode"]: (r["hops"], r["rho"]) for r in query(spark, str(tmp_path)).collect()}
        assert {k: h for k, (h, _) in got.items()} == {k: h for k, (h, _) in want.items()}
        assert all(float(got[k][1]) == pytest.approx(want[k][1], abs=1e-4) for k in want)
    assert sum(r["n"] for r in graph_queries.q48(spark, str(tmp_path)).collect()) == len(turns)


def test_rrf_fixture(spark):
    mk = lambda ids: spark.createDataFrame([("r", m, k + 1, 0.0) for k, m in enumerate(ids)], "request_id string, memory_id string, rank int, score double")
    got = fusion.reciprocal_rank(mk(["m1", "m2", "m3"]), mk(["m3", "m4"])).orderBy("rank").collect()
    assert [(r["memory_id"], r["origin"]) for r in got] == [("m3", "both"), ("m1", "shared"), ("m2", "shared"), ("m4", "private")]
    assert got[0]["score"] == pytest.approx(1 / 63 + 1 / 61)


def policy(v, c, z, a):
    return F.struct(F.array(*map(F.lit, v)).alias("visibility"), F.lit(c).alias("clearance"), F.array(*map(F.lit, z)).alias("zones"), F.lit(a).alias("audit"))


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_policies(spark):
    a = policy(["team"], 3, ["quarantine", "audit_hold"], False)
    b = policy(["team"], 3, ["audit_hold", "quarantine"], False)
    c = policy(["team"], 3, ["audit_hold", "quarantine"], True)
    assert one(spark, policies.compatible(a, b)) and not one(spark, policies.compatible(a, c))
    assert one(spark, policies.policy_hash(a)) == one(spark, policies.policy_hash(c))
    m = one(spark, policies.merged(F.array(policy(["team", "public"], 3, ["a"], False), policy(["team"], 2, ["b"], False))))
    assert (m["visibility"], m["clearance"], m["zones"]) == (["team"], 2, ["a", "b"])
    assert one(spark, policies.merged(F.array(policy(["team"], 3, ["a"], False), policy(["owner"], 3, ["a"], False))))["visibility"] == ["team"]


@pytest.mark.parametrize(("x", "y", "want"), [("AB", "AB", ("identical", 1.0, True)), ("A", "AB", ("subset", 0.5, True)), ("ABC", "ABD", ("intersecting", 0.5, False)), ("A", "B", ("disjoint", 0.0, False))])
def test_overlap(spark, x, y, want):
    assert tuple(one(spark, policies.overlap(F.array(*map(F.lit, x)), F.array(*map(F.lit, y))))) == want


def test_features(spark):
    assert one(spark, features.authority(F.lit("Verified tool_output"))) == 1.0
    assert one(spark, features.authority(F.lit("nothing"))) == 0.5
    assert one(spark, features.provenance(F.lit("e"), F.lit("a"), F.lit(1), F.lit(9))) == 1.0
    assert one(spark, features.provenance(F.lit(""), F.lit(None).cast("string"), F.lit(None), F.lit(1))) == 0.0


def test_ttl_edges(spark):
    rows = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01', CAST(NULL AS INT)), (timestamp'2024-01-01', 3600), (timestamp'2024-01-01', 3599) AS t(c, ttl)")
    got = [r["x"] for r in rows.select(policies.expired(F.col("c"), F.col("ttl"), F.lit("2024-01-01 01:00:00").cast("timestamp")).alias("x")).collect()]
    assert got == [False, False, True]


def test_a5_pool_matches_svd(spark):
    r, m = views.requests(spark, DATA), views.memory(spark, DATA)
    as_of = F.timestamp_seconds(F.lit(views.AS_OF_SECONDS))
    routed = routing.hierarchical(r)
    members = routed.where("mode = 'shared'").join(r.select("request_id", "qvec"), "request_id").select("bucket", "member_ord", "qvec")
    lead = routed.where("mode = 'shared' AND member_ord = 0").select("bucket", "scope", "types", "asked")
    got = {}
    for x in search.pool(lead, members, m, as_of).collect():
        got.setdefault(x["bucket"], []).append((x["memory_id"], x["score"]))
    rows = m.where(~policies.expired(F.col("created_at"), F.col("ttl"), as_of)).collect()
    for b in lead.collect():
        q = np.array([x["qvec"] for x in sorted(members.where(F.col("bucket") == b["bucket"]).collect(), key=lambda x: x["member_ord"])], float)
        q /= np.linalg.norm(q, axis=1)[:, None]
        if len(q) < 3:
            basis, z = np.eye(q.shape[1])[:, :64], q[:, :64]
        else:
            u, s, vt = np.linalg.svd(q, full_matrices=False)
            basis, z = vt.T, u * s
        want = []
        for x in rows:
            if x["scope_id"] == b["scope"] and x["memory_type"] in b["types"] and set(x["visibility"]) & set(b["asked"]):
                k = np.array(x["embedding"], float) @ basis
                want.append((x["memory_id"], round(float(z[0] @ k / ((np.linalg.norm(z[0]) + 1e-8) * (np.linalg.norm(k) + 1e-8))), 9)))
        want = sorted(want, key=lambda t: (-t[1], t[0]))[:50]
        mine = sorted(got.get(b["bucket"], []), key=lambda t: (-t[1], t[0]))
        assert [t[0] for t in mine] == [t[0] for t in want]
        assert np.allclose([t[1] for t in mine], [t[1] for t in want], atol=1e-7)


def test_unknown_variant(spark):
    with pytest.raises(ValueError, match="unknown variant"):
        retrieval.retrieve(views.requests(spark, DATA), views.memory(spark, DATA), F.lit(0), "a9")


def test_metrics(spark):
    res = spark.createDataFrame([("q1", "m1", 1, None, "a1_independent"), ("q1", "m1", 2, None, "a1_independent"), ("q2", "x", 1, "b", "a5_shared"), ("q3", None, None, None, "a1_independent")], "request_id string, memory_id string, rank int, bucket string, mode string")
    gold = spark.createDataFrame([("q1", "m1"), ("q1", "m2"), ("q2", "y")], "request_id string, memory_id string")
    per = {r["request_id"]: (r["recall"], r["rr"]) for r in evaluation.per_request(res, gold, 2).collect()}
    assert per == {"q1": (0.5, 1.0), "q2": (0.0, 0.0)}
    f = evaluation.false_merges(res, spark.createDataFrame([("q1",), ("q2",)], "request_id string")).first()
    assert (f["conflicts"], f["merged"], f["rate"]) == (2, 1, 0.5)


def test_update_merges_maps(spark):
    rows = spark.createDataFrame([("a", {"x": "1", "y": "2"}, "t"), ("b", {}, "u")], "memory_id string, metadata map<string,string>, content string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    new = spark.createDataFrame([("a", {"y": "3"}), ("zz", {"q": "1"})], "memory_id string, metadata map<string,string>")
    got = {r["memory_id"]: r["metadata"] for r in memory.update(rows, new, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert got == {"a": {"x": "1", "y": "3"}, "b": {}}


def test_gsm8k_and_restricted(spark):
    rows = spark.createDataFrame([(3, "Tom has 12 apples and 5 pears", "Take 12 apples.\nAdd 5.\n\n#### 17")], "ord int, question string, answer string")
    i = normalise.gsm8k(rows).first()
    assert (i["original_id"], i["answer"], i["hop_count"], i["solution_steps"]) == ("gsm8k_train_000003", "17", 2, ["Take 12 apples.", "Add 5."])
    assert [(p["text"], p["hop_index"]) for p in i["supporting_paragraphs"]][:2] == [("Numeric value: 12", 1), ("Numeric value: 5", 2)]
    e = readers.restricted_entries(normalise.gsm8k(rows), "math").first()["entries"]
    assert [x["source"] for x in e] == ["step_1", "step_2"]


def test_math(spark):
    rows = spark.createDataFrame([(0, "Find $x$ and $y$.", r"First line here $x$.\n" "\nSecond line $y$ is long.\n" r"\boxed{42}", "Number  Theory", None), (1, "p", "One thing. Another thing", None, "a/algebra/7.json")], "ord int, problem string, solution string, subject string, path string")
    a, b = normalise.math(rows).orderBy("original_id").collect()
    assert (a["answer"], a["math_category"]) == ("42", "number_theory")
    assert (b["solution_steps"], b["math_category"]) == (["One thing", "Another thing"], "algebra")


def test_hotpot_layouts(spark):
    flat = spark.createDataFrame([("i", "q", "a", "bridge", '[["T1",["s0","s1"]],["T2",["u0"]],["T1",["dup"]]]', '[["T2",0],["T1",5]]')], "_id string, question string, answer string, type string, context string, supporting_facts string")
    i = normalise.hotpot(normalise.pairs_layout(flat)).first()
    assert [(p["title"], p["hop_index"]) for p in i["supporting_paragraphs"]] == [("T1", 2), ("T2", 1), ("T1", 2)]
    assert [(t["hop_index"], t["text"], t["source_paragraph_id"]) for t in i["task_shared_items"]] == [(1, "u0", "para_001"), (2, "s0", "para_000")]
    assert [tuple(f) for f in i["supporting_facts"]] == [("para_001", 0), ("para_000", 5)]


def test_musique(spark):
    rows = spark.createDataFrame(
        [("m1", "q", "a", None, [("A", "First. More.", True), ("B", "Second fact. More", True), ("C", "noise", False)], [("s1", 1), ("s2", 0), ("s3", 1)]), ("m2", "q", "a", False, [], [])],
        "id string, question string, answer string, answerable boolean, paragraphs array<struct<title:string,paragraph_text:string,is_supporting:boolean>>, question_decomposition array<struct<question:string,paragraph_support_idx:int>>",
    )
    (i,) = normalise.musique(rows).collect()
    assert [(p["paragraph_id"], p["hop_index"]) for p in i["supporting_paragraphs"]] == [("para_000", 2), ("para_001", 1)]
    assert [t["text"] for t in i["task_shared_items"]] == ["Second fact", "First", "Second fact"]


def test_files(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"original_id": "a", "entries": [{"content": "x", "confidence": 1.0}]}\n\nbroken\n{"original_id": "a", "entries": [{"content": "y"}]}\n')
    assert sorted(r["content"] for r in readers.restricted(spark, str(p)).collect()) == ["x", "y"]
    assert readers.restricted(spark, str(tmp_path / "none.jsonl")).count() == 0
    q = tmp_path / "d.json"
    q.write_text('{"data": [{"k": 1}, {"k": 2}]}')
    assert sorted(r["k"] for r in readers.read_any(spark, str(q), "k int").collect()) == [1, 2]
    with pytest.raises(ValueError, match="cannot read"):
        readers.read_any(spark, "x.csv")
    ep = spark.createDataFrame([("d", "train", "S1", "LINEAR", False), ("d", "train", "S1", "POLICY_ISOLATED", True), ("d", "test", "S1", "POLICY_ISOLATED", True)], "dataset string, split string, label string, graph_type string, s4 boolean")
    readers.write_episodes(ep, str(tmp_path / "out"))
    assert sorted(r["shard"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["s1_linear", "s4_policy_isolated"]


def test_embedding(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "t string")
    got = embed.embed(rows, "t", 8).collect()
    for r in got:
        assert (r["embedding"] is None) == (r["t"] is None)
        if r["t"]:
            assert np.allclose(r["embedding"], embed.pseudo_random(r["t"], 8))


def test_texts(spark):
    assert one(spark, texts.normalise_query(F.lit("  find \n it "), F.lit("solver"), F.lit("T"))) == "[Task: T] Solving task: find it"
    assert one(spark, texts.normalise_query(F.lit("Solving task: x"), F.lit("solver"))) == "Solving task: x"
    assert one(spark, texts.route(F.lit("Please CHECK the plan"))) == "planner"
    assert one(spark, policies.matches_pattern(F.lit("task/a/shared"), "task/*")) and not one(spark, policies.matches_pattern(F.lit("task/a"), "task/?"))


def test_stratified_sizes(spark):
    rows = spark.range(100).withColumn("c", F.when(F.col("id") < 95, "big").otherwise("small"))
    got = {r["c"]: r["n"] for r in rules.stratified(rows, "c", "id", 0.1, "7").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"big": 9, "small": 1}


def test_rows_order_does_not_matter(spark):
    r, m = views.requests(spark, DATA), views.memory(spark, DATA)
    as_of = F.timestamp_seconds(F.lit(views.AS_OF_SECONDS))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(retrieval.retrieve(r, m, as_of, "a4")) == key(retrieval.retrieve(r.orderBy(F.rand(1)), m.orderBy(F.rand(2)), as_of, "a4"))


def test_streams(spark, tmp_path):
    from tessera.streaming import cycles

    src = tmp_path / "in"
    spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "memory_id string, confidence double").withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.json(str(src))
    s = spark.readStream.schema("memory_id string, confidence double, created_at timestamp").json(str(src))
    q = cycles.entries(s).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["memory_id"] for r in spark.table("seen").collect()) == ["a", "b"]


def test_filter_takes_whole_metadata_keys(spark):
    from tessera.operators.memory import Filter

    rows = [("flat", '{"a.b": "1", "it\'s": "x"}'), ("nested", '{"a": {"b": "1"}}'), ("number", '{"a.b": 1}'), ("other", '{"a.b": "2"}'), ("broken", "{"), ("none", None)]
    df = spark.createDataFrame(rows, "memory_id string, metadata string")
    as_of = F.current_timestamp()
    assert {r.memory_id for r in df.where(Filter(metadata={"a.b": "1"}).column(as_of)).collect()} == {"flat", "number"}
    assert [r.memory_id for r in df.where(Filter(metadata={"a.b": "1", "it's": "x"}).column(as_of)).collect()] == ["flat"]


def test_owned_tables_go(spark):
    import glob

    from tessera import session

    root = session.shared_dir(spark).removeprefix("file://")
    keep = session.scratch(spark, "kept")
    before = set(glob.glob(f"{root}/*"))
    with session.owned(spark):
        t = session.checkpoint(spark.range(10))
        with session.owned(spark):
            session.checkpoint(t).count()
        session.checkpoint(t.where("id > 3")).write.parquet(keep)
        session.scratch(spark, "never written")
    assert set(glob.glob(f"{root}/*")) - before == {keep.removeprefix("file://")}
    assert spark.read.parquet(keep).count() == 6
