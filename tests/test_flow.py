"""Whole episodes, scopes, self-tests, the facade, and operators whose queries can't show everything."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.functions import embed, policies, templates
from tessera.operators import assembly, episodes, evaluation, fusion, graphs, memory, retrieval, routing, rules, scopes, search, synthetic
from tessera.plans import flow_queries, views
from tessera.session import checkpoint
from tessera.sources import normalise, readers

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def as_of():
    return F.timestamp_seconds(F.lit(views.AS_OF_SECONDS))


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.fixture(scope="module")
def written(spark):
    return checkpoint(flow_queries.written(spark, DATA))


def test_clean_episodes_have_no_issue(written):
    got = rules.audit_episodes(written)
    assert got.where("severity = 'error'").count() == 0
    assert {r["rule"] for r in got.collect()} <= {"hop_count"}


def test_every_audit_rule_fires(written):
    fired = {r["rule"] for r in rules.audit_episodes(flow_queries.broken(written)).collect()}
    here = {int(r["original_id"]) % 20 for r in written.select("original_id").distinct().collect()}
    assert {x for k, x in enumerate(flow_queries.BREAKS) if k in here} <= fired | {"audit", "shared_owner", "gold"}


def test_write_and_read(spark, written, tmp_path):
    path = str(tmp_path / "out")
    rejected = assembly.write(written, path)
    assert {r["rule"] for r in rejected.collect()} <= {"s4_only_test"} and rejected.count() == written.where("s4_eligible AND split <> 'test'").count()
    back = assembly.read(spark, path, written.schema)
    key = lambda df: sorted(map(str, df.select("episode_id", "nodes", "memory_entries", "agents", "ground_truth", "meta").collect()))
    assert key(back) == key(written.where("NOT s4_eligible OR split = 'test'"))
    assembly.write(written, path, append=True)
    assert assembly.read(spark, path, written.schema).count() == 2 * back.count()
    assembly.write(written.withColumns({"rho_subset": F.lit("S7"), "graph_type": F.lit("RING"), "reasoning_path_type": F.lit("x")}), path, s4_shard=False)
    odd = assembly.read(spark, path, written.schema).select("graph_type", "rho_subset", "reasoning_path_type").distinct().collect()
    assert [tuple(r) for r in odd] == [("LINEAR", "S3", "GoT")]
    assert assembly.read(spark, str(tmp_path / "none"), written.schema).count() == 0
    readers.write_report(flow_queries.q79(spark, DATA), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).where("grain = 'all'").count() == 1


def test_quarantine_names_rules(spark):
    p = flow_queries.built(spark, DATA)
    found, bad = assembly.check(p)
    bare = p.episodes.where("original_id % 11 = 4").count()
    assert bad.count() == bare and all(r["rules"] == ["workspace_empty"] for r in bad.collect())
    assert assembly.without(p, bad).episodes.count() == p.episodes.count() - bare


def test_all_policy_rules(spark):
    """One row breaks each of the thirteen."""
    e = spark.createDataFrame([(1, "POLICY_ISOLATED", True, 2, 1.5, "secret answer"), (2, "LINEAR", False, 2, 0.5, "x"), (3, "LINEAR", False, 9, 0.5, "")], "e int, graph_type string, s4 boolean, hops int, rho double, answer string")
    a = spark.createDataFrame([(1, "p", "planner", [], 1, "r1"), (2, "v", "verifier", ["w"], 2, "r2"), (2, "s", "solver", ["r2"], 3, "r2"), (3, "p", "planner", ["w"], 1, "r3")], "e int, agent string, role string, scopes array<string>, clearance int, restricted_scope string")
    m = spark.createDataFrame([(1, "m1", "task_shared_episodic", 0, "the secret answer is", None), (1, "m2", "restricted", 1, "", None), (2, "m3", "workspace_semantic", 0, "", [1.0]), (2, "m3", "workspace_semantic", 0, "", None), (3, "m4", "workspace_semantic", 0, "", None)], "e int, memory_id string, layer string, required_clearance int, content string, embedding array<float>")
    got = {(r["rule"], r["key"]) for r in rules.policy_rules(e, a, m, ["e"]).collect()}
    assert got == {
        ("workspace_empty", "1"), ("agent_scopes", "p"), ("verifier_scope", "v"), ("other_scope", "s"), ("agent_clearance", "s"), ("verifier_missing", "1"), ("verifier_unexpected", "2"), ("restricted_clearance", "m2"),
        ("unique_id", "m3"), ("rho_range", "1"), ("agent_count", "1"), ("agent_count", "2"), ("agent_count", "3"), ("embedding_null", "m3"), ("answer_leak", "m1"),
    }
    keyed = rules.policy_rules(e, a, m, ["e"], keyed=True).columns
    assert keyed == ["e", "rule", "severity", "key"]


def test_requests_by_kind(spark):
    rows = spark.createDataFrame([("math", "Q", [], ["First. x", "Second step"], "algebra", None), ("hotpotqa", "Q", ["a?", "b?"], [], None, "bridge"), ("2wikimhqa", "Q", [], [], None, "comparison"), ("gsm8k", None, [], [], None, None)], "dataset string, question string, sub_questions array<string>, solution_steps array<string>, math_category string, qa_type string")
    q = lambda t, h: [r[0] for r in rows.select(assembly.query(F.lit(t), F.lit(h))).collect()]
    assert q("PLANNER", 0) == ["Plan the solution steps for the problem: Q", "Q", "Q", ""]
    assert q("SOLVER", 2) == ["Second step", "b?", "Q", ""] and q("SOLVER", 9)[:2] == ["Second step", "b?"] and q("SOLVER", 1)[0] == "First"
    assert q("VERIFIER", 0) == [assembly.VERIFY["math_algebra"], assembly.CREDIBILITY, assembly.VERIFY["2wikimhqa_comparison"], assembly.VERIFY["gsm8k"]]


def test_layers(spark):
    p = f"array<{normalise.PARAGRAPH}>"
    items = spark.createDataFrame([("i",)], "original_id string").select("original_id", F.expr(f"array(named_struct('paragraph_id', 'p0', 'text', 'gold', 'title', 't', 'is_gold', true, 'hop_index', 1))").cast(p).alias("supporting_paragraphs"), F.expr("array(named_struct('paragraph_id', 'p1', 'text', 'off', 'title', 't', 'is_gold', false, 'hop_index', 2))").cast(p).alias("distractor_paragraphs"), F.expr(f"cast(array(named_struct('hop_index', 1, 'text', 'one', 'source_paragraph_id', 's'), named_struct('hop_index', 1, 'text', 'two', 'source_paragraph_id', 's')) AS array<{normalise.SHARED}>)").alias("task_shared_items"))
    w = {r["pid"]: (r["confidence"], r["is_gold"], r["layer"]) for r in episodes.workspace_layer(items, "d").collect()}
    assert w == {"p0": (1.0, True, "workspace_semantic"), "p1": (0.5, False, "workspace_semantic")}
    solvers = spark.createDataFrame([("i", "solver_1", 1), ("i", "solver_2", 2)], "original_id string, node string, hop int")
    assert [(r["node"], r["content"]) for r in episodes.task_shared_layer(solvers, items).collect()] == [("solver_1", "one")]
    assert one(spark, episodes.episode_id("d", "dev", F.lit("a b/c"), F.lit("FORK"))) == "d_dev_a_b_c_FORK"


def test_wired_and_cached_rho(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "a", ["z"]), (1, "b", None), (1, "z", None)], "g int, node string, parents array<string>")
    edges = spark.createDataFrame([(1, "b", "a"), (1, "z", "a")], "g int, src string, dst string")
    got = {r["node"]: (r["parents"], r["children"]) for r in graphs.wired(nodes, edges, ["g"]).collect()}
    assert got == {"a": (["z", "b"], []), "b": ([], ["a"]), "z": ([], ["a"])}
    path = str(tmp_path / "rho")
    keys = spark.createDataFrame([("LINEAR", 2), ("FORK", 2)], "graph_type string, hops int")
    assert {r["graph_type"]: r["rho"] for r in graphs.cached_rho(keys, path).collect()} == pytest.approx({"LINEAR": 0.6667, "FORK": 0.3333}, abs=1e-4)
    more = graphs.cached_rho(keys.where("hops = 9").union(spark.createDataFrame([("LINEAR", 3), ("LINEAR", 2)], "graph_type string, hops int")), path)
    assert more.count() == 2 and spark.read.parquet(path).count() == 3


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((700, 8)), 1)
    x[5] = x[9]
    x[11] = 0
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(9999, None)], "id long, vec array<double>").repartition(5)
    for kind in ("cosine", "dot", "euclid"):
        search.QUERY_BLOCK, search.ROW_BLOCK = 7, 64
        got = {}
        for r in search.nearest(df.where("id < 40"), df, 6, kind).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append((r["id"], r["score"]))
        search.QUERY_BLOCK, search.ROW_BLOCK = 1024, 4096
        for q in range(40):
            n = np.linalg.norm(x, axis=1) * np.linalg.norm(x[q])
            s = x @ x[q] if kind == "dot" else np.divide(x @ x[q], n, out=np.zeros(700), where=n > 0) if kind == "cosine" else -((x - x[q]) ** 2).sum(1)
            s = np.round(s, 9)
            want = sorted(range(700), key=lambda k: (-s[k], k))[:6]
            assert [i for i, _ in got[q]] == want and np.allclose([v for _, v in got[q]], s[want], atol=2e-9)


@pytest.mark.parametrize("words", [2_000_000, 40])
def test_best_overlaps(spark, words, monkeypatch):
    """Items in one index, and dealt out over several."""
    monkeypatch.setattr(search, "ITEM_WORDS", words)
    monkeypatch.setattr(search, "CELLS", 50)
    rng = np.random.default_rng(8)
    draw = lambda n: sorted({f"w{k}" for k in rng.integers(0, 60, n)})
    docs, items = [(k, draw(20)) for k in range(80)] + [(99, None)], [(k, draw(9)) for k in range(12)] + [(50, ["none"])]
    got = {}
    for r in search.best_overlaps(spark.createDataFrame(docs, "id long, ws array<string>").repartition(3), spark.createDataFrame(items, "item_id long, ws array<string>"), 4).collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["id"], r["hits"]))
    for i, ws in items:
        want = sorted(((-len(set(ws) & set(d or ())), k) for k, d in docs if set(ws) & set(d or ())))[:4]
        assert sorted(got.get(i, [])) == [(n + 1, k, -h) for n, (h, k) in enumerate(want)]


def test_numbered(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), ((F.col("id") * 37) % 11).alias("v"))
    got = search.numbered(rows, ["g"], [F.col("v").desc(), "id"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append(r)
    for rs in by.values():
        assert [r["at"] for r in sorted(rs, key=lambda r: (-r["v"], r["id"]))] == list(range(1, len(rs) + 1)) and {r["n"] for r in rs} == {len(rs)}


def test_balanced_pool(spark):
    r, m = views.requests(spark, DATA), views.memory(spark, DATA)
    routed = routing.hierarchical(r)
    members = routed.where("mode = 'shared'").join(r.select("request_id", "qvec"), "request_id").select("bucket", "member_ord", "qvec")
    lead = routed.where("mode = 'shared' AND member_ord = 0").select("bucket", "scope", "types", "asked")
    if lead.isEmpty():
        members = r.select(F.lit("b").alias("bucket"), F.col("ord").alias("member_ord"), "qvec")
        lead = spark.createDataFrame([("b", "task/alpha/shared", ["semantic"], ["team"])], "bucket string, scope string, types array<string>, asked array<string>")
    got = search.pool(lead, members, m, as_of(), mode="balanced").collect()
    assert got
    rows = {x["memory_id"]: np.array(x["embedding"], float) for x in m.collect()}
    vectors = {}
    for x in members.collect():
        vectors.setdefault(x["bucket"], []).append(np.array(x["qvec"], float) / np.linalg.norm(x["qvec"]))
    for x in got:
        q = np.array(vectors[x["bucket"]])
        if len(q) >= 3:
            values, u = np.linalg.eigh(q.T @ q)
            basis = u[:, values > 1e-6 * values.max()].T
            z, w = basis @ rows[x["memory_id"]], q @ basis.T
            assert x["score"] == pytest.approx(max(v @ z / ((np.linalg.norm(v) + 1e-8) * (np.linalg.norm(z) + 1e-8)) for v in w), abs=1e-6)


def test_greedy_policies_differ_from_hashes(spark):
    """Equal hashes, unlike audits: two buckets; unlike hashes, overlapping visibilities: one."""
    base = views.requests(spark, DATA).limit(4).collect()
    policy = [(["team"], 3, ["z"], False), (["team"], 3, ["z"], True), (["team", "public"], 3, ["z"], False), (["public"], 3, ["z"], False)]
    rows = [(k, f"r{k}", "solver", "q", [], ["s"], [], [], ["semantic"], p, 0) for k, p in enumerate(policy)]
    got = routing.hierarchical(spark.createDataFrame(rows, synthetic.REQUEST))
    by = {r["request_id"]: (r["bucket"], r["mode"], r["n"]) for r in got.collect()}
    assert by["r0"][0] == by["r2"][0] != by["r1"][0] and by["r3"][0] not in (by["r0"][0], by["r1"][0])
    assert [by[f"r{k}"][1] for k in range(4)] == ["shared", "independent", "shared", "independent"] and len(base) == 4


def test_missing_vectors(spark):
    m = views.memory(spark, DATA).limit(30).withColumn("embedding", F.when(F.col("vec_id") % 2 == 0, F.col("embedding")))
    got = embed.fill(m, dim=64)
    assert got.dtypes == m.dtypes and got.where("embedding IS NULL").count() == 0
    for r in got.where("vec_id % 2 = 1").collect():
        assert np.allclose(r["embedding"], embed.pseudo_random(r["content"], 64))
    # Golden values: drawn by the generator itself, outside the library.
    assert np.allclose(embed.pseudo_random("alpha", 3), [-0.66666, -0.41803, 0.61710], atol=1e-5) and np.allclose(embed.pseudo_random("beta", 3), [0.49365, 0.70624, -0.50747], atol=1e-5)


def test_synthetic_suite(spark):
    got = {(r["variant"], r["case"]): r for r in synthetic.evaluate(spark).collect()}
    assert got["a5", "S1"]["savings"] == pytest.approx(2 / 3) and got["a5", "S2"]["savings"] == pytest.approx(1 / 3) and got["a5", "S3"]["savings"] == 0
    assert got["a5", "S4"]["rate"] == 0 and got["a4", "S4"]["rate"] == 1 and got["a3", "S4"]["rate"] == 1
    assert all(r["recall"] == 1 for (v, c), r in got.items() if c != "S4" or v in ("a1", "a5"))
    total = {r["variant"]: r for r in evaluation.macro(spark.createDataFrame([r.asDict() for r in got.values()])).collect()}
    assert total["a5"]["rate"] == 0 and total["a1"]["savings"] == 0 and total["a5"]["savings"] == pytest.approx((2 / 3 + 1 / 3 + 0 + 1 / 3) / 4)


def test_engine(spark):
    m = checkpoint(views.memory(spark, DATA))
    e = Engine(spark, m)
    e.create_agent("p", "planner", ("task/alpha/shared", "agent/p/private"))
    r = e.requests([("p", "what is it", [0.1] * 64), ("nobody", " ", [0.0] * 64)])
    rows = {x["request_id"]: x for x in r.collect()}
    assert rows["req_p_0"]["private"] == ["agent/p/private"] and rows["req_nobody_1"]["shared"] == ["default"] and rows["req_p_0"]["types"] == ["semantic", "episodic", "working"]
    assert {x["request_id"]: x["warnings"] for x in e.warnings(r).collect()} == {"req_p_0": [], "req_nobody_1": ["empty query"]}
    assert {x["score"] for x in e.find("text", ["task/alpha/shared"], k=5).collect()} == {0.0} and e.find("text", k=5).count() == 5
    found = e.retrieve(r, views.AS_OF, "a1")
    shown = e.tool_rows(found, 3).collect()
    assert 0 < len(shown) <= 3 and all(len(x["content"]) <= 200 and len(x["score"].split(".")[1]) == 3 for x in shown)
    n = e.stats().where("grain = 'all'").first()["n"]
    first = m.select("memory_id").limit(1)
    e.delete(first)
    assert e.stats().where("grain = 'all'").first()["n"] == n - 1
    e.add(m.join(first, "memory_id"))
    assert e.stats().where("grain = 'all'").first()["n"] == n
    gold = found.where("rank = 1").select("request_id", "memory_id").limit(1)
    report = {x["variant"]: x for x in e.evaluate(r, gold, r.select("request_id").limit(0), views.AS_OF, variants=("a1",)).collect()}
    assert report["a1"]["recall"] == 1 and report["a1"]["requests"] == 2


def test_config():
    assert retrieval.Config.read({"shared_top_k": 7}, {"TESSERA_RERANK_TOP_K": "3", "TESSERA_FIX_KEYWORD": "true", "TESSERA_MIN_SCORE": "0.5"}) == retrieval.Config(shared_top_k=7, rerank_top_k=3, fix_keyword=True, min_score=0.5)
    with pytest.raises(ValueError, match="unknown settings"):
        retrieval.Config.read({"nope": 1}, {})


def test_scopes_and_slices(spark):
    s = spark.createDataFrame([("w", None, "workspace"), ("s1", "w", "session"), ("t1", "s1", "task_shared"), ("t2", "s1", "task_shared"), ("x", "y", "session"), ("y", "x", "session")], "scope_id string, parent string, type string")
    below = scopes.descendants(s, spark.createDataFrame([("w",), ("x",)], "scope_id string"))
    assert {(r["root"], r["scope_id"], r["depth"]) for r in below.collect()} == {("w", "s1", 1), ("w", "t1", 2), ("w", "t2", 2), ("x", "y", 1)}
    assert {r["scope_id"]: r["children"] for r in scopes.children(s).collect()}["s1"] == 2
    assert scopes.unregister(s, s.where("scope_id = 't1'")).count() == 5 and scopes.register(s, s.where("scope_id = 'w'")).count() == 6
    assert sorted(r["scope_id"] for r in scopes.matching(s, "t*").collect()) == ["t1", "t2"]
    made = lambda kind, **k: one(spark, scopes.scope_of(kind, *(F.lit(k.get(x)).cast("string") for x in ("task", "session", "workspace", "agent")), F.lit("tpl")))
    assert [made("agent_private", agent="a"), made("task_shared", task="t"), made("session"), made("governed"), made("workspace", workspace="w")] == ["agent/a/private", "task/t/shared", "tpl", "governed/tpl", "workspace/w"]
    part = scopes.Slice().with_scope("s1").with_types("semantic").add_type("episodic").add_type("semantic").with_policy(clearance=1).build()
    assert part.key == ("s1", ("episodic", "semantic"), ("team",), 1)
    with pytest.raises(ValueError, match="needs a scope"):
        scopes.Slice().build()
    m = spark.createDataFrame([("a", "s1", "semantic", ["team"]), ("b", "s1", "semantic", ["owner"]), ("c", "s2", "semantic", ["team"])], "memory_id string, scope_id string, memory_type string, visibility array<string>")
    assert [r["memory_id"] for r in m.where(part.column()).collect()] == ["a"]
    named = {r["scope_id"]: r["type"] for r in scopes.from_requests(views.requests(spark, DATA)).collect()}
    assert named["workspace/default"] == "workspace" and named["task/alpha/shared"] == "task_shared"


def test_small_operators(spark, tmp_path):
    p = one(spark, policies.from_record(*(F.lit(None).cast(t) for t in ("array<string>", "int", "array<string>", "boolean"))))
    assert (p["visibility"], p["clearance"], p["zones"], p["audit"]) == (["team"], 3, ["quarantine"], False)
    fused = spark.createDataFrame([("r", "both"), ("r", "shared"), ("r", "private")], "request_id string, origin string")
    assert tuple(fusion.counts(fused).first()) == ("r", 2, 2)
    e = spark.createDataFrame([("S1",), ("S3",)], "label string")
    assert [r["label"] for r in rules.coverage(e).collect()] == ["S2"]
    m = spark.createDataFrame([(0, "x", [0.0, 0.0], None, None), (1, "y", [1.0], ["owner"], 0.9)], "ord int, content string, embedding array<double>, visibility array<string>, salience double")
    made = memory.create(m, F.lit("2024-01-01").cast("timestamp")).orderBy("ord").collect()
    assert made[0]["embedding"] is None and made[0]["visibility"] == ["team"] and made[0]["salience"] == 0.5 and made[1]["visibility"] == ["owner"] and made[0]["memory_id"].startswith("mem_") and made[0]["memory_id"].endswith("_0")
    assert readers.split_file("test", dev="d") == "d" and readers.split_file("test", dev="d", test="t") == "t"
    with pytest.raises(ValueError, match="no file for split"):
        readers.split_file("train", dev="d")
    assert readers.dataset("2wikimultihopqa") == "2wikimhqa"
    readers.freeze_ids(spark.createDataFrame([("b",), ("a",), ("b",)], "original_id string"), str(tmp_path / "ids"))
    assert sorted(r[0] for r in readers.frozen_ids(spark, str(tmp_path / "ids")).collect()) == ["a", "b"]
    assert [one(spark, templates.ask(F.array(F.lit(" a "), F.lit("b")), F.lit(k), F.lit("q"))) for k in (1, 2, 3)] == ["a", "b", "q"]
    told = F.array(F.struct(F.lit(2).alias("hop_index"), F.lit(" told ").alias("text")))
    assert one(spark, templates.gold(told, told, F.lit(2))) == "told" and one(spark, templates.gold(told, told, F.lit(1))) is None
    assert one(spark, templates.plan(F.lit("Q"), F.array(F.lit("a")), F.lit(2))) == "Plan for question: Q\n  - hop 1: a"
    assert one(spark, templates.conclusion(F.lit(""), F.lit("s"), F.lit(1))) == "[conclusion] node=s hop=1: (no gold oracle available)"
    assert "(no conclusions)" in one(spark, templates.audit(F.lit("d"), F.array().cast("array<string>")))


def test_random_projection(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((50, 12))
    for init in ("gauss", "xavier"):
        basis = search.random_projection(x, 4, 9, keep=0.7, init=init, seed=3)
        assert basis.shape == (4, 12) and np.allclose(basis @ basis.T, np.eye(4)) and np.allclose(basis, search.random_projection(x, 4, 9, keep=0.7, init=init, seed=3))
    rows = spark.createDataFrame([(v.tolist(),) for v in x[:5]], "embedding array<double>")
    got = np.array([r["projected"] for r in search.project(rows, basis).collect()])
    assert np.allclose(got, x[:5] @ basis.T)


def test_normalisers_by_name(spark):
    rows = spark.createDataFrame([(0, "2 and 3?", "step one is here\n#### 5")], "ord int, question string, answer string")
    assert normalise.by_name("gsm8k", "test")(rows).first()["original_id"] == "gsm8k_test_000000"
    with pytest.raises(ValueError, match="unknown dataset"):
        normalise.by_name("nope")


def test_wiki(spark):
    rows = spark.createDataFrame([("w", "q?", "a", "comparison", ["A", "B"], [["a0", "a1"], ["b0"]], ["A", "B", "C"], [1, 0, 0])], "id string, question string, answer string, type string, titles array<string>, sentences array<array<string>>, fact_titles array<string>, fact_sents array<int>")
    i = normalise.wiki(rows).first()
    assert i["hop_count"] == 3 and i["sub_questions"] == ["q?"] * 3 and i["task_shared_items"] == [] and [p["title"] for p in i["supporting_paragraphs"]] == ["A", "B"] and i["dataset"] == "2wikimhqa"
    b = normalise.wiki(rows.withColumn("type", F.lit("bridge"))).first()
    assert [(x["hop_index"], x["text"]) for x in b["task_shared_items"]] == [(1, "a1"), (2, "b0")]


def test_stream_order_rule_and_forced_merge(spark):
    a = spark.createDataFrame([(1, "m1", "plan", "x", "team", 0, [], "p", 0), (1, "m2", "scratch", "x", "team", 5, [], "p", 1), (1, "m3", "scratch", "x", "team", 4, [], "p", 2)], "e int, memory_id string, slot string, layer string, visibility string, topo_index int, parents array<string>, node string, pos int")
    nodes = spark.createDataFrame([(1, "p", "PLANNER")], "e int, node string, node_type string")
    got = [(r["rule"], r["key"]) for r in rules.trace_rules(a, nodes, spark.createDataFrame([(1, "LINEAR")], "e int, graph_type string"), ["e"]).collect()]
    assert got == [("stream_order", "m3")]
    assert {r["mode"] for r in routing.forced(views.requests(spark, DATA)).collect()} == {"shared"} and {r["mode"] for r in routing.forced(views.requests(spark, DATA).limit(1)).collect()} == {"independent"}


def test_episode_tables_are_read_once(spark):
    """Sources and layers are worked out once; what is read again are stored tables."""
    for q, most in ((flow_queries.q75, 30), (flow_queries.q90, 40)):
        df = q(spark, DATA)
        plan, files = df._jdf.queryExecution().optimizedPlan(), df.inputFiles()
        assert files and not any("conversations.parquet" in f for f in files)
        assert plan.collectLeaves().size() <= most


@pytest.mark.parametrize(("path", "kinds"), [("CoT", {"LINEAR"}), ("ToT", {"FORK"}), ("GoT", set(graphs.GRAPH_TYPES))])
def test_paths_of_reasoning(spark, path, kinds):
    i = flow_queries.items(spark, DATA).limit(3)
    rows = assembly.nested(assembly.build(i, F.lit("train"), reasoning=path)).select("graph_type", "reasoning_path_type", "meta.reasoning_path_type").toDF("g", "r", "m").collect()
    assert {r.g for r in rows} == kinds and {(r.r, r.m) for r in rows} == {(path, path)}


def test_unknown_path_of_reasoning(spark):
    with pytest.raises(ValueError, match="unknown path"):
        assembly.build(flow_queries.items(spark, DATA), F.lit("train"), reasoning="x")


def test_round_trip_by_compressed_files(spark, written, tmp_path, monkeypatch):
    size = lambda path: sum(f.stat().st_size for f in path.rglob("part-*"))
    assembly.write(written, str(tmp_path / "plain"))
    monkeypatch.setattr(flow_queries, "scratch", lambda spark, what: str(tmp_path / what))
    got = flow_queries.q89(spark, DATA)
    files = list((tmp_path / "episodes").rglob("part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert 4 * size(tmp_path / "episodes") < size(tmp_path / "plain")
    assert got.count() == assembly.read(spark, str(tmp_path / "plain"), written.schema).count() > 0
