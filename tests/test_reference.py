import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stratigraph.functions import text as X
from stratigraph.operators import graph as G
from stratigraph.operators import search as S
from stratigraph.plans.more import replace_partition
from stratigraph.plans.reference import delta, did_you_mean, longest_prefix


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("o")).first()[0]


def test_registry():
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100


def test_tokeniser(spark):
    assert one(spark, X.tokenize, "def getUserById(user_id):") == ["def", "getuserbyid", "get", "user", "by", "id", "user_id", "user", "id"]
    assert one(spark, X.tokenize, "HTTPServer2") == ["httpserver2", "http", "server", "2"] and one(spark, X.tokenize, None) == [] and one(spark, X.tokenize, "") == []


def test_scalars(spark):
    for p, w in {"tests/test_foo.py": 0.3, "legacy/foo.py": 0.3, "types/foo.d.ts": 0.7, "pkg/__init__.py": 0.5, "src/main.rs": 1.0}.items():
        assert one(spark, X.path_penalty, p) == pytest.approx(w)
    assert one(spark, X.symbol_name, "a::b.c") == "b.c" and one(spark, X.symbol_name, "a.b.c") == "c" and one(spark, X.base_type, " ns::Map<K, V>") == "Map"
    assert one(spark, X.is_symbol_query, "getUser") and one(spark, X.is_symbol_query, "a::b") and not one(spark, X.is_symbol_query, "where is it")
    assert one(spark, X.stem, "a/b.test.ts") == "b.test" and one(spark, X.stem, "a/.env") == ".env" and one(spark, X.extension, "a/B.PY") == "py" and one(spark, X.preview, "a\n b" * 200).endswith("…")
    assert one(spark, X.denied, "a/node_modules/x.js") and one(spark, X.denied, "x.min.js") and not one(spark, X.denied, "vendor") and not one(spark, X.denied, "a/b.js")


def test_bm25(spark):
    d = lambda *t: spark.createDataFrame(list(enumerate(t)), "id int, text string")
    q = lambda t: spark.createDataFrame([(1, t)], "qid int, text string")
    got = {r.id: r.score for r in S.bm25(d("hello world"), q("hello"), "id", "text").collect()}
    assert got == {0: pytest.approx(0.28768207, abs=1e-7)}
    once, twice = (S.bm25(d("foo bar"), q(t), "id", "text").first().score for t in ("foo", "foo foo"))
    assert twice == pytest.approx(2 * once)
    assert S.bm25(d("foo", None, ""), q("nothing"), "id", "text").count() == 0 and S.bm25(d("a").limit(0), q("a"), "id", "text").count() == 0


def test_fusion(spark):
    r = spark.createDataFrame([(10, 1), (20, 2), (30, 3), (10, 9)], "id int, rank int")
    assert {x.id: x.rrf for x in S.rrf(r).collect()} == {10: pytest.approx(1 / 61), 20: pytest.approx(1 / 62), 30: pytest.approx(1 / 63)}
    sem, lex = spark.createDataFrame([(1, 1.0), (2, 0.5)], "id int, rrf double"), spark.createDataFrame([(2, 0.4), (3, 0.6)], "id int, rrf double")
    assert {x.id: round(x.score, 9) for x in S.combine(sem, lex, 0.5).collect()} == {1: 0.5, 2: 0.45, 3: 0.3}


def test_lanes(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta gamma delta"), (3, "say someone else")], "id int, text string")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vid int, e array<double>")
    qv = lambda v: spark.createDataFrame([(v,)], "qv array<double>")
    run = lambda t, v, vs=vec: [(r.id, r.lane) for r in S.hybrid(docs, "id", "text", vs, "vid", "e", spark.createDataFrame([(1, t)], "qid int, text string"), qv(v), 5).orderBy("rank").collect()]
    assert sorted(run("delta", [1.0, 0.0])) == [(1, "fusion"), (2, "fusion")]
    assert run("delta", [9.0, 9.0]) == [(2, "bm25_only")] and run("unknown", [1.0, 0.0]) == [(1, "semantic_only")]
    assert run("meon", [9.0, 9.0]) == [(3, "substring")] and run("nowhere", [9.0, 9.0]) == [] and run("delta", [1.0]) == [(2, "bm25_only")]


def test_rerank_and_coherence(spark):
    d = spark.createDataFrame([(1, "a.py", 4.0), (2, "a.py", 3.0), (3, "tests/b.py", 5.0), (4, "a.py", 3.0)], "id int, path string, score double")
    assert [(r.id, r.score) for r in S.rerank(d, 9).orderBy("rank").collect()] == [(1, 4.0), (2, 1.5), (3, 1.5), (4, 0.75)]
    c = {r.id: r.score for r in S.coherence(d).collect()}
    assert c[1] == pytest.approx(4 + 0.2 * 5) and c[2] == 3 and c[3] == pytest.approx(5 + 0.2 * 5 * 5 / 10)


@pytest.mark.parametrize("seed", range(3))
def test_graph_against_brute_force(spark, seed):
    r = random.Random(seed)
    es = [(f"n{r.randint(0, 12)}", f"n{r.randint(0, 12)}") for _ in range(18)]
    e = spark.createDataFrame(es, "a string, b string")
    reach = {x: {x} for x in {n for p in es for n in p}}
    for _ in range(14):
        for a, b in es:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = {}
    for x in reach:
        comp = sorted(y for y in reach if y in reach[x] and x in reach[y])
        if len(comp) > 1:
            want[x] = comp[0]
    assert {x.id: x.component for x in G.strong_components(e).collect()} == want
    dist, front = {"n1": 0}, ["n1"]
    for d in (1, 2):
        front = sorted({b for a, b in es if a in front and b not in dist})
        dist |= {b: d for b in front}
    got = {x.id: x.depth for x in G.reach(e, spark.createDataFrame([("n1",)], "id string"), 2).collect()}
    assert got == {k: v for k, v in dist.items() if v}
    assert G.reach(e, spark.createDataFrame([], "id string"), 2).count() == 0 and G.strong_components(e.limit(0)).count() == 0


def test_joins(spark):
    names = spark.createDataFrame([("core-platform",), ("core",), ("zeta",)], "repo string")
    assert [r.repo for r in did_you_mean(names, "repo", "core-platfrm").collect()] == ["core", "core-platform", "zeta"]
    spec = spark.createDataFrame([("@o/a/sub/x",), ("@o/ab",), ("q",)], "s string")
    pre = spark.createDataFrame([("@o/a",), ("@o/a/sub",), ("q",)], "p string")
    assert {(r.s, r.p) for r in longest_prefix(spec, "s", pre, "p").collect()} == {("@o/a/sub/x", "@o/a/sub"), ("q", "q")}
    a, b = spark.createDataFrame([("1", "x"), ("2", None), ("3", "z")], "k string, h string"), spark.createDataFrame([("2", None), ("3", "y"), ("4", "w")], "k string, h string")
    assert {r.k: r.state for r in delta(a, b).collect()} == {"1": "added", "2": "same", "3": "modified", "4": "removed"}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "i int, k string"), spark.createDataFrame([(3, "a")], "i int, k string")
    assert {(r.i, r.k) for r in replace_partition(old, new, "k").collect()} == {(2, "b"), (3, "a")}


def test_nodes_and_edges(spark):
    cols = "id string, kind string, repo string, path string, symbol string, summary string, visibility string, native_kind string, loc_start int, loc_end int, deprecated boolean, recorded_at timestamp, deleted_at timestamp"
    n = lambda i, sym, at, gone=None: (i, "function", "r", "p", sym, None, None, None, 1, 2, False, at, gone)
    from datetime import datetime as D

    rows = [n(" A ", "oldName", D(2024, 1, 1)), n("a", "newName", D(2024, 2, 1)), n("a", "newName", D(2024, 2, 1)), n("b", "goneName", D(2024, 1, 1), D(2024, 3, 1)), n("", "x", D(2024, 1, 1)), n(None, "x", None), n("c", "newName2", None)]
    cur = G.current_nodes(spark.createDataFrame(rows, cols))
    assert {(r.id, r.symbol) for r in cur.collect()} == {("a", "newName"), ("c", "newName2")}
    e = G.current_edges(spark.createDataFrame([("A", " c", "calls", 0.5), ("a", "c", "calls", 0.7), ("a", None, "calls", 1.0), ("a", "b", "calls", None)], "from_id string, to_id string, kind string, confidence float"))
    assert {(r.from_id, r.to_id): r.confidence and round(r.confidence, 3) for r in e.collect()} == {("a", "c"): 0.7, ("a", "b"): None}
    assert [(r.src_symbol, r.dst_symbol) for r in G.hydrate(e, cur).collect()] == [("newName", "newName2")]
    assert {r.name for r in G.unique_names(cur, ["function"]).collect()} == {"newName", "newName2"}


def test_linked_cycles_are_all_found(spark):
    """Cycles that point to each other take a round each; none is left out."""
    from stratigraph.operators.graph import strong_components

    n = 4
    rows = [(f"a{i}", f"b{i}") for i in range(n)] + [(f"b{i}", f"a{i}") for i in range(n)] + [(f"a{i}", f"a{i + 1}") for i in range(n - 1)]
    got = {(r.id, r.component) for r in strong_components(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert got == {(f"{x}{i}", f"a{i}") for i in range(n) for x in "ab"}
