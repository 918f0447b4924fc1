import pytest
from pyspark.sql import functions as F

from stratigraph.llm.docpairs import comment_lines, inherited, meaningful, pairs, parents, source_comment

NOTHING = [
    ("parseNode", c)
    for c in (
        None, [], [""], ["/** */"], ["// ----------"], ["####"], ["// TODO"], ["// TODO: document"], ["# FIXME later on do better"], ["/* XXX */"], ["// n/a"], ['"""Parse node."""'], ["/** Parses the nodes */"], ["// parseNode"], ["// Parsing of a node."],
        ["/**", " * @param x", " * @return", " */"], ['"""', ":param x:", ":returns:", '"""'], ["// {@inheritDoc}"], ["// See above."], ["// See base class."], ["// Same as above."], ["// return compute(a, b);"], ["// x := next(it)"], ["// if (a) { b(); }"], ["// log.debug(item)"],
        ["// Copyright the authors.", "// All rights reserved."], ["# SPDX-License-Identifier: none"], ["// Auto-generated method stub"], ["/** @param rows the rows */"], ["// Write me."], ["..."], ["// wip"],
    )
] + [("copies_entries", ['"""Copy the entry"""']), ("x", ["// ~~~~"])]
SOMETHING = [
    ("parseNode", c)
    for c in (
        ["// Parses the node and drops stale rows."], ["/** Ties go to the smaller id. */"], ["/**", " * @param rows seconds to wait before giving up", " */"], ["// See above.", "// Runs in linear time."], ["// None once the lane is empty."], ["// 索引器会重写路径前缀。"], ["/// Этот модуль заменяет имена."],
        ['r"""Parse a node, but never twice."""'], ["// @return whether the second pass is needed"], ["// Copyright X.", "//", "// Blank keys are left alone."],
    )
]


@pytest.mark.parametrize("name,raw", NOTHING)
def test_says_nothing(name, raw):
    assert meaningful(raw, name) == ""


@pytest.mark.parametrize("name,raw", SOMETHING)
def test_says_something(name, raw):
    assert meaningful(raw, name) != ""


def test_source_comment():
    js = ["/**", " * A.", " */", "@Over", "function f() {", "", "// b", "", "function g() {"]
    assert comment_lines(source_comment(js, 4, "f", "js")) == ["", "A.", ""] and source_comment(js, 9, "g", "js") is None
    assert source_comment(["// a", "// b", "x()"], 3, "x", "go") == ["// a", "// b"]
    py = ["@d(1)", "def f(a=':', b=[1]", "      ) -> int:  # c", "    # note", '    """Doc', '    more."""', "    return 1"]
    assert comment_lines(source_comment(py, 1, "f", "py")) == ["Doc", "more."]
    assert source_comment(["def g():", "    return 'x'"], 1, "g", "py") is None and source_comment(py, 99, "f", "py") is None


def test_frame(spark):
    code = "class A:\n    def f(self):\n        '''Moves rows out of the lane.'''\n"
    rows = [
        (1, None, "class", "Base", [], [], 1), (2, 1, "method", "run", ["/** Drains the queue until it is empty. */"], [], 2), (3, None, "class", "Mid", [], ["Base<T>"], 5), (4, 3, "method", "run", ["/** {@inheritDoc} */"], [], 6),
        (5, None, "class", "Leaf", [], ["x.Mid"], 9), (6, 5, "method", "run", [], [], 10), (7, 5, "method", "other", [], [], 12), (8, None, "class", "Loop", [], ["Loop2"], 1), (9, None, "class", "Loop2", [], ["Loop"], 1), (10, 8, "method", "spin", [], [], 1),
        (11, None, "method", "f", None, [], 2), (12, None, "function", None, ["// Says a lot of things."], [], 1), (13, None, "ctor", "f", ["// Says a lot of things."], [], 1),
    ]
    d = spark.createDataFrame([(i, p, "r", "a.py", k, n, " def \n f ", doc, b, s) for i, p, k, n, doc, b, s in rows + rows[:2]], "decl_id int, parent_id int, repo string, path string, kind string, name string, signature string, docs array<string>, bases array<string>, start_line int")
    f = spark.createDataFrame([("r", "a.py", "old", 1), ("r", "a.py", code, 2), ("r", "a.py", code, 2)], "repo string, path string, content string, m int").withColumn("mtime", F.timestamp_seconds("m")).withColumn("ingested_at", F.col("mtime"))
    got = {r.decl_id: (r.origin, r.description) for r in pairs(d, f).collect()}
    text = "Drains the queue until it is empty."
    assert got == {2: ("own", text), 4: ("inherited", text), 6: ("inherited", text), 11: ("own", "Moves rows out of the lane."), 12: ("own", "Says a lot of things.")}
    assert {r.signature for r in pairs(d, f).collect()} == {"def f"}
    assert pairs(d.limit(0), f).count() == 0 and pairs(d, f.limit(0)).where("decl_id = 11").count() == 0


TYPES = "decl_id int, repo string, path string, name string, bases array<string>"


def test_bases_of_shared_names_are_counted_first(spark):
    """A thousand types of one name and a thousand that extend it: no pair is built; the same file decides, else nothing."""
    rows = [(i, "r", f"a{i}.ts", "Config", []) for i in range(1000)] + [(1000 + i, "r", f"a{i}.ts" if i < 3 else f"b{i}.ts", f"C{i}", ["Config"]) for i in range(1000)]
    rows += [(5000, "r", "z.ts", "Foo", []), (5001, "r", "y.ts", "Foo", ["lib.Foo"]), (5002, "q", "y.ts", "Foo", ["Foo"])]
    got = sorted((x.child, x.up) for x in parents(spark.createDataFrame(rows, TYPES)).collect())
    assert got == [(1000, 0), (1001, 1), (1002, 2), (5001, 5000)]


def test_deep_hierarchies_keep_their_descriptions(spark):
    n = 12
    types = spark.createDataFrame([(i, "r", "a.java", f"T{i}", [f"T{i - 1}"] if i else []) for i in range(n)], TYPES)
    methods = spark.createDataFrame([(100 + i, i, "run", "Says it." if i == 0 else "") for i in range(n)], "decl_id int, parent_id int, name string, description string")
    assert {(x.decl_id, x.description) for x in inherited(methods, types).collect()} == {(100 + i, "Says it.") for i in range(1, n)}


@pytest.mark.parametrize("base", ["Base", "Base<T, U>", "pkg.Base", "a::b::Base", "Base[K]", "Base(metaclass=M)", " Base "])
def test_spellings_of_bases(spark, base):
    types = spark.createDataFrame([(1, "r", "a", "Base", []), (2, "r", "b", "Sub", [base])], TYPES)
    assert [(x.child, x.up) for x in parents(types).collect()] == [(2, 1)]
