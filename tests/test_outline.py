import random

import pytest

from stratigraph.operators import outline as O
from stratigraph.sources.files import ignore_regex, json_rows, walk
from stratigraph.streaming.files import current_chunks, ingest

CASES = {
    "go": ('package a\ntype Auth struct {\n\tx int\n}\nfunc (a *Auth) Login(u string) error {\n\treturn nil // }\n}\nfunc helper() {}\n', [("struct", "Auth", 2, 7, "public"), ("method", "Login", 5, 7, "public"), ("function", "helper", 8, 8, "private")]),
    "rs": ("pub struct P { x: i32 }\nimpl P {\n    pub fn get(&self) -> i32 { 1 }\n    fn set(&self) {}\n}\nfn free() {}\n", [("struct", "P", 1, 5, "public"), ("method", "get", 3, 3, "public"), ("method", "set", 4, 4, "private"), ("function", "free", 6, 6, "private")]),
    "java": ('class A extends B {\n    @Over\n    private int f(int x) {\n        String s = "}";\n        return x;\n    }\n    A() { }\n}\n', [("class", "A", 1, 8, "public"), ("method", "f", 2, 6, "private"), ("ctor", "A", 7, 7, "public")]),
    "ts": ("export class A<T> extends B {\n  constructor() { }\n  private f(x: number): void {\n    if (x) { }\n  }\n}\nexport const g = (a) => { return a };\nfunction h() { function inner() {} }\ninterface I { }\n", [("class", "A", 1, 6, "public"), ("ctor", "constructor", 2, 2, "public"), ("method", "f", 3, 5, "private"), ("function", "g", 7, 7, "public"), ("function", "h", 8, 8, "public"), ("interface", "I", 9, 9, "public")]),
    "swift": ("class A: B {\n  func f() { }\n}\nprotocol P { }\nextension A { }\n", [("class", "A", 1, 3, "public"), ("method", "f", 2, 2, "public"), ("interface", "P", 4, 4, "public"), ("class", "A", 5, 5, "public")]),
    "m": ("@interface Foo : NSObject\n- (void)doThing:(int)x;\n@end\n@protocol P\n@end\n", [("class", "Foo", 1, 3, "public"), ("method", "doThing:", 2, 2, "public"), ("interface", "P", 4, 5, "public")]),
    "kt": ("class A {\n  fun f(x: Int) { }\n}\nfun g() { }\n", [("class", "A", 1, 3, "public"), ("method", "f", 2, 2, "public"), ("function", "g", 4, 4, "public")]),
    "scala": ("object A {\n  def f(x: Int) = { x }\n}\ntrait T { }\n", [("class", "A", 1, 3, "public"), ("method", "f", 2, 2, "public"), ("interface", "T", 4, 4, "public")]),
    "cs": ("namespace N {\n  public class A {\n    public int F(int x) { return x; }\n  }\n}\n", [("namespace", "N", 1, 5, "public"), ("class", "A", 2, 4, "public"), ("method", "F", 3, 3, "public")]),
}


@pytest.mark.parametrize("ext", CASES)
def test_brace_languages(ext):
    text, want = CASES[ext]
    got = [(r[0], r[1], r[4], r[5], r[6]) for r in O.brace_outline(text, ext)]
    assert got == want


def test_python():
    text = "X = 1\n@d\nclass A(B, C):\n    '''Doc.'''\n    y: int = 2\n    def __init__(self): pass\n    @property\n    def p(self): return 1\n    def _q(self): pass\nasync def f(): pass\n"
    got = [(r[0], r[2], r[4], r[6]) for r in O.python_outline(text)]
    assert got == [("field", "X", 1, "public"), ("class", "A", 2, "public"), ("field", "A.y", 5, "public"), ("ctor", "A.__init__", 6, "public"), ("property", "A.p", 7, "public"), ("method", "A._q", 9, "private"), ("function", "f", 10, "public")]
    assert O.python_outline("def f(:") == [] and O.python_outline(text)[1][7] == ["B", "C"]


@pytest.mark.parametrize("seed", range(4))
def test_chunks_cover_the_text(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["def f():\n", "    x = 1\n", "\n", "é" * r.randint(1, 400) + "\n", "# h\n"]) for _ in range(200))
    out = O.chunk_text(text, 300)
    raw = text.encode()
    assert b"".join(raw[b : b + len(c.encode())] for b, _, _, c in out).decode().split() == text.split()
    assert all(raw[b : b + len(c.encode())].decode() == c and text.split("\n")[a - 1] == c.split("\n")[0] for b, a, _, c in out)
    assert all(len(c.encode()) <= 300 or len(O.split_regions(c, False)) == 1 for *_, c in out)


def test_frames_idl_and_manifests(spark):
    rows = [
        ("r", "u.proto", 'syntax = "proto3";\npackage user.v1;\nservice Users {\n  rpc Get(GetReq) returns (GetRes);\n  rpc List(stream ListReq) returns (stream ListRes) { option x = 1; }\n}\n'),
        ("r", "u.thrift", "namespace go user\nservice Users extends Base {\n  GetRes Get(1: GetReq req)\n  i32 Two(1: A a, 2: B b)\n}\n"),
        ("r", "package.json", '{"name": "@o/a", "main": "x"}'), ("r", "Cargo.toml", '[package]\nname = "c"\n'), ("r", "go.mod", "module ex.com/m\n\ngo 1.2\n"), ("r", "n.py", None), ("r", "a.py", "def f(): pass\n"),
    ]
    f = spark.createDataFrame(rows, "repo string, path string, content string")
    p = {(x.package, x.service, x.method, x.input, x.output) for x in O.proto_methods(f).collect()}
    assert p == {("user.v1", "Users", "Get", "GetReq", "GetRes"), ("user.v1", "Users", "List", "ListReq", "ListRes")}
    assert {(x.method, x.input, x.output) for x in O.thrift_methods(f).collect()} == {("Get", "GetReq", "GetRes")}
    assert {x.package for x in O.package_names(f).collect()} == {"@o/a", "c", "ex.com/m"}
    assert [(x.path, x.name) for x in O.declarations(f.where("path like '%.py'")).collect()] == [("a.py", "f")]
    a, b = O.chunks(f).collect(), O.chunks(f.where("path = 'a.py'")).collect()
    assert {x.id for x in b} <= {x.id for x in a} and O.chunks(f.limit(0)).count() == 0


def test_walk_and_stream(spark, tmp_path):
    root = tmp_path / "ws"
    for p in ("a/src/x.py", "a/node_modules/y.js", "a/log/z.txt", "a/keep.log", "a/drop.log", "b/app.min.js", "b/m.go"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("def f(): pass\n")
    got = {(r.repo, r.path) for r in walk(spark, str(root), ["log/", "*.log", "!keep.log"]).collect()}
    assert got == {("a", "src/x.py"), ("a", "keep.log"), ("b", "m.go")}
    assert ignore_regex(["# c", ""]) == []
    assert json_rows(spark.createDataFrame([(1,)], "a int")).first()[0] == '{"schema_version":1,"row":{"a":1}}'
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "repo string, path string, content string, mtime timestamp"
    put = lambda rows: spark.createDataFrame(rows, "repo string, path string, content string, m long").selectExpr("repo", "path", "content", "timestamp_seconds(m) mtime").coalesce(1).write.mode("append").parquet(src)
    put([("r", "a.py", "x = 1\n", 1), ("r", "b.py", "y = 1\n", 1)])
    ingest(spark.readStream.schema(schema).parquet(src), out, ck).awaitTermination()
    put([("r", "a.py", "x = 2\n", 2)])
    ingest(spark.readStream.schema(schema).parquet(src), out, ck).awaitTermination()
    assert sorted(r.content for r in current_chunks(spark, out).collect()) == ["x = 2\n", "y = 1\n"]
