import random

from pyspark.sql import functions as F

from stratigraph.llm.provenance import content_evidence, copies, decide_declared, glob_regex, parse_attributes, provenance, shingles

WORDS = ["alpha", "beta", "gamma", "delta", "total", "rows", "item", "score", "value", "node", "edge", "limit", "shift", "batch"]


def source(seed, lines=40):
    r = random.Random(seed)
    return "\n".join(f"{r.choice(WORDS)}_{r.randint(1, 99)} = {r.choice(WORDS)}({r.choice(WORDS)}, {r.randint(1, 999)}) + {r.choice(WORDS)}.{r.choice(WORDS)}" for _ in range(lines))


def changed(text, seed, share):
    r = random.Random(seed)
    ls = text.split("\n")
    for i in r.sample(range(len(ls)), int(len(ls) * share)):
        ls[i] = source(seed * 1000 + i, 1)
    return "\n".join(ls)


def test_content_evidence():
    body = source(1)
    assert content_evidence(body, "py") == ""
    assert content_evidence("# Code generated by foogen v1. DO NOT EDIT.\n" + body, "py") == "generated"
    assert content_evidence("/*\n * Copyright X\n */\n\n// Fichier produit par l'outil de schéma, ne pas modifier.\n" + body, "ts") == "generated"
    assert content_evidence("HELP = 'Code generated by foogen. DO NOT EDIT.'\n" + body, "py") == ""
    assert content_evidence(body + "\n# @generated by x\n", "py") == ""
    assert content_evidence("// Auto-generated method stub\n" + body, "ts") == ""
    assert content_evidence("# Diese Datei wurde automatisch erzeugt (x).\n", "md") == ""
    assert content_evidence("var a=function(b){for(var c=0,d=[];c<b.length;c++)d.push(b[c]<<7);return d};" * 9, "js") == "minified"
    assert content_evidence("x = '" + "long text of a help message " * 40 + "'\n" + body, "js") == ""
    assert content_evidence("T = [\n" + "  0x1f, 42, 77,\n" * 30 + "]\n", "py") == "data"
    assert content_evidence("T = [\n" + '  "kJ8sdf9SDFkj2/x+s9f8sdf7",\n' * 30 + "]\n", "py") == "data"
    assert content_evidence("class A {\n" + "".join(f"  getA{i}() {{ return this.a[{i}]; }}\n  setA{i}(v) {{ this.a[{i}] = v; }}\n" for i in range(9)) + "}\n", "js") == "generated"
    assert content_evidence(None) == content_evidence("") == content_evidence("\n\n") == ""


def test_attributes():
    text = "# c\n*.pb.go linguist-generated\nlib/** -linguist-vendored !linguist-generated\n/gen/** linguist-generated=true\n*.py text\n"
    assert parse_attributes(text) == [("*.pb.go", "generated", True), ("lib/**", "vendored", False), ("lib/**", "generated", None), ("/gen/**", "generated", True)]
    import re

    for pat, yes, no in [("*.go", ["a.go", "x/a.go"], ["a.gob"]), ("/a/*.go", ["a/b.go"], ["a/c/b.go", "x/a/b.go"]), ("a/**/b", ["a/b", "a/c/d/b"], ["ab"]), ("gen/", [], ["gen/x", "y/gen/x/z", "gen.py", "gen/"]), ("gen/**", ["gen/x", "gen/x/z"], ["y/gen/x"]), ("**/gen/**", ["gen/x", "y/gen/x/z"], ["gen.py"]), ("f?[!a]", ["fxb"], ["fxa"])]:
        rx = glob_regex(pat)
        assert all(re.fullmatch(rx, p) for p in yes) and not any(re.fullmatch(rx, p) for p in no), pat
    files = [("", "*.ts linguist-generated\n*.js linguist-vendored"), ("a/", "*.ts -linguist-generated\nkeep.js -linguist-vendored\n*.js linguist-vendored")]
    assert decide_declared("x.ts", files[:1]) == "generated" and decide_declared("a/x.ts", files) == "none"
    back = [*files, ("a/b/", "*.ts !linguist-generated\n*.js linguist-vendored=false")]
    assert decide_declared("a/b/x.ts", back) is None and decide_declared("a/b/x.js", back) == "none" and decide_declared("a/x.ts", back) == "none"
    assert decide_declared("a/keep.js", files) == "vendored" and decide_declared("x.py", files) is None


def test_copies_equal_brute_force(spark):
    origin = [source(i) for i in range(6)]
    texts = [(i, t, True) for i, t in enumerate(origin)]
    for i, share in enumerate([0.02, 0.05, 0.1, 0.2, 0.4, 0.9] * 4):
        texts.append((100 + i, changed(origin[i % 6], i + 1, share), False))
    texts += [(200, "a b", False), (201, "", False), (202, source(77), False)]
    df = spark.createDataFrame(texts, "k1 long, content string, origin boolean").withColumn("k2", F.lit(0).cast("long"))
    got = {r.k1 for r in copies(df).collect()}
    assert got == {r.k1 for r in copies(df, block=500).collect()}
    sets = {i: set(shingles(t).tolist()) for i, t, _ in texts}
    want = {i for i, _, o in texts if not o for j in range(6) if (x := sets[i] & sets[j]) and len(x) >= 0.8 * min(len(sets[i]), len(sets[j])) and len(x) >= 0.5 * len(sets[i] | sets[j])}
    assert got == want and want


def test_frame(spark):
    lib = source(5)
    rows = [("r", "vendor/x/a.py", lib, 1), ("q", "src/a.py", changed(lib, 3, 0.03), 1), ("q", "src/same.py", lib, 1), ("q", "src/own.py", source(9), 1), ("q", "src/vendors/b.py", source(10), 1), ("q", "n.py", None, 1), ("q", "e.py", "", 1)]
    rows += [("q", "old.py", "# @generated by x\n", 1), ("q", "old.py", source(11), 2), ("q", "old.py", source(11), 2), (None, "z.py", "", 1), ("q", "README.md", "T = [1]", 1)]
    rows += [("d", ".gitattributes", "*.txt linguist-generated\nx.py -linguist-generated", 1), ("d", "a/b.txt", "x", 1), ("d", "x.py", "# @generated by x\n", 1), ("d", "y.py", "# @generated by x\n", 1)]
    for i in range(24):
        rows.append((f"m{i % 4}", f"p{i}_pb2.py", "# @generated by protoc\n" + source(i), 1))
    rows.append(("m5", "bare_pb2.py", source(400), 1))
    df = spark.createDataFrame(rows, "repo string, path string, content string, m int").withColumn("mtime", F.timestamp_seconds("m")).withColumn("ingested_at", F.col("mtime")).withColumn("k1", F.lit(1)).withColumn("ev", F.lit("x"))
    out = provenance(df).collect()
    got = {(r.repo, r.path): r.reason for r in out}
    assert len(out) == len(got) == len({(a, b) for a, b, *_ in rows if a})
    assert got["r", "vendor/x/a.py"] == "pattern" and got["q", "src/a.py"] == got["q", "src/same.py"] == "copied"
    assert all(got["q", p] == "" for p in ("src/own.py", "src/vendors/b.py", "n.py", "e.py", "old.py", "README.md"))
    assert got["d", "a/b.txt"] == "declared generated" and got["d", "x.py"] == "" and got["d", "y.py"] == "generated"
    assert got["m5", "bare_pb2.py"] == "" and got["m1", "p1_pb2.py"] == "generated"  # 24 of 25 are too few for a pattern
    assert provenance(df.limit(0)).count() == 0


def test_mined_patterns(spark):
    rows = [(f"r{i % 4}", f"a{i}.gen.ts", "generated") for i in range(60)] + [("r9", "b.gen.ts", "")] + [(f"r{i % 4}", f"dist/a{i}.ts", "") for i in range(60)]
    from stratigraph.llm.provenance import mined_patterns

    assert {r.pattern for r in mined_patterns(spark.createDataFrame(rows, "repo string, path string, reason string").withColumn("declared", F.lit(None).cast("string"))).collect()} == {"*.gen.ts"}


def test_declarations_teach_other_repositories(spark):
    """Nothing in the contents tells: repositories that declare an ending make it a pattern for those that do not."""
    rows = [(f"d{k}", ".gitattributes", "*_gen.go linguist-generated\n**/keep/** -linguist-generated", 1) for k in range(3)]
    rows += [(f"d{k}", f"api/x{i}_gen.go", source(100 * k + i), 1) for k in range(3) for i in range(8)]
    rows += [("d0", "keep/y_gen.go", source(900), 1), ("u", "p/z_gen.go", source(901), 1), ("u", "p/hand.go", source(902), 1), ("own", "a/.gitattributes", "* text", 1), ("own", "a/w_gen.go", source(903), 1)]
    df = spark.createDataFrame(rows, "repo string, path string, content string, m int").withColumn("mtime", F.timestamp_seconds("m")).withColumn("ingested_at", F.col("mtime"))
    got = {(r.repo, r.path): (r.reason, r.pattern) for r in provenance(df).collect()}
    assert got["d1", "api/x1_gen.go"][0] == "declared generated" and got["d0", "keep/y_gen.go"][0] == ""
    assert got["u", "p/hand.go"] == ("", None) and got["own", "a/w_gen.go"][0] == ""  # it has an attribute file of its own
    assert got["u", "p/z_gen.go"] == ("", None)  # 24 of 26: the declared contrary and the others count
    more = df.where("path != 'keep/y_gen.go' and repo != 'own' and repo != 'u'").unionByName(df.where("repo = 'u'"))
    fresh = {(r.repo, r.path): (r.reason, r.pattern) for r in provenance(more.unionByName(more.where("repo = 'd0'").withColumn("repo", F.lit("d9"))).unionByName(more.where("repo like 'd%'").withColumn("repo", F.concat(F.lit("e"), "repo"))), overlap=1.0, similarity=1.0).collect()}
    assert fresh["u", "p/z_gen.go"] == ("pattern", "*_gen.go") and fresh["u", "p/hand.go"][0] == ""
