"""Queries of graph, lookup, linking and aggregation operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratigraph.functions import text as X
from stratigraph.operators import graph as G
from stratigraph.session import table

# Fixed values of the registered queries: what is looked up.
NEEDLE, SYMBOL_PART, DEPTH = "shard", "lookup", 2

ND = """nd AS (SELECT id, kind, repo, path, symbol, summary, visibility, native_kind, loc_start, loc_end, deprecated FROM (
  SELECT lower(trim(id)) AS id, kind, repo, path, symbol, summary, visibility, native_kind, loc_start, loc_end, deprecated, deleted_at,
    row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY recorded_at DESC NULLS LAST, kind DESC NULLS LAST, repo DESC NULLS LAST, path DESC NULLS LAST, symbol DESC NULLS LAST, loc_start DESC NULLS LAST, deleted_at DESC NULLS LAST) AS rn
  FROM nodes WHERE trim(id) <> '') WHERE rn = 1 AND deleted_at IS NULL)"""
ED = """ed AS (SELECT lower(trim(from_id)) AS from_id, lower(trim(to_id)) AS to_id, kind, max(CAST(confidence AS DOUBLE)) AS confidence FROM edges WHERE trim(from_id) <> '' AND trim(to_id) <> '' GROUP BY 1, 2, 3)"""
CF = """cf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY mtime DESC NULLS LAST, ingested_at DESC NULLS LAST) AS rn FROM files) WHERE rn = 1)"""
CH = "ch AS (SELECT DISTINCT id, repo, path, start_line, end_line, content, language FROM chunks)"
DC = "dc AS (SELECT DISTINCT decl_id, parent_id, repo, path, depth, ordinal, qualified_name, kind, name, visibility, bases, start_line, end_line, docs FROM declarations)"
STEM = r"regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1')"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def nodes(s, d):
    return G.current_nodes(table(s, d, "nodes"))


def edges(s, d):
    return G.current_edges(table(s, d, "edges"))


def current_files(s, d, *cols):
    """Current versions; only the columns asked for are read."""
    f = table(s, d, "files")
    order = F.struct("mtime", "ingested_at")
    return f.groupBy("repo", "path").agg(F.max_by(F.struct(*cols), order).alias("c")).select("repo", "path", *[F.col(f"c.{c}").alias(c) for c in cols])


def chunks(s, d, *cols):
    return table(s, d, "chunks").select("id", *cols).distinct()


def decls(s, d, *cols):
    return table(s, d, "declarations").select("decl_id", *cols).distinct()


# ---- scans and filters


@query("s4_denylist", f"WITH {CF} SELECT repo, path FROM cf WHERE len(list_intersect(string_split(path, '/')[:-2], {X.DENY_DIRS})) > 0 OR regexp_matches(lower(regexp_extract(path, '[^/]*$')), '({'|'.join(e.replace('.', chr(92) + '.') for e in X.DENY_ENDS)})$')")
def s4_denylist(s, d):
    return table(s, d, "files").select("repo", "path").distinct().where(X.denied(F.col("path")))


@query("s5_indexable", f"WITH {CF} SELECT lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext, count(*) AS files FROM cf WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ({', '.join(repr(k) for k in X.LANGUAGE_OF)}) GROUP BY 1")
def s5_indexable(s, d):
    f = table(s, d, "files").select("repo", "path").distinct().where(X.language_of(F.col("path")).isNotNull())
    return f.groupBy(X.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files"))


@query("s11_nodes_by_kind", f"WITH {ND} SELECT kind, repo, count(*) AS n FROM nd GROUP BY 1, 2")
def s11_nodes_by_kind(s, d):
    return nodes(s, d).groupBy("kind", "repo").agg(F.count("*").alias("n"))


@query("s12_chunk_scan", f"WITH {CH} SELECT id, path, start_line, end_line FROM ch WHERE repo = 'core-platform'")
def s12_chunk_scan(s, d):
    return table(s, d, "chunks").where("repo = 'core-platform'").select("id", "path", "start_line", "end_line").distinct()


@query("s14_json_rows", f"""WITH {ND} SELECT id, '{{"schema_version":1,"kind":"' || kind || '","repo":"' || repo || '"}}' AS js FROM nd WHERE kind = 'type'""")
def s14_json_rows(s, d):
    return nodes(s, d).where("kind = 'type'").select("id", F.to_json(F.struct(F.lit(1).alias("schema_version"), "kind", "repo")).alias("js"))


@query("f1_symbol_substring", f"WITH {ND} SELECT id, kind, repo, path, symbol FROM nd WHERE kind IN ('type','method','function','idlmethod','idlservice') AND (contains(lower(symbol), '{NEEDLE}') OR contains(lower(path), '{NEEDLE}')) ORDER BY repo, path, symbol NULLS FIRST, id LIMIT 20")
def f1_symbol_substring(s, d):
    hit = F.contains(F.lower("symbol"), F.lit(NEEDLE)) | F.contains(F.lower("path"), F.lit(NEEDLE))
    return nodes(s, d).where(F.col("kind").isin(G.CODE_KINDS) & hit).orderBy("repo", "path", "symbol", "id").limit(20).select("id", "kind", "repo", "path", "symbol")


@query("f2_exact_symbol", f"WITH {ND} SELECT id, repo, path FROM nd WHERE symbol IN (SELECT symbol FROM nd WHERE symbol IS NOT NULL GROUP BY symbol ORDER BY count(*) DESC, symbol LIMIT 1)")
def f2_exact_symbol(s, d):
    n = nodes(s, d)
    name = n.where("symbol is not null").groupBy("symbol").count().orderBy(F.desc("count"), "symbol").limit(1).select("symbol")
    return n.join(F.broadcast(name), "symbol", "left_semi").select("id", "repo", "path")


@query("f4_nodes_at_path", f"WITH {ND}, p AS (SELECT repo, path FROM nd GROUP BY 1, 2 ORDER BY count(*) DESC, repo, path LIMIT 3) SELECT id, kind, symbol FROM nd JOIN p USING (repo, path)")
def f4_nodes_at_path(s, d):
    n = nodes(s, d)
    p = n.groupBy("repo", "path").count().orderBy(F.desc("count"), "repo", "path").limit(3)
    return n.join(F.broadcast(p), ["repo", "path"], "left_semi").select("id", "kind", "symbol")


@query("f5_batch_by_ids", f"WITH {ND} SELECT id, kind, symbol FROM nd WHERE id IN (SELECT DISTINCT lower(trim(node_id)) FROM context_items)")
def f5_batch_by_ids(s, d):
    ids = table(s, d, "context_items").select(F.lower(F.trim("node_id")).alias("id")).distinct()
    return nodes(s, d).join(ids, "id", "left_semi").select("id", "kind", "symbol")


@query("f6_distinct_repos", f"WITH {ND} SELECT DISTINCT repo FROM nd")
def f6_distinct_repos(s, d):
    return nodes(s, d).select("repo").distinct()


@query("f8_did_you_mean", f"WITH {ND}, r AS (SELECT DISTINCT repo FROM nd), c AS (SELECT repo, CASE WHEN lower(repo) = 'core-platfrm' THEN 0 WHEN contains(lower(repo), 'core-platfrm') OR contains('core-platfrm', lower(repo)) THEN 1 ELSE 2 + levenshtein(lower(repo), 'core-platfrm') END AS score FROM r) SELECT repo, score FROM c WHERE score <= 14 ORDER BY score, repo LIMIT 5")
def f8_did_you_mean(s, d):
    return did_you_mean(nodes(s, d).select("repo").distinct(), "repo", "core-platfrm")


def did_you_mean(names, col: str, asked: str, limit: int = 5):
    """The closest known names: equal, containing each other, else by edit distance up to the length plus 2."""
    a, b = F.lower(F.col(col)), F.lit(asked.lower())
    score = F.when(a == b, 0).when(F.contains(a, b) | F.contains(b, a), 1).otherwise(2 + F.levenshtein(a, b))
    return names.select(col, score.cast("bigint").alias("score")).where(F.col("score") <= len(asked) + 2).orderBy("score", col).limit(limit)


@query("f10_noise_names", f"WITH {ND} SELECT DISTINCT symbol FROM nd WHERE kind IN ('function','method') AND length(symbol) >= 4 AND NOT regexp_full_match(symbol, '[a-z]+')")
def f10_noise_names(s, d):
    return nodes(s, d).where("kind in ('function','method') and length(symbol) >= 4 and not symbol rlike '^[a-z]+$'").select("symbol").distinct()


@query("f11_server_paths", f"WITH {ND} SELECT DISTINCT repo, path FROM nd WHERE regexp_matches(lower(path), '(services?/|handlers?/|impl/|server/)') AND regexp_matches(lower(path), '\\.(go|py|rs|java|kt|scala)$')")
def f11_server_paths(s, d):
    p = F.lower("path")
    return nodes(s, d).where(p.rlike(r"(services?/|handlers?/|impl/|server/)") & p.rlike(r"\.(go|py|rs|java|kt|scala)$")).select("repo", "path").distinct()


@query("f13_visibility", f"WITH {DC} SELECT decl_id, kind, name FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, parent_id ORDER BY ordinal, decl_id) AS rn FROM dc WHERE coalesce(visibility, '') <> 'private' AND kind NOT IN ('field', 'heading')) WHERE rn <= 5")
def f13_visibility(s, d):
    x = decls(s, d, "repo", "path", "parent_id", "kind", "name", "visibility", "ordinal").where("coalesce(visibility, '') <> 'private' and kind not in ('field', 'heading')")
    w = Window.partitionBy("repo", "path", "parent_id").orderBy("ordinal", "decl_id")
    return x.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("decl_id", "kind", "name")


@query("f14_chunk_at_line", f"WITH {CH}, q AS (SELECT DISTINCT repo, path, start_line AS line, decl_id FROM declarations) SELECT decl_id, id FROM (SELECT decl_id, id, row_number() OVER (PARTITION BY decl_id ORDER BY CASE WHEN line < end_line THEN 0 ELSE 1 END, id) AS rn FROM q JOIN ch USING (repo, path) WHERE start_line <= line AND line <= end_line) WHERE rn = 1")
def f14_chunk_at_line(s, d):
    q = table(s, d, "declarations").select("repo", "path", F.col("start_line").alias("line"), "decl_id").distinct()
    j = q.join(chunks(s, d, "repo", "path", "start_line", "end_line"), ["repo", "path"]).where("start_line <= line and line <= end_line")
    return j.groupBy("decl_id").agg(F.min_by("id", F.struct(F.when(F.col("line") < F.col("end_line"), 0).otherwise(1), "id")).alias("id"))


@query("f16_preview", f"WITH {CH}, c AS (SELECT id, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS t FROM ch) SELECT id, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '…' ELSE t END AS preview FROM c")
def f16_preview(s, d):
    return chunks(s, d, "content").select("id", X.preview(F.col("content")).alias("preview"))


@query("f17_substring_chunks", f"WITH {CH} SELECT id, 1.0::DOUBLE AS score FROM ch WHERE contains(lower(content), 'resolve') ORDER BY id LIMIT 25")
def f17_substring_chunks(s, d):
    return chunks(s, d, "content").where(F.contains(F.lower("content"), F.lit("resolve"))).orderBy("id").limit(25).select("id", F.lit(1.0).alias("score"))


# ---- joins


@query("j1_hydrate", f"WITH {ND}, {ED} SELECT from_id, to_id, ed.kind AS kind, round(confidence, 6) AS confidence, a.symbol AS src_symbol, b.symbol AS dst_symbol FROM ed JOIN nd a ON a.id = from_id JOIN nd b ON b.id = to_id WHERE ed.kind = 'calls'")
def j1_hydrate(s, d):
    h = G.hydrate(edges(s, d).where("kind = 'calls'"), nodes(s, d))
    return h.select("from_id", "to_id", "kind", F.round("confidence", 6).alias("confidence"), "src_symbol", "dst_symbol")


_CALLEES = r"list_distinct(regexp_extract_all(regexp_replace(coalesce(content, ''), '\"(\\.|[^\"\\\n])*\"|''(\\.|[^''\\\n])*''|//[^\n]*|#[^\n]*|(def|func|fn|function)\s+[A-Za-z_]\w*', ' ', 'g'), '([A-Za-z_]\w*)\s*\(', 1))"


def callees(content):
    """Names that are called in a text, after strings, comments and heads of definitions are taken out."""
    clean = F.regexp_replace(F.coalesce(content, F.lit("")), r"\"(\\.|[^\"\\\n])*\"|'(\\.|[^'\\\n])*'|//[^\n]*|#[^\n]*|(def|func|fn|function)\s+[A-Za-z_]\w*", " ")
    return F.array_distinct(F.regexp_extract_all(clean, F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1)))


@query("gen17_call_names", f"WITH {CF} SELECT repo, path, len({_CALLEES}) AS callees FROM cf WHERE regexp_matches(path, '\\.(ts|js|py|go|rs)$')")
def gen17_call_names(s, d):
    f = current_files(s, d, "content").where(F.col("path").rlike(r"\.(ts|js|py|go|rs)$"))
    return f.select("repo", "path", F.size(callees(F.col("content"))).cast("bigint").alias("callees"))


@query("j2_calls_linker", f"WITH {ND}, {CF}, u AS (SELECT symbol AS name, min(id) AS to_id FROM nd WHERE kind IN ('function','method') AND length(symbol) >= 4 AND NOT regexp_full_match(symbol, '[a-z]+') GROUP BY 1 HAVING count(DISTINCT id) = 1), c AS (SELECT repo, path, unnest({_CALLEES}) AS name FROM cf WHERE regexp_matches(path, '\\.(ts|js|py|go|rs)$')) SELECT DISTINCT repo, path, to_id FROM c JOIN u USING (name)")
def j2_calls_linker(s, d):
    f = current_files(s, d, "content").where(F.col("path").rlike(r"\.(ts|js|py|go|rs)$"))
    c = f.select("repo", "path", F.explode(callees(F.col("content"))).alias("name"))
    return c.join(G.unique_names(nodes(s, d), ["function", "method"]), "name").select("repo", "path", F.col("id").alias("to_id")).distinct()


@query("j3_name_linker", f"WITH {ND}, m AS (SELECT id, symbol, count(*) OVER (PARTITION BY symbol) AS n FROM nd WHERE kind = 'function' AND symbol IS NOT NULL) SELECT id, CASE WHEN n >= 2 THEN 0.35 ELSE 0.7 END::DOUBLE AS confidence FROM m")
def j3_name_linker(s, d):
    n = F.count("*").over(Window.partitionBy("symbol"))
    return nodes(s, d).where("kind = 'function' and symbol is not null").select("id", (F.lit(0.7) * F.when(n >= 2, 0.5).otherwise(1.0)).alias("confidence"))


_IMPORTS = r"regexp_extract_all(coalesce(content, ''), '(?m)^(?:import|from|use)\s+(?:type\s+)?(?:\{[^}]*\}\s+from\s+)?[\"'']?([\w./:@-]+)', 1)"


def imports(content):
    """Import specifiers, one per import line."""
    return F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"(?m)^(?:import|from|use)\s+(?:type\s+)?(?:\{[^}]*\}\s+from\s+)?[\"']?([\w./:@-]+)"), F.lit(1))


@query("gen18_imports", f"WITH {CF}, i AS (SELECT repo, path, unnest({_IMPORTS}) AS spec FROM cf) SELECT spec, count(*) AS n FROM i GROUP BY 1")
def gen18_imports(s, d):
    return current_files(s, d, "content").select(F.explode(imports(F.col("content"))).alias("spec")).groupBy("spec").agg(F.count("*").alias("n"))


@query("j4_prefix_join", f"WITH {CF}, i AS (SELECT DISTINCT unnest({_IMPORTS}) AS spec FROM cf), p AS (SELECT DISTINCT regexp_extract(path, '^[^/]*') AS pre FROM cf UNION SELECT DISTINCT regexp_extract(path, '^[^/]*/[^/]*') FROM cf UNION SELECT '../types' UNION SELECT '..') SELECT spec, pre FROM (SELECT spec, pre, row_number() OVER (PARTITION BY spec ORDER BY length(pre) DESC) AS rn FROM i JOIN p ON spec = pre OR starts_with(spec, pre || '/') WHERE pre <> '') WHERE rn = 1")
def j4_prefix_join(s, d):
    spec = current_files(s, d, "content").select(F.explode(imports(F.col("content"))).alias("spec")).distinct()
    path = table(s, d, "files").select("path").distinct()
    pre = path.select(F.regexp_extract("path", "^[^/]*", 0).alias("pre")).unionByName(path.select(F.regexp_extract("path", "^[^/]*/[^/]*", 0).alias("pre"))).unionByName(s.createDataFrame([("../types",), ("..",)], "pre string")).where("pre != ''").distinct()
    return longest_prefix(spec, "spec", pre, "pre")


def longest_prefix(left, key: str, prefixes, pre: str):
    """Longest whole-segment prefix of each key: an equi-join on its exploded prefixes, never a theta join."""
    part = F.split(F.col(key), "/")
    cand = left.withColumn(pre, F.explode(F.transform(F.sequence(F.lit(1), F.size(part)), lambda i: F.array_join(F.slice(part, 1, i), "/"))))
    return cand.join(prefixes, pre).groupBy(key).agg(F.max_by(pre, F.length(pre)).alias(pre))


@query("j6_relative_imports", f"WITH {CF}, i AS (SELECT DISTINCT repo, path, unnest(regexp_extract_all(coalesce(content, ''), 'from [\"'']\\./([\\w-]+)[\"'']', 1)) AS n FROM cf), c AS (SELECT repo, path, regexp_replace(path, '[^/]*$', '') || n AS base FROM i), x AS (SELECT repo, path, base || e AS target, o FROM c, (VALUES ('.ts', 1), ('.js', 3), ('/index.ts', 6)) v(e, o)) SELECT repo, path, target FROM (SELECT x.*, row_number() OVER (PARTITION BY x.repo, x.path, regexp_replace(target, '(\\.ts|\\.js|/index\\.ts)$', '') ORDER BY o) AS rn FROM x JOIN (SELECT repo AS r2, path AS p2 FROM cf) f ON r2 = x.repo AND p2 = target) WHERE rn = 1")
def j6_relative_imports(s, d):
    f = current_files(s, d, "content")
    i = f.select("repo", "path", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"from [\"']\./([\w-]+)[\"']"), F.lit(1)))).alias("n"))
    base = F.concat(F.regexp_replace("path", r"[^/]*$", ""), "n")
    c = i.select("repo", "path", base.alias("base"), F.posexplode(F.transform(F.array(*[F.lit(e) for e in (".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts")]), lambda e: F.concat(base, e))).alias("o", "target"))
    have = table(s, d, "files").select("repo", F.col("path").alias("target")).distinct()
    return c.join(have, ["repo", "target"]).groupBy("repo", "path", "base").agg(F.min_by("target", "o").alias("target")).select("repo", "path", "target")


@query("j7_hit_to_node", f"WITH {ND}, {CH}, j AS (SELECT c.id, n.id AS node, CASE WHEN n.kind IN ('function','method','type') THEN 0 ELSE 1 END AS tier, n.loc_start FROM ch c JOIN nd n USING (repo, path) WHERE (n.kind IN ('function','method','type') AND n.loc_start BETWEEN c.start_line AND c.end_line) OR n.kind = 'module') SELECT id, node FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, loc_start DESC NULLS LAST, node) AS rn FROM j) WHERE rn = 1")
def j7_hit_to_node(s, d):
    n = nodes(s, d).where("kind in ('function','method','type','module')").select("repo", "path", F.col("id").alias("node"), "kind", "loc_start")
    c = chunks(s, d, "repo", "path", "start_line", "end_line")
    j = c.join(n, ["repo", "path"]).where("kind = 'module' or loc_start between start_line and end_line")
    key = F.struct(F.when(F.col("kind") == "module", 1).otherwise(0), -F.coalesce("loc_start", F.lit(-1)), "node")
    return j.groupBy("id").agg(F.min_by("node", key).alias("node"))


@query("j8_chunk_vectors", f"WITH {CH} SELECT ch.repo, count(*) AS n FROM ch JOIN (SELECT DISTINCT chunk_id FROM chunk_vec) v ON v.chunk_id = ch.id GROUP BY 1")
def j8_chunk_vectors(s, d):
    v = table(s, d, "chunk_vec").select(F.col("chunk_id").alias("id")).distinct()
    return chunks(s, d, "repo").join(v, "id", "left_semi").groupBy("repo").agg(F.count("*").alias("n"))


@query("j10_cross_repo_edges", f"WITH {ND}, {ED} SELECT from_id, to_id, ed.kind AS kind, a.repo AS src_repo, b.repo AS dst_repo FROM ed JOIN nd a ON a.id = from_id JOIN nd b ON b.id = to_id WHERE ed.kind IN ('imports','invokes','implements','calls') AND a.repo <> b.repo")
def j10_cross_repo_edges(s, d):
    h = G.hydrate(edges(s, d).where("kind in ('imports','invokes','implements','calls')"), nodes(s, d))
    return h.where("src_repo <> dst_repo").select("from_id", "to_id", "kind", "src_repo", "dst_repo")


@query("j11_dangling_edges", f"WITH {ND}, {ED} SELECT from_id, to_id, kind FROM ed WHERE from_id NOT IN (SELECT id FROM nd) OR to_id NOT IN (SELECT id FROM nd)")
def j11_dangling_edges(s, d):
    ids, e = nodes(s, d).select("id"), edges(s, d).select("from_id", "to_id", "kind")
    ok = e.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").withColumn("ok", F.lit(1))
    return e.join(ok, ["from_id", "to_id", "kind"], "left").where("ok is null").drop("ok")


@query("j13_implementations", f"WITH {DC}, b AS (SELECT decl_id, repo, name, unnest(bases) AS raw FROM dc WHERE len(bases) > 0) SELECT repo, regexp_replace(regexp_replace(trim(raw), '[<\\[].*$', ''), '^.*(::|\\.)', '') AS base, count(*) AS types FROM b GROUP BY 1, 2")
def j13_implementations(s, d):
    b = decls(s, d, "repo", "name", "bases").withColumn("raw", F.explode("bases")).select("repo", X.base_type(F.col("raw")).alias("base"))
    return b.groupBy("repo", "base").agg(F.count("*").alias("types"))


@query("j14_delta", """WITH now AS (SELECT CAST(id AS VARCHAR) AS k, max(lower(trim(chunk_hash))) AS h FROM chunks GROUP BY 1), old AS (SELECT record_key AS k, max(lower(trim(seen_hash))) AS h FROM run_manifest WHERE record_kind = 'chunk' AND run_id = 1 GROUP BY 1)
SELECT coalesce(now.k, old.k) AS k, CASE WHEN old.k IS NULL THEN 'added' WHEN now.k IS NULL THEN 'removed' WHEN now.h IS DISTINCT FROM old.h THEN 'modified' ELSE 'same' END AS state FROM now FULL JOIN old ON now.k = old.k""")
def j14_delta(s, d):
    h = lambda c: F.max(F.lower(F.trim(c)))
    now = table(s, d, "chunks").groupBy(F.col("id").cast("string").alias("k")).agg(h("chunk_hash").alias("h"))
    old = table(s, d, "run_manifest").where("record_kind = 'chunk' and run_id = 1").groupBy(F.col("record_key").alias("k")).agg(h("seen_hash").alias("h"))
    return delta(now, old)


def delta(now, old):
    """k, state: added, removed, modified or same, from (k, h) of both sides."""
    a, b = now.select("k", F.col("h").alias("h1"), F.lit(1).alias("in1")), old.select("k", F.col("h").alias("h2"), F.lit(1).alias("in2"))
    j = a.join(b, "k", "full_outer")
    return j.select("k", F.when(F.col("in2").isNull(), "added").when(F.col("in1").isNull(), "removed").when(~F.col("h1").eqNullSafe(F.col("h2")), "modified").otherwise("same").alias("state"))


# ---- aggregations


@query("a2_counts", f"WITH {ND}, {ED} SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM ed) AS edges")
def a2_counts(s, d):
    return nodes(s, d).agg(F.count("*").alias("nodes")).crossJoin(edges(s, d).agg(F.count("*").alias("edges")))


@query("a3_unique_names", f"WITH {ND} SELECT symbol AS name, min(id) AS id FROM nd WHERE kind IN ('function','method') AND length(symbol) >= 4 AND NOT regexp_full_match(symbol, '[a-z]+') GROUP BY 1 HAVING count(DISTINCT id) = 1")
def a3_unique_names(s, d):
    return G.unique_names(nodes(s, d), ["function", "method"])


@query("a4_upsert_merge", "WITH n AS (SELECT lower(trim(id)) AS id, summary, visibility, loc_start, deprecated, recorded_at FROM nodes WHERE trim(id) <> '' AND recorded_at IS NOT NULL) SELECT id, arg_max(visibility, recorded_at) FILTER (WHERE visibility IS NOT NULL) AS visibility, max(recorded_at) AS recorded_at FROM n GROUP BY 1")
def a4_upsert_merge(s, d):
    n = table(s, d, "nodes").withColumn("id", F.lower(F.trim("id"))).where("id != '' and recorded_at is not null")
    return n.groupBy("id").agg(F.max_by("visibility", F.when(F.col("visibility").isNotNull(), F.col("recorded_at"))).alias("visibility"), F.max("recorded_at").alias("recorded_at"))


_PAIRS = "pr AS (SELECT a.repo AS src_repo, b.repo AS dst_repo, ed.kind AS kind, count(*) AS n FROM ed JOIN nd a ON a.id = from_id JOIN nd b ON b.id = to_id WHERE ed.kind <> 'contains' AND a.repo <> b.repo GROUP BY 1, 2, 3)"


@query("a6_repo_pairs", f"WITH {ND}, {ED}, {_PAIRS} SELECT * FROM pr")
def a6_repo_pairs(s, d):
    h = G.hydrate(edges(s, d).where("kind <> 'contains'"), nodes(s, d)).where("src_repo <> dst_repo")
    return h.groupBy("src_repo", "dst_repo", "kind").agg(F.count("*").alias("n"))


@query("a7_repo_degree", f"WITH {ND}, {ED}, {_PAIRS}, e AS (SELECT src_repo AS repo, n FROM pr UNION ALL SELECT dst_repo, n FROM pr), g AS (SELECT repo, CAST(sum(n) AS BIGINT) AS degree FROM e GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY degree DESC, repo) AS place, count(*) OVER () AS k FROM g) SELECT repo, degree, place, place <= CASE WHEN k > 6 THEN 2 ELSE 1 END AS hub FROM r")
def a7_repo_degree(s, d):
    return G.repo_degree(a6_repo_pairs(s, d))


@query("a8_repo_files", f"WITH {CF} SELECT repo, count(DISTINCT path) AS files, CAST(sum(line_count) AS BIGINT) AS lines FROM cf GROUP BY 1")
def a8_repo_files(s, d):
    return current_files(s, d, "line_count").groupBy("repo").agg(F.count_distinct("path").alias("files"), F.sum("line_count").alias("lines"))


@query("a9_directories", f"WITH {CF} SELECT repo, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS files FROM cf GROUP BY 1, 2")
def a9_directories(s, d):
    return table(s, d, "files").select("repo", "path").distinct().groupBy("repo", X.parent(F.col("path")).alias("dir")).agg(F.count("*").alias("files"))


@query("a10_declaration_counts", f"WITH {DC} SELECT repo, path, count(*) FILTER (WHERE kind IN ('class','struct','interface','enum','record')) AS types, count(*) FILTER (WHERE kind IN ('function','method','ctor')) AS methods, count(*) FILTER (WHERE kind = 'field') AS fields FROM dc GROUP BY 1, 2")
def a10_declaration_counts(s, d):
    c = lambda *k: F.count_if(F.col("kind").isin(*k))
    return decls(s, d, "repo", "path", "kind").groupBy("repo", "path").agg(c("class", "struct", "interface", "enum", "record").alias("types"), c("function", "method", "ctor").alias("methods"), c("field").alias("fields"))


@query("a11_size_buckets", f"WITH {CF} SELECT CASE WHEN line_count <= 50 THEN 'tiny' WHEN line_count <= 200 THEN 'small' WHEN line_count <= 600 THEN 'medium' WHEN line_count <= 1500 THEN 'large' ELSE 'xlarge' END AS bucket, count(*) AS files FROM cf GROUP BY 1")
def a11_size_buckets(s, d):
    return current_files(s, d, "line_count").groupBy(X.size_bucket(F.col("line_count")).alias("bucket")).agg(F.count("*").alias("files"))


@query("a12_overloads", f"WITH {DC}, o AS (SELECT *, CASE WHEN kind IN ('function','method','ctor') AND kind = lag(kind) OVER w AND name = lag(name) OVER w THEN 0 ELSE 1 END AS brk FROM dc WINDOW w AS (PARTITION BY repo, path, parent_id ORDER BY ordinal, decl_id)), g AS (SELECT *, sum(brk) OVER (PARTITION BY repo, path, parent_id ORDER BY ordinal, decl_id ROWS UNBOUNDED PRECEDING) AS grp FROM o) SELECT repo, path, min(decl_id) AS decl_id, count(*) AS n FROM g GROUP BY repo, path, parent_id, grp")
def a12_overloads(s, d):
    w = Window.partitionBy("repo", "path", "parent_id").orderBy("ordinal", "decl_id")
    x = decls(s, d, "repo", "path", "parent_id", "ordinal", "kind", "name")
    same = F.col("kind").isin("function", "method", "ctor") & (F.col("kind") == F.lag("kind").over(w)) & (F.col("name") == F.lag("name").over(w))
    g = x.withColumn("brk", F.when(same, 0).otherwise(1)).withColumn("grp", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("repo", "path", "parent_id", "grp").agg(F.min("decl_id").alias("decl_id"), F.count("*").alias("n")).select("repo", "path", "decl_id", "n")


@query("a13_file_concat", f"WITH {CH}, g AS (SELECT repo, path, string_agg(content, chr(10) || chr(10) ORDER BY start_line, id) AS t, count(*) AS n FROM ch WHERE content IS NOT NULL GROUP BY 1, 2) SELECT repo, path, md5(substr(t, 1, 4000)) AS digest FROM g WHERE n >= 2 AND strlen(t) >= 200")
def a13_file_concat(s, d):
    c = chunks(s, d, "repo", "path", "start_line", "content").where("content is not null")
    g = c.groupBy("repo", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "id", "content"))), lambda e: e["content"]), "\n\n").alias("t"), F.count("*").alias("n"))
    return g.where((F.col("n") >= 2) & (F.octet_length("t") >= 200)).select("repo", "path", F.md5(F.substring("t", 1, 4000)).alias("digest"))


@query("a14_digest_groups", f"WITH {DC}, g AS (SELECT repo, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, list(name ORDER BY name) AS names FROM (SELECT DISTINCT repo, path, name FROM dc WHERE kind IN ('class','struct')) GROUP BY 1, 2) SELECT repo, dir, array_to_string(names[:10], ',') AS shown, greatest(0, len(names) - 10) AS more FROM g")
def a14_digest_groups(s, d):
    x = decls(s, d, "repo", "path", "name", "kind").where("kind in ('class','struct')").select("repo", "path", "name").distinct()
    g = x.groupBy("repo", X.parent(F.col("path")).alias("dir")).agg(F.array_sort(F.collect_list("name")).alias("names"))
    return g.select("repo", "dir", F.array_join(F.slice("names", 1, 10), ",").alias("shown"), F.greatest(F.lit(0), F.size("names") - 10).cast("bigint").alias("more"))


@query("a15_surface_tree", f"WITH {DC} SELECT repo, regexp_extract(qualified_name, '^(.*)(?:::|\\.)[^.:]*$', 1) AS pre, count(*) AS n FROM dc WHERE coalesce(visibility, '') <> 'private' GROUP BY 1, 2")
def a15_surface_tree(s, d):
    x = decls(s, d, "repo", "qualified_name", "visibility").where("coalesce(visibility, '') <> 'private'")
    return x.groupBy("repo", F.regexp_extract("qualified_name", r"^(.*)(?:::|\.)[^.:]*$", 1).alias("pre")).agg(F.count("*").alias("n"))


@query("a16_layout", f"WITH {CF}, r AS (SELECT repo, row_number() OVER (ORDER BY repo) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT repo FROM cf)) SELECT repo, round(greatest(400, n * 90 / (2 * pi())) * cos(2 * pi() * i / n), 4) AS x, round(greatest(400, n * 90 / (2 * pi())) * sin(2 * pi() * i / n), 4) AS y FROM r")
def a16_layout(s, d):
    r = table(s, d, "files").select("repo").distinct()  # one row per repository
    r = r.withColumn("i", F.row_number().over(Window.orderBy("repo")) - 1).crossJoin(F.broadcast(r.agg(F.count("*").alias("n"))))
    radius, angle = F.greatest(F.lit(400.0), F.col("n") * 90 / (2 * F.pi())), 2 * F.pi() * F.col("i") / F.col("n")
    return r.select("repo", F.round(radius * F.cos(angle), 4).alias("x"), F.round(radius * F.sin(angle), 4).alias("y"))


# ---- windows and sets


@query("w3_ranked_neighbours", f"WITH {ED} SELECT from_id, to_id, row_number() OVER (PARTITION BY from_id ORDER BY confidence DESC NULLS LAST, to_id, kind) AS place FROM ed WHERE kind IN ('calls','imports')")
def w3_ranked_neighbours(s, d):
    w = Window.partitionBy("from_id").orderBy(F.desc_nulls_last("confidence"), "to_id", "kind")
    return edges(s, d).where("kind in ('calls','imports')").select("from_id", "to_id", F.row_number().over(w).alias("place"))


@query("w5_token_budget", "WITH c AS (SELECT query_id, item_id, max(relevance_score) AS r, max(coalesce(estimated_tokens, 80)) AS t FROM context_items WHERE NOT isnan(relevance_score) GROUP BY 1, 2), w AS (SELECT *, sum(t) OVER (PARTITION BY query_id ORDER BY r DESC, item_id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, item_id) AS rn FROM c) SELECT query_id, item_id FROM w WHERE used <= 800 AND rn <= 30")
def w5_token_budget(s, d):
    c = table(s, d, "context_items").where("relevance_score is not null and not isnan(relevance_score)").groupBy("query_id", "item_id").agg(F.max("relevance_score").alias("r"), F.max(F.coalesce("estimated_tokens", F.lit(80))).alias("t"))
    w = Window.partitionBy("query_id").orderBy(F.desc("r"), "item_id")
    return c.withColumn("used", F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(w)).where("used <= 800 and rn <= 30").select("query_id", "item_id")


@query("u2_dedupe_best", "SELECT lower(trim(node_id)) AS id, max(confidence) AS best FROM context_items WHERE node_id IS NOT NULL AND NOT isnan(confidence) GROUP BY 1")
def u2_dedupe_best(s, d):
    return table(s, d, "context_items").where("node_id is not null and confidence is not null and not isnan(confidence)").groupBy(F.lower(F.trim("node_id")).alias("id")).agg(F.max("confidence").alias("best"))


@query("u3_path_keywords", f"WITH {CH}, p AS (SELECT id, regexp_split_to_array(lower(regexp_replace(path, '[^A-Za-z0-9]+', ' ', 'g')), ' ') AS parts FROM ch) SELECT id, len(list_intersect(['shard', 'ledger', 'search', 'graph'], parts)) AS hits FROM p WHERE len(list_intersect(['shard', 'ledger', 'search', 'graph'], parts)) > 0")
def u3_path_keywords(s, d):
    parts = F.split(F.lower(F.regexp_replace("path", "[^A-Za-z0-9]+", " ")), " ")
    hits = F.size(F.array_intersect(F.array(*[F.lit(k) for k in ("shard", "ledger", "search", "graph")]), parts)).cast("bigint")
    return chunks(s, d, "path").select("id", hits.alias("hits")).where("hits > 0")


# ---- traversals

_START = f"st AS (SELECT id FROM nd WHERE kind IN ('function','method') AND contains(lower(symbol), '{SYMBOL_PART}'))"


@query("g1_callers", f"WITH RECURSIVE {ND}, {ED}, {_START}, w AS (SELECT id, 0 AS depth FROM st UNION SELECT ed.from_id, w.depth + 1 FROM w JOIN ed ON ed.to_id = w.id AND ed.kind = 'calls' WHERE w.depth < {DEPTH}) SELECT id, min(depth) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0")
def g1_callers(s, d):
    n = nodes(s, d)
    st = n.where(F.col("kind").isin("function", "method") & F.contains(F.lower("symbol"), F.lit(SYMBOL_PART))).select("id")
    e = edges(s, d).where("kind = 'calls'").select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))
    return G.reach(e, st, DEPTH).select("id", "depth")


@query("g3_dependencies", f"WITH RECURSIVE {ND}, {ED}, st AS (SELECT id FROM nd WHERE kind = 'module' AND repo = 'core-platform'), w AS (SELECT id, 0 AS depth FROM st UNION SELECT ed.to_id, w.depth + 1 FROM w JOIN ed ON ed.from_id = w.id AND ed.kind = 'imports' WHERE w.depth < 3) SELECT id, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY 1")
def g3_dependencies(s, d):
    st = nodes(s, d).where("kind = 'module' and repo = 'core-platform'").select("id")
    e = edges(s, d).where("kind = 'imports'").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    return G.reach(e, st, 3, pre_visit=False).select("id", "depth")


@query("g4_neighbourhood", f"WITH {ND}, {ED}, {_START} SELECT st.id, count(DISTINCT i.from_id) AS callers, count(DISTINCT o.to_id) AS callees FROM st LEFT JOIN ed i ON i.to_id = st.id AND i.kind = 'calls' LEFT JOIN ed o ON o.from_id = st.id AND o.kind = 'calls' GROUP BY 1")
def g4_neighbourhood(s, d):
    st = nodes(s, d).where(F.col("kind").isin("function", "method") & F.contains(F.lower("symbol"), F.lit(SYMBOL_PART))).select("id")
    c = edges(s, d).where("kind = 'calls'").select("from_id", "to_id").distinct()
    i, o = c.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("callers")), c.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("callees"))
    return st.join(i, "id", "left").join(o, "id", "left").fillna(0)


@query("g7_reverse_deps", f"WITH {ND}, {ED} SELECT b.repo AS repo, b.path AS path, count(DISTINCT from_id) AS users FROM ed JOIN nd b ON b.id = to_id WHERE ed.kind = 'imports' GROUP BY 1, 2")
def g7_reverse_deps(s, d):
    e = edges(s, d).where("kind = 'imports'").join(nodes(s, d).select(F.col("id").alias("to_id"), "repo", "path"), "to_id")
    return e.groupBy("repo", "path").agg(F.count_distinct("from_id").alias("users"))


@query("g8_cycles", f"WITH RECURSIVE {ED}, im AS (SELECT DISTINCT from_id AS a, to_id AS b FROM ed WHERE kind IN ('imports', 'calls') AND from_id <> to_id), c AS (SELECT a, b FROM im UNION SELECT c.a, im.b FROM c JOIN im ON im.a = c.b), m AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM c x JOIN c y ON y.a = x.b AND y.b = x.a GROUP BY x.a) SELECT id, component FROM m WHERE component IN (SELECT component FROM m GROUP BY 1 HAVING count(*) > 1)")
def g8_cycles(s, d):
    e = edges(s, d).where("kind in ('imports', 'calls')").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    return G.strong_components(e)


@query("g10_suffix_index", f"WITH {CF}, p AS (SELECT DISTINCT repo, path, string_split(regexp_replace(path, '\\.[^./]*$', ''), '/') AS a FROM cf), x AS (SELECT repo, path, array_to_string(a[i:], '/') AS suffix FROM p, (SELECT unnest(range(1, 12)) AS i) r WHERE i <= len(a)) SELECT suffix, count(*) AS files, min(repo || ':' || path) AS first FROM x GROUP BY 1")
def g10_suffix_index(s, d):
    a = F.split(F.regexp_replace("path", r"\.[^./]*$", ""), "/")
    x = table(s, d, "files").select("repo", "path").distinct().select("repo", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.array_join(F.slice(a, i, F.size(a)), "/"))).alias("suffix"))
    return x.groupBy("suffix").agg(F.count("*").alias("files"), F.min(F.concat("repo", F.lit(":"), "path")).alias("first"))


# ---- outline and maintenance


@query("o1_outline", f"WITH {DC} SELECT decl_id, repeat('    ', depth) || kind || ' ' || coalesce(name, '') || ' L' || start_line || '-' || end_line AS line FROM dc")
def o1_outline(s, d):
    x = decls(s, d, "depth", "kind", "name", "start_line", "end_line")
    return x.select("decl_id", F.concat(F.expr("repeat('    ', depth)"), "kind", F.lit(" "), F.coalesce("name", F.lit("")), F.lit(" L"), "start_line", F.lit("-"), "end_line").alias("line"))


@query("o2_show", f"WITH {DC} SELECT decl_id, qualified_name FROM dc WHERE qualified_name LIKE '%Pool.%' OR ends_with(qualified_name, 'Store')")
def o2_show(s, d):
    return decls(s, d, "qualified_name").where("qualified_name like '%Pool.%' or endswith(qualified_name, 'Store')")


@query("o9_surface", f"WITH {DC} SELECT repo, path, qualified_name, kind, start_line FROM dc WHERE coalesce(visibility, '') NOT IN ('private', 'protected')")
def o9_surface(s, d):
    return decls(s, d, "repo", "path", "qualified_name", "kind", "start_line", "visibility").where("coalesce(visibility, '') not in ('private', 'protected')").drop("decl_id", "visibility")


@query("gen13_markdown_outline", f"WITH {CF}, l AS (SELECT repo, path, string_split(replace(content, chr(13), ''), chr(10)) AS ls FROM cf WHERE ends_with(path, '.md') AND content IS NOT NULL), x AS (SELECT repo, path, unnest(ls) AS t, unnest(range(1, len(ls) + 1)) AS line FROM l) SELECT repo, path, line, length(regexp_extract(t, '^(#+) ', 1)) AS level, trim(regexp_replace(t, '^#+ ', '')) AS title FROM x WHERE regexp_matches(t, '^#{{1,6}} ')")
def gen13_markdown_outline(s, d):
    f = current_files(s, d, "content").where("endswith(path, '.md') and content is not null")
    x = f.select("repo", "path", F.posexplode(F.split(F.regexp_replace("content", "\r", ""), "\n")).alias("i", "t")).where(F.col("t").rlike("^#{1,6} "))
    return x.select("repo", "path", (F.col("i") + 1).cast("bigint").alias("line"), F.length(F.regexp_extract("t", "^(#+) ", 1)).cast("bigint").alias("level"), F.trim(F.regexp_replace("t", "^#+ ", "")).alias("title"))


@query("gen20_declaration_nodes", f"WITH {DC} SELECT substr(sha256(k || chr(0) || repo || chr(0) || path || chr(0) || coalesce(name, '')), 1, 32) AS id, k AS kind FROM (SELECT *, CASE WHEN kind IN ('class','struct','interface','record','enum') THEN 'type' WHEN kind IN ('method','ctor') THEN 'method' ELSE 'function' END AS k FROM dc WHERE kind IN ('class','struct','interface','record','enum','method','ctor','function')) GROUP BY 1, 2")
def gen20_declaration_nodes(s, d):
    x = decls(s, d, "repo", "path", "name", "kind").where("kind in ('class','struct','interface','record','enum','method','ctor','function')")
    k = F.when(F.col("kind").isin("class", "struct", "interface", "record", "enum"), "type").when(F.col("kind").isin("method", "ctor"), "method").otherwise("function")
    return x.select(X.node_id(k, F.col("repo"), F.col("path"), F.col("name")).alias("id"), k.alias("kind")).distinct()


@query("gen20_contains", f"WITH {DC} SELECT p.decl_id AS parent, count(*) AS members FROM dc c JOIN dc p ON c.parent_id = p.decl_id GROUP BY 1")
def gen20_contains(s, d):
    x = decls(s, d, "parent_id")
    return x.join(x.select(F.col("decl_id").alias("parent")), F.col("parent_id") == F.col("parent")).groupBy("parent").agg(F.count("*").alias("members"))


@query("gen21_parse_errors", f"WITH {CF} SELECT repo, CAST(sum(parse_errors) AS BIGINT) AS errors, count(*) AS files FROM cf GROUP BY 1")
def gen21_parse_errors(s, d):
    return current_files(s, d, "parse_errors").groupBy("repo").agg(F.sum("parse_errors").alias("errors"), F.count("*").alias("files"))


@query("i2_delete_module", f"WITH {ND}, {ED}, gone AS (SELECT id FROM nd WHERE repo = 'amber-api') SELECT count(*) AS edges FROM ed WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone)")
def i2_delete_module(s, d):
    gone, e = nodes(s, d).where("repo = 'amber-api'").select("id"), edges(s, d)
    return e.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti").agg(F.count("*").alias("edges"))


@query("i5_orphan_vectors", "SELECT DISTINCT chunk_id FROM chunk_vec WHERE chunk_id NOT IN (SELECT id FROM chunks WHERE id IS NOT NULL)")
def i5_orphan_vectors(s, d):
    return table(s, d, "chunk_vec").select("chunk_id").distinct().join(table(s, d, "chunks").select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")


# ---- scalars


@query("x2_symbol_queries", f"SELECT query_id, regexp_matches(trim(query_text), '{X.SYMBOL_QUERY}') AS symbol_like FROM query_log")
def x2_symbol_queries(s, d):
    return table(s, d, "query_log").select("query_id", X.is_symbol_query(F.col("query_text")).alias("symbol_like"))


@query("x6_path_parts", f"WITH {CF} SELECT repo, path, regexp_extract(path, '[^/]*$') AS base, {STEM} AS stem, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM cf")
def x6_path_parts(s, d):
    p = F.col("path")
    return table(s, d, "files").select("repo", "path").distinct().select("repo", "path", X.basename(p).alias("base"), X.stem(p).alias("stem"), X.extension(p).alias("ext"))


@query("x8_content_hash", f"WITH {CF} SELECT repo, path, sha256(content) AS h FROM cf WHERE content IS NOT NULL")
def x8_content_hash(s, d):
    return current_files(s, d, "content").where("content is not null").select("repo", "path", F.sha2("content", 256).alias("h"))


@query("x12_normalise", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS norm2 FROM embeddings")
def x12_normalise(s, d):
    e = F.col("embedding")
    return table(s, d, "embeddings").select("vec_id", F.round(X.dot(e, e), 4).alias("norm2"))


@query("x15_line_counts", f"WITH {CF} SELECT repo, path, length(content) - length(replace(content, chr(10), '')) + 1 AS lines, strlen(content) AS bytes FROM cf WHERE content IS NOT NULL")
def x15_line_counts(s, d):
    f = current_files(s, d, "content").where("content is not null")
    return f.select("repo", "path", (F.regexp_count("content", F.lit("\n")) + 1).cast("bigint").alias("lines"), F.octet_length("content").cast("bigint").alias("bytes"))
