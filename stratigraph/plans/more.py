"""Further queries: rankings' features, neighbourhoods, maintenance and scalar functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratigraph.functions import text as X
from stratigraph.operators import graph as G
from stratigraph.operators import search as S
from stratigraph.plans.reference import CF, CH, DC, ED, ND, STEM, chunks, current_files, decls, edges, nodes
from stratigraph.plans.retrieval import BM, _bm, _scored
from stratigraph.session import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
# Path parts whose files are not summarised, words that are no keywords.
BLACKLIST = [".test.", "_test.", ".spec.", ".d.ts", "/__generated__/", "/types/", "_pb.go", "_pb2.py", ".thrift.gen.", "/dist/", "/build/", "/.next/"]
DEFINES = "class|module|defmodule|def|interface|struct|enum|trait|type|func|function|object|abstract class|data class|fn|fun|package|namespace|protocol|record|typedef"


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("f3_kind_lookup", f"WITH {ND} SELECT id, symbol FROM nd WHERE kind = 'method' AND contains(lower(symbol), 'resolve') AND starts_with(path, 'src/')")
def f3_kind_lookup(s, d):
    return nodes(s, d).where(F.contains(F.lower("symbol"), F.lit("resolve")) & (F.col("kind") == "method") & F.col("path").startswith("src/")).select("id", "symbol")


@query("f7_repo_nodes", f"WITH {ND} SELECT id, repo FROM nd WHERE kind = 'repo'")
def f7_repo_nodes(s, d):
    return nodes(s, d).where("kind = 'repo'").select("id", "repo")


@query("f9_language_mask", f"{BM} SELECT id, round(score, 6) AS score FROM bm JOIN ch USING (id) WHERE language IN ('go', 'rust')")
def f9_language_mask(s, d):
    keep = table(s, d, "chunks").where("language in ('go', 'rust')").select("id")
    return _bm(s, d).join(keep, "id", "left_semi").select("id", F.round("score", 6).alias("score"))


@query("f12_blacklist", f"WITH {CF} SELECT repo, count(*) AS files FROM cf WHERE NOT ({' OR '.join(f'contains(path, {b!r})' for b in BLACKLIST)}) GROUP BY 1")
def f12_blacklist(s, d):
    bad = F.exists(F.array(*[F.lit(b) for b in BLACKLIST]), lambda b: F.contains(F.col("path"), b))
    return table(s, d, "files").select("repo", "path").distinct().where(~bad).groupBy("repo").agg(F.count("*").alias("files"))


@query("j9_summary_fanout", f"WITH {ND}, {CH}, sm AS (SELECT DISTINCT repo, path FROM nd WHERE kind = 'module') SELECT ch.id, round(-0.5 - 0.05, 4)::DOUBLE AS score FROM ch JOIN sm USING (repo, path)")
def j9_summary_fanout(s, d):
    sm = nodes(s, d).where("kind = 'module'").select("repo", "path").distinct().withColumn("dist", F.lit(0.5))
    return chunks(s, d, "repo", "path").join(sm, ["repo", "path"]).select("id", F.round(-F.col("dist") - 0.05, 4).alias("score"))


@query("j12_fold_to_owner", f"WITH {ND}, o AS (SELECT repo, path, min(id) AS owner FROM nd WHERE kind = 'type' GROUP BY 1, 2) SELECT nd.id, owner FROM nd JOIN o USING (repo, path) WHERE kind = 'method'")
def j12_fold_to_owner(s, d):
    n = nodes(s, d)
    o = n.where("kind = 'type'").groupBy("repo", "path").agg(F.min("id").alias("owner"))
    return n.where("kind = 'method'").join(o, ["repo", "path"]).select("id", "owner")


@query("j15_manual_links", "SELECT a AS src, b AS dst, CASE WHEN k IN ('calls', 'invokes') THEN k ELSE 'imports' END AS kind, 1.0::DOUBLE AS confidence FROM (VALUES ('core-platform', 'amber-api', 'calls'), ('amber-api', 'kelp-billing', 'uses')) v(a, b, k)")
def j15_manual_links(s, d):
    v = s.createDataFrame([("core-platform", "amber-api", "calls"), ("amber-api", "kelp-billing", "uses")], "src string, dst string, k string")
    return v.select("src", "dst", F.when(F.col("k").isin("calls", "invokes"), F.col("k")).otherwise("imports").alias("kind"), F.lit(1.0).alias("confidence"))


@query("a5_file_scores", f"{BM}, sc AS (SELECT id, repo, path, score FROM bm JOIN ch USING (id)) SELECT path, round(sum(score), 6) AS total, arg_min(id, (-round(score, 9), id)) AS best FROM sc GROUP BY path")
def a5_file_scores(s, d):
    return _scored(s, d).groupBy("path").agg(F.round(F.sum("score"), 6).alias("total"), F.min_by("id", F.struct(-F.round("score", 9), "id")).alias("best"))


@query("w4_lane_rank", "WITH c AS (SELECT query_id, item_id, max(relevance_score) AS r FROM context_items WHERE relevance_score IS NOT NULL AND NOT isnan(relevance_score) GROUP BY 1, 2) SELECT query_id, item_id, round(1.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY r DESC, item_id)), 9) AS rrf FROM c")
def w4_lane_rank(s, d):
    c = table(s, d, "context_items").where("relevance_score is not null and not isnan(relevance_score)").groupBy("query_id", "item_id").agg(F.max("relevance_score").alias("r"))
    return c.select("query_id", "item_id", F.round(1.0 / (60 + F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("r"), "item_id"))), 9).alias("rrf"))


@query("t2_candidates", f"{BM} SELECT id FROM bm ORDER BY round(score, 9) DESC, id LIMIT 40")
def t2_candidates(s, d):
    return S.top(_bm(s, d), 40).select("id")


_TOPSYM = "ts AS (SELECT symbol FROM nd JOIN ed ON ed.to_id = nd.id AND ed.kind = 'calls' WHERE nd.kind IN ('function', 'method') AND symbol IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, symbol LIMIT 5)"


def _most_called(s, d):
    n = nodes(s, d).where("kind in ('function', 'method') and symbol is not null").select("id", "repo", "path", "symbol")
    c = edges(s, d).where("kind = 'calls'").select("from_id", "to_id")
    top = c.join(n, c["to_id"] == n["id"]).groupBy("symbol").count().orderBy(F.desc("count"), "symbol").limit(5).select("symbol")
    return n.join(F.broadcast(top), "symbol", "left_semi"), c


@query("g2_callers_all", f"WITH {ND}, {ED}, {_TOPSYM} SELECT DISTINCT nd.symbol, ed.from_id AS caller FROM nd JOIN ed ON ed.to_id = nd.id AND ed.kind = 'calls' WHERE nd.kind IN ('function', 'method') AND nd.symbol IN (SELECT symbol FROM ts)")
def g2_callers_all(s, d):
    n, c = _most_called(s, d)
    return c.join(n, c["to_id"] == n["id"]).select("symbol", F.col("from_id").alias("caller")).distinct()


@query("g13_callers_first", f"WITH {ND}, {ED}, {_TOPSYM}, f AS (SELECT symbol, min(id) AS id FROM nd WHERE kind IN ('function', 'method') AND symbol IN (SELECT symbol FROM ts) GROUP BY 1) SELECT DISTINCT f.symbol, ed.from_id AS caller FROM f JOIN ed ON ed.to_id = f.id AND ed.kind = 'calls'")
def g13_callers_first(s, d):
    n, c = _most_called(s, d)
    f = n.groupBy("symbol").agg(F.min("id").alias("id"))
    return c.join(f, c["to_id"] == f["id"]).select("symbol", F.col("from_id").alias("caller")).distinct()


@query("g5_transitive_bases", f"WITH RECURSIVE {DC}, b AS (SELECT DISTINCT name AS child, regexp_replace(regexp_replace(trim(u), '[<\\[].*$', ''), '^.*(::|\\.)', '') AS base FROM (SELECT name, unnest(bases) AS u FROM dc WHERE name IS NOT NULL)), w AS (SELECT child, base FROM b UNION SELECT w.child, b.base FROM w JOIN b ON b.child = w.base) SELECT base, count(DISTINCT child) AS types FROM w GROUP BY 1")
def g5_transitive_bases(s, d):
    b = decls(s, d, "name", "bases").where("name is not null").withColumn("u", F.explode("bases")).select(F.col("name").alias("child"), X.base_type(F.col("u")).alias("base")).distinct()
    b = out = front = cut(b)
    while True:  # ends: only new pairs go on
        nxt = front.join(b.select(F.col("child").alias("base"), F.col("base").alias("up")), "base").select("child", F.col("up").alias("base")).distinct()
        front = cut(nxt.join(out, ["child", "base"], "left_anti"))
        if not front.limit(1).count():
            break
        out = out.unionByName(front)
    return out.groupBy("base").agg(F.count_distinct("child").alias("types"))


@query("g6_forward_deps", f"WITH RECURSIVE {ND}, {ED}, im AS (SELECT DISTINCT from_id AS a, to_id AS b FROM ed WHERE kind = 'imports'), w AS (SELECT id AS a0, id, 0 AS depth FROM nd WHERE kind = 'module' AND starts_with(path, 'src/auth/') UNION SELECT a0, im.b, depth + 1 FROM w JOIN im ON im.a = w.id WHERE depth < 2) SELECT a0 AS start, id AS target, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY 1, 2")
def g6_forward_deps(s, d):
    st = nodes(s, d).where("kind = 'module' and startswith(path, 'src/auth/')").select(F.col("id").alias("start"))
    e = edges(s, d).where("kind = 'imports'").select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).distinct()
    one = st.join(e, st["start"] == e["a"]).select("start", F.col("b").alias("target"), F.lit(1).alias("depth"))
    two = one.join(e, one["target"] == e["a"]).select("start", F.col("b").alias("target"), F.lit(2).alias("depth"))
    return one.unionByName(two).groupBy("start", "target").agg(F.min("depth").alias("depth"))


@query("g9_neighbourhood_depths", f"WITH RECURSIVE {ND}, {ED}, u AS (SELECT from_id AS a, to_id AS b FROM ed WHERE kind = 'imports' UNION SELECT to_id, from_id FROM ed WHERE kind = 'imports'), w AS (SELECT id, 0 AS depth FROM nd WHERE kind = 'module' AND starts_with(path, 'lib/sync/') UNION SELECT u.b, depth + 1 FROM w JOIN u ON u.a = w.id WHERE depth < 2) SELECT id, min(depth) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0")
def g9_neighbourhood_depths(s, d):
    st = nodes(s, d).where("kind = 'module' and startswith(path, 'lib/sync/')").select("id")
    e = edges(s, d).where("kind = 'imports'").select(F.explode(F.array(F.struct(F.col("from_id").alias("a"), F.col("to_id").alias("b")), F.struct(F.col("to_id").alias("a"), F.col("from_id").alias("b")))).alias("e")).select("e.a", "e.b").distinct()
    return G.reach(e, st, 2).select("id", "depth")


@query("r9_alpha", f"SELECT query_id, CASE WHEN regexp_matches(trim(query_text), '{X.SYMBOL_QUERY}') THEN 0.3 ELSE 0.5 END::DOUBLE AS alpha FROM query_log")
def r9_alpha(s, d):
    return table(s, d, "query_log").select("query_id", F.when(X.is_symbol_query(F.col("query_text")), 0.3).otherwise(0.5).alias("alpha"))


_DEF = f"(^|[^A-Za-z0-9_])({DEFINES})\\s+([A-Za-z_]*[Rr]esolve[A-Za-z0-9_]*)"


@query("r12_definition_boost", f"WITH {CH} SELECT id, CASE WHEN contains(lower({STEM}), 'util') THEN 4.5 ELSE 3.0 END::DOUBLE AS boost FROM ch WHERE regexp_matches(content, '{_DEF}')")
def r12_definition_boost(s, d):
    c = chunks(s, d, "path", "content").where(F.col("content").rlike(_DEF))
    return c.select("id", F.when(F.contains(F.lower(X.stem(F.col("path"))), F.lit("util")), 4.5).otherwise(3.0).alias("boost"))


@query("r14_stem_boost", f"WITH {CH}, p AS (SELECT id, list_distinct(regexp_split_to_array(lower(regexp_replace({STEM}, '[^A-Za-z0-9]+', ' ', 'g')), ' ')) AS parts FROM ch) SELECT id, len(list_intersect(['shard', 'token', 'store', 'codec'], parts)) / 4.0::DOUBLE AS ratio FROM p WHERE len(list_intersect(['shard', 'token', 'store', 'codec'], parts)) / 4.0 >= 0.10")
def r14_stem_boost(s, d):
    parts = F.split(F.lower(F.regexp_replace(X.stem(F.col("path")), "[^A-Za-z0-9]+", " ")), " ")
    ratio = F.size(F.array_intersect(F.array(*[F.lit(k) for k in ("shard", "token", "store", "codec")]), parts)) / 4.0
    return chunks(s, d, "path").select("id", ratio.alias("ratio")).where("ratio >= 0.10")


@query("r19_related_dense", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), q AS (SELECT vec_id AS q0, v AS qv, label AS l0 FROM e ORDER BY vec_id LIMIT 1) SELECT vec_id AS id, round(list_sum(list_transform(list_zip(v, qv), lambda x: x[1] * x[2])), 5) AS score FROM e, q WHERE label = l0 AND vec_id <> q0 ORDER BY round(score, 9) DESC, id LIMIT 8")
def r19_related_dense(s, d):
    e = table(s, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(F.col("vec_id").alias("q0"), F.col("embedding").alias("qv"), F.col("label").alias("l0"))
    j = e.crossJoin(F.broadcast(q)).where("label = l0 and vec_id <> q0").select(F.col("vec_id").alias("id"), F.round(X.dot(F.col("embedding"), F.col("qv")), 5).alias("score"))
    return j.orderBy(F.desc("score"), "id").limit(8)


@query("r23_ranked_by_kind", f"WITH {ND}, {ED} SELECT to_id AS target, from_id AS source, row_number() OVER (PARTITION BY to_id ORDER BY confidence DESC NULLS LAST, from_id, ed.kind) AS place FROM ed JOIN nd ON nd.id = from_id WHERE ed.kind IN ('implements', 'invokes', 'extends')")
def r23_ranked_by_kind(s, d):
    e = edges(s, d).where("kind in ('implements', 'invokes', 'extends')").join(nodes(s, d).select(F.col("id").alias("from_id")), "from_id", "left_semi")
    w = Window.partitionBy("to_id").orderBy(F.desc_nulls_last("confidence"), "from_id", "kind")
    return e.select(F.col("to_id").alias("target"), F.col("from_id").alias("source"), F.row_number().over(w).alias("place"))


@query("r25_embedded_counts", "SELECT len(embedding) AS dim, count(DISTINCT chunk_id) AS chunks FROM chunk_vec WHERE embedding IS NOT NULL GROUP BY 1")
def r25_embedded_counts(s, d):
    return table(s, d, "chunk_vec").where("embedding is not null").groupBy(F.size("embedding").cast("bigint").alias("dim")).agg(F.count_distinct("chunk_id").alias("chunks"))


@query("i3_replace_repo_chunks", f"WITH {CH} SELECT repo, count(*) AS n FROM (SELECT repo FROM ch WHERE repo <> 'amber-api' UNION ALL SELECT 'amber-api' FROM ch WHERE repo = 'amber-api' AND start_line = 1) GROUP BY 1")
def i3_replace_repo_chunks(s, d):
    c = chunks(s, d, "repo", "start_line")
    fresh = c.where("repo = 'amber-api' and start_line = 1")
    return replace_partition(c, fresh, "repo").groupBy("repo").agg(F.count("*").alias("n"))


def replace_partition(old, new, key: str):
    """Rows of ``old`` whose key does not occur in ``new``, and all of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


@query("i6_dimension_change", "SELECT DISTINCT chunk_id FROM chunk_vec WHERE embedding IS NULL OR len(embedding) <> 64")
def i6_dimension_change(s, d):
    return table(s, d, "chunk_vec").where("embedding is null or size(embedding) <> 64").select("chunk_id").distinct()


@query("i8_rebuild_policy", """WITH now AS (SELECT repo || ':' || path AS k, repo, arg_max(lower(trim(content_hash)), mtime) AS h FROM files GROUP BY repo, path), old AS (SELECT record_key AS k, max(lower(trim(seen_hash))) AS h FROM run_manifest WHERE record_kind = 'file' AND run_id = 1 GROUP BY 1)
SELECT repo, count(*) FILTER (WHERE old.k IS NULL OR now.h IS DISTINCT FROM old.h) > 0 AS rebuild FROM now LEFT JOIN old USING (k) GROUP BY repo""")
def i8_rebuild_policy(s, d):
    f = table(s, d, "files").groupBy("repo", "path").agg(F.max_by(F.lower(F.trim("content_hash")), F.when(F.col("content_hash").isNotNull(), F.col("mtime"))).alias("h")).select("repo", F.concat("repo", F.lit(":"), "path").alias("k"), "h")
    old = table(s, d, "run_manifest").where("record_kind = 'file' and run_id = 1").groupBy(F.col("record_key").alias("k")).agg(F.max(F.lower(F.trim("seen_hash"))).alias("o"), F.lit(1).alias("seen"))
    j = f.join(old, "k", "left")
    return j.groupBy("repo").agg((F.count_if(F.col("seen").isNull() | ~F.col("h").eqNullSafe(F.col("o"))) > 0).alias("rebuild"))


@query("o3_digest", f"WITH {DC} SELECT repo, path, p.name AS type, count(*) AS members FROM dc p JOIN (SELECT parent_id FROM dc) c ON c.parent_id = p.decl_id WHERE p.kind IN ('class', 'struct') GROUP BY repo, path, p.name, p.decl_id")
def o3_digest(s, d):
    x = decls(s, d, "repo", "path", "name", "kind", "parent_id")
    members = x.groupBy(F.col("parent_id").alias("decl_id")).agg(F.count("*").alias("members"))
    return x.where("kind in ('class', 'struct')").join(members, "decl_id").select("repo", "path", F.col("name").alias("type"), "members")


@query("o11_json_outline", f"""WITH {DC} SELECT decl_id, '{{"kind":"' || kind || '","name":"' || name || '","start_line":' || start_line || '}}' AS js FROM dc WHERE name IS NOT NULL""")
def o11_json_outline(s, d):
    return decls(s, d, "kind", "name", "start_line").where("name is not null").select("decl_id", F.to_json(F.struct("kind", "name", "start_line")).alias("js"))


@query("x3_symbol_name", f"WITH {DC} SELECT DISTINCT qualified_name, regexp_replace(qualified_name, '^.*(::|\\.)', '') AS last FROM dc WHERE qualified_name IS NOT NULL")
def x3_symbol_name(s, d):
    return decls(s, d, "qualified_name").where("qualified_name is not null").select("qualified_name", X.symbol_name(F.col("qualified_name")).alias("last")).distinct()


@query("x4_stem_matches", f"WITH {CF} SELECT repo, path, regexp_replace(replace({STEM}, '_', ''), 's+$', '') = 'index' AS hit FROM cf")
def x4_stem_matches(s, d):
    st = F.regexp_replace(F.regexp_replace(X.stem(F.col("path")), "_", ""), "s+$", "")
    return table(s, d, "files").select("repo", "path").distinct().select("repo", "path", (st == "index").alias("hit"))


@query("x9_collapse", "SELECT decl_id, trim(regexp_replace(signature, '\\s+', ' ', 'g')) AS sig FROM (SELECT DISTINCT decl_id, signature FROM declarations) WHERE signature IS NOT NULL")
def x9_collapse(s, d):
    return table(s, d, "declarations").select("decl_id", "signature").where("signature is not null").distinct().select("decl_id", X.collapse(F.col("signature")).alias("sig"))


@query("x10_safe_names", f"WITH {CF} SELECT DISTINCT repo, path, regexp_replace(path, '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM cf")
def x10_safe_names(s, d):
    return table(s, d, "files").select("repo", "path").distinct().withColumn("safe", X.safe_name(F.col("path")))


@query("x11_levenshtein", f"WITH {ND} SELECT DISTINCT symbol, levenshtein(lower(symbol), 'resolve_scope') AS dist FROM nd WHERE kind = 'function' AND regexp_full_match(symbol, '[A-Za-z0-9_]+')")
def x11_levenshtein(s, d):
    return nodes(s, d).where("kind = 'function' and symbol rlike '^[A-Za-z0-9_]+$'").select("symbol", F.levenshtein(F.lower("symbol"), F.lit("resolve_scope")).cast("bigint").alias("dist")).distinct()


@query("x16_truncate", "SELECT doc_id, md5(substr(text, 1, 4000)) AS h FROM documents WHERE text IS NOT NULL")
def x16_truncate(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(F.substring("text", 1, 4000)).alias("h"))


@query("gen14_markers", "SELECT DISTINCT decl_id, regexp_matches(coalesce(signature, ''), '(^|\\s)async\\s') AS is_async, regexp_matches(coalesce(signature, ''), '(^|\\s)(public|private|protected|static|export|pub|abstract)\\s') AS modified, list_contains(attrs, '@Deprecated') AS deprecated FROM declarations")
def gen14_markers(s, d):
    g = F.coalesce("signature", F.lit(""))
    x = table(s, d, "declarations").select("decl_id", g.rlike(r"(^|\s)async\s").alias("is_async"), g.rlike(r"(^|\s)(public|private|protected|static|export|pub|abstract)\s").alias("modified"), F.array_contains("attrs", "@Deprecated").alias("deprecated"))
    return x.distinct()


@query("gen19_exports", f"WITH {CF}, e AS (SELECT repo, path, unnest(regexp_extract_all(coalesce(content, ''), '(?m)^export (?:default )?(?:abstract )?(?:async )?(?:class|function|const|interface|type|enum) ([A-Za-z_]\\w*)', 1)) AS name FROM cf WHERE regexp_matches(path, '\\.(ts|js)$')) SELECT repo, path, name FROM e")
def gen19_exports(s, d):
    f = current_files(s, d, "content").where(F.col("path").rlike(r"\.(ts|js)$"))
    return f.select("repo", "path", F.explode(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"(?m)^export (?:default )?(?:abstract )?(?:async )?(?:class|function|const|interface|type|enum) ([A-Za-z_]\w*)"), F.lit(1))).alias("name"))


@query("o6_python_surface", f"WITH {DC} SELECT repo, path, qualified_name FROM dc WHERE ends_with(path, '.py') AND depth = 0 AND NOT starts_with(name, '_')")
def o6_python_surface(s, d):
    return decls(s, d, "repo", "path", "qualified_name", "depth", "name").where("endswith(path, '.py') and depth = 0 and not startswith(name, '_')").select("repo", "path", "qualified_name")


@query("o13_module_files", f"WITH {CF}, m AS (SELECT DISTINCT repo, regexp_extract(path, '^(.*/)[^/]*$', 1) AS dir, unnest(regexp_extract_all(coalesce(content, ''), '(?m)^(?:pub )?mod ([a-z_]\\w*);', 1)) AS name FROM cf WHERE ends_with(path, '.rs')) SELECT m.repo, m.name, cf.path FROM m JOIN cf ON cf.repo = m.repo AND cf.path IN (dir || name || '.rs', dir || name || '/mod.rs')")
def o13_module_files(s, d):
    f = current_files(s, d, "content").where("endswith(path, '.rs')")
    m = f.select("repo", F.regexp_extract("path", "^(.*/)[^/]*$", 1).alias("dir"), F.explode(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"(?m)^(?:pub )?mod ([a-z_]\w*);"), F.lit(1))).alias("name")).distinct()
    c = m.select("repo", "name", F.explode(F.array(F.concat("dir", "name", F.lit(".rs")), F.concat("dir", "name", F.lit("/mod.rs")))).alias("path"))
    return c.join(table(s, d, "files").select("repo", "path").distinct(), ["repo", "path"]).select("repo", "name", "path")


# ---- providers and the composed search


def s18_embed(s, d):
    from stratigraph.functions.providers import embed

    return chunks(s, d, "content").select("id", embed(F.col("content")).alias("embedding"))


QUERIES["s18_embed"] = s18_embed


def s21_summaries(s, d):
    from stratigraph.functions.providers import summarise

    return table(s, d, "documents").select("doc_id", summarise(F.col("text")).alias("summary"))


QUERIES["s21_summaries"] = s21_summaries

_FULL = f"""{BM}, qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1),
kn AS (SELECT vec_id AS id, -sqrt(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score FROM embeddings, qv WHERE len(embedding) = len(q) AND vec_id IN (SELECT id FROM ch)),
lx AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM bm), dn AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM kn),
fu AS (SELECT coalesce(l.id, n.id) AS id, 0.5 * coalesce(1.0 / (60 + n.rank), 0) + 0.5 * coalesce(1.0 / (60 + l.rank), 0) AS score FROM (SELECT * FROM lx WHERE rank <= 50) l FULL JOIN (SELECT * FROM dn WHERE rank <= 50) n ON l.id = n.id),
sc AS (SELECT fu.id, path, score FROM fu JOIN ch USING (id)), x AS (SELECT id, path, score, sum(score) OVER (PARTITION BY path) AS fs, row_number() OVER (PARTITION BY path ORDER BY round(score, 9) DESC, id) AS r FROM sc),
co AS (SELECT id, path, score + CASE WHEN r = 1 THEN 0.2 * (SELECT max(score) FROM sc) * fs / (SELECT max(fs) FROM x) ELSE 0 END AS score FROM x)"""


def r18_full_search(s, d):
    from stratigraph.plans.retrieval import _qv

    docs = chunks(s, d, "path")
    vec = table(s, d, "embeddings").join(docs.select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    fused = S.combine(S.rrf(S.knn(vec, "vec_id", "embedding", _qv(s, d), 50)), S.rrf(S.top(_bm(s, d), 50)), 0.5)
    scored = fused.join(docs, "id").select("id", "path", "score")
    return S.rerank(S.coherence(scored), 10).select("id", F.round("score", 8).alias("score"))


QUERIES["r18_full_search"] = r18_full_search


def _sql_full():
    from stratigraph.plans.retrieval import _PEN

    return f"{_FULL}, pe AS (SELECT id, path, score * {_PEN} AS score FROM co), sa AS (SELECT id, score * pow(0.5, row_number() OVER (PARTITION BY path ORDER BY round(score, 9) DESC, id) - 1) AS score FROM pe) SELECT id, round(score, 8) AS score FROM sa ORDER BY round(sa.score, 9) DESC, id LIMIT 10"


SQL["r18_full_search"] = _sql_full()
