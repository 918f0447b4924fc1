"""Queries of the retrieval operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratigraph.functions import text as X
from stratigraph.operators import search as S
from stratigraph.plans.reference import CH, chunks
from stratigraph.session import table

# Fixed values of the registered queries: what is searched for.
QUERY = "resolve scope token ledger"
TERMS = QUERY.split()

_PARTS = r"CASE WHEN contains(w, '_') THEN list_filter(string_split(lower(w), '_'), lambda x: x <> '') ELSE list_transform(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)) END"
TOK = f"iw AS (SELECT id, unnest(regexp_extract_all(coalesce(content, ''), '[a-zA-Z_][a-zA-Z0-9_]*')) AS w FROM ch), tk AS (SELECT id, lower(w) AS term FROM iw UNION ALL SELECT id, unnest(p) FROM (SELECT id, {_PARTS} AS p FROM iw) WHERE len(p) > 1)"
_BM = """dl AS (SELECT ch.id, count(tk.term) AS dl FROM ch LEFT JOIN tk ON tk.id = ch.id GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT id, term, count(*) AS tf FROM tk WHERE term IN ({terms}) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT tf.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN dl USING (id), st GROUP BY 1)""".replace("{terms}", ", ".join(f"'{t}'" for t in TERMS))
_TOP = "SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM {t}"
BM = f"WITH {CH}, {TOK}, {_BM}"
QV = "qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
L2 = "kn AS (SELECT vec_id AS id, -sqrt(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score FROM embeddings, qv WHERE len(embedding) = len(q))"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _q(s, text=QUERY):
    return s.createDataFrame([(1, text)], "qid int, text string")


def _qv(s, d):
    return table(s, d, "embeddings").orderBy("vec_id").limit(1).select(F.col("embedding").alias("qv"))


def _bm(s, d, where="1 = 1"):
    return S.bm25(chunks(s, d, "repo", "content", "language").where(where), _q(s), "id", "content").select("id", "score")


@query("x1_tokenise", f"WITH {CH}, {TOK} SELECT term, count(*) AS n FROM tk GROUP BY 1")
def x1_tokenise(s, d):
    return chunks(s, d, "content").select(F.explode(X.tokenize(F.col("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("a1_term_stats", f"WITH {CH}, {TOK}, p AS (SELECT id, term, count(*) AS tf FROM tk GROUP BY 1, 2) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY 1")
def a1_term_stats(s, d):
    return S.postings(chunks(s, d, "content"), "id", "content").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("r2_bm25", f"{BM} SELECT id, round(score, 6) AS score FROM bm ORDER BY round(bm.score, 9) DESC, id LIMIT 20")
def r2_bm25(s, d):
    return S.top(_bm(s, d), 20).select("id", F.round("score", 6).alias("score"))


@query("r3_bm25_mask", f"{BM} SELECT id, round(score, 6) AS score FROM bm JOIN ch USING (id) WHERE language = 'python' ORDER BY round(bm.score, 9) DESC, id LIMIT 20")
def r3_bm25_mask(s, d):
    keep = table(s, d, "chunks").where("language = 'python'").select("id")
    return S.top(_bm(s, d).join(keep, "id", "left_semi"), 20).select("id", F.round("score", 6).alias("score"))


@query("r4_bm25_repo_scope", f"{BM.replace('FROM chunks)', "FROM chunks WHERE repo = 'core-platform')")} SELECT id, round(score, 6) AS score FROM bm ORDER BY round(bm.score, 9) DESC, id LIMIT 20")
def r4_bm25_repo_scope(s, d):
    return S.top(_bm(s, d, "repo = 'core-platform'"), 20).select("id", F.round("score", 6).alias("score"))


@query("r5_path_enrichment", f"WITH {CH}, p AS (SELECT id, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem, string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/') AS dirs FROM ch) SELECT id, stem || ' ' || stem || ' ' || array_to_string(list_slice(dirs, greatest(1, len(dirs) - 2), len(dirs)), ' ') AS extra FROM p")
def r5_path_enrichment(s, d):
    st, dirs = X.stem(F.col("path")), F.split(X.parent(F.col("path")), "/")
    last = F.slice(dirs, F.greatest(F.lit(1), F.size(dirs) - 2), 3)
    return chunks(s, d, "path").select("id", F.concat_ws(" ", st, st, F.array_join(last, " ")).alias("extra"))


@query("r6_knn_l2", f"WITH {QV}, {L2} SELECT id, round(-score, 5) AS dist FROM kn ORDER BY round(score, 9) DESC, id LIMIT 10")
def r6_knn_l2(s, d):
    return S.knn(table(s, d, "embeddings"), "vec_id", "embedding", _qv(s, d), 10).select("id", F.round(-F.col("score"), 5).alias("dist"))


@query("r7_cosine_topk", f"WITH {QV} SELECT vec_id AS id, round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), q), lambda x: x[1] * x[2])), 5) AS score FROM embeddings, qv WHERE label = 1 ORDER BY round(score, 9) DESC, id LIMIT 10")
def r7_cosine_topk(s, d):
    return S.knn(table(s, d, "embeddings").where("label = 1"), "vec_id", "embedding", _qv(s, d), 10, "cosine").select("id", F.round("score", 5).alias("score"))


@query("r8_dense_threshold", f"WITH {QV}, {L2} SELECT id FROM kn WHERE score >= -1.30")
def r8_dense_threshold(s, d):
    v = table(s, d, "embeddings").crossJoin(F.broadcast(_qv(s, d)))
    return v.where(X.l2(F.col("embedding"), F.col("qv")) <= 1.30).select(F.col("vec_id").alias("id"))


@query("w1_rrf", f"{BM}, r AS ({_TOP.format(t='bm')}) SELECT id, round(1.0 / (60 + rank), 9) AS rrf FROM r WHERE rank <= 40")
def w1_rrf(s, d):
    return S.rrf(S.top(_bm(s, d), 40)).select("id", F.round("rrf", 9).alias("rrf"))


_FUSE = f"""{BM}, {QV}, {L2}, lx AS (SELECT id, 1.0 / (60 + rank) AS l FROM ({_TOP.format(t='bm')}) WHERE rank <= 40), dn AS (SELECT id, 1.0 / (60 + rank) AS s FROM ({_TOP.format(t='kn')}) WHERE rank <= 40),
fu AS (SELECT coalesce(lx.id, dn.id) AS id, 0.3 * coalesce(s, 0) + 0.7 * coalesce(l, 0) AS score FROM lx FULL JOIN dn ON lx.id = dn.id)"""


@query("r10_combine", f"{_FUSE} SELECT id, round(score, 9) AS score FROM fu")
def r10_combine(s, d):
    sem, lex = S.rrf(S.knn(table(s, d, "embeddings"), "vec_id", "embedding", _qv(s, d), 40)), S.rrf(S.top(_bm(s, d), 40))
    return S.combine(sem, lex, 0.3).select("id", F.round("score", 9).alias("score"))


@query("r11_hybrid_lanes", f"""{BM}, {QV}, {L2}, lx AS (SELECT id, score, rank FROM ({_TOP.format(t='bm')}) WHERE rank <= 40), d0 AS (SELECT id, score, rank FROM ({_TOP.format(t='kn')}) WHERE rank <= 40), dn AS (SELECT * FROM d0 WHERE score >= -1.3 AND id IN (SELECT id FROM ch)),
fu AS (SELECT coalesce(lx.id, dn.id) AS id, 0.5 * coalesce(1.0 / (60 + dn.rank), 0) + 0.5 * coalesce(1.0 / (60 + lx.rank), 0) AS score FROM lx FULL JOIN dn ON lx.id = dn.id)
SELECT id, round(score, 9) AS score, 'fusion' AS lane FROM fu ORDER BY round(fu.score, 9) DESC, id LIMIT 10""")
def r11_hybrid_lanes(s, d):
    h = S.hybrid(chunks(s, d, "content"), "id", "content", table(s, d, "embeddings"), "vec_id", "embedding", _q(s), _qv(s, d), 10, 0.5, 1.3, 1.0)
    return h.select("id", F.round("score", 9).alias("score"), "lane")


_SC = f"{BM}, sc AS (SELECT id, path, score FROM bm JOIN ch USING (id))"


def _scored(s, d):
    return _bm(s, d).join(chunks(s, d, "path"), "id").select("id", "path", "score")


@query("r15_coherence", f"{_SC}, x AS (SELECT id, path, score, sum(score) OVER (PARTITION BY path) AS fs, row_number() OVER (PARTITION BY path ORDER BY round(score, 9) DESC, id) AS r FROM sc) SELECT id, round(score + CASE WHEN r = 1 THEN 0.2 * (SELECT max(score) FROM sc) * fs / (SELECT max(fs) FROM x) ELSE 0 END, 6) AS score FROM x")
def r15_coherence(s, d):
    return S.coherence(_scored(s, d)).select("id", F.round("score", 6).alias("score"))


_PEN = "(CASE WHEN regexp_matches(lower(path), '(^|/)(tests?|__tests__|spec|specs|testing)/') OR regexp_matches(lower(regexp_extract(path, '[^/]*$')), '^test_|_test\\.[a-z]+$|\\.(test|spec)\\.[a-z]+$|tests?\\.(java|kt|cs|swift)$|^conftest\\.py$') THEN 0.3 ELSE 1 END * CASE WHEN regexp_extract(path, '[^/]*$') IN ('__init__.py','index.ts','index.js','mod.rs','lib.rs') THEN 0.5 ELSE 1 END * CASE WHEN regexp_matches(lower(path), '(^|/)(compat|_compat|legacy|deprecated)(/|\\.)') THEN 0.3 ELSE 1 END * CASE WHEN regexp_matches(lower(path), '(^|/)(examples?|docs_src)/') THEN 0.3 ELSE 1 END * CASE WHEN ends_with(lower(path), '.d.ts') THEN 0.7 ELSE 1 END)"


@query("r16_path_penalty", f"WITH {CH} SELECT id, round({_PEN}::DOUBLE, 6) AS penalty FROM ch")
def r16_path_penalty(s, d):
    return chunks(s, d, "path").select("id", F.round(X.path_penalty(F.col("path")), 6).alias("penalty"))


@query("w2_saturation", f"{_SC}, p AS (SELECT id, path, score * {_PEN} AS score FROM sc) SELECT id, round(score * pow(0.5, row_number() OVER (PARTITION BY path ORDER BY round(score, 9) DESC, id) - 1), 6) AS score FROM p")
def w2_saturation(s, d):
    return S.saturate(_scored(s, d)).select("id", F.round("score", 6).alias("score"))


@query("r17_rerank", f"{_SC}, p AS (SELECT id, path, score * {_PEN} AS score FROM sc), q AS (SELECT id, score * pow(0.5, row_number() OVER (PARTITION BY path ORDER BY round(score, 9) DESC, id) - 1) AS score FROM p) SELECT id, round(score, 6) AS score FROM q ORDER BY round(q.score, 9) DESC, id LIMIT 15")
def r17_rerank(s, d):
    return S.rerank(_scored(s, d), 15).select("id", F.round("score", 6).alias("score"))


@query("t1_topk", f"{BM} SELECT id, round(score, 6) AS score FROM bm WHERE score > 0 ORDER BY round(bm.score, 9) DESC, id LIMIT 3")
def t1_topk(s, d):
    return S.top(_bm(s, d), 3).select("id", F.round("score", 6).alias("score"))


@query("r20_related_lexical", f"WITH {CH}, src AS (SELECT id, repo, path, trim(substr(regexp_replace(content, '\\s+', ' ', 'g'), 1, 20)) AS t FROM ch ORDER BY id LIMIT 1) SELECT ch.id FROM ch, src WHERE contains(lower(ch.content), lower(t)) AND NOT (ch.repo = src.repo AND ch.path = src.path) ORDER BY ch.id LIMIT 5")
def r20_related_lexical(s, d):
    c = chunks(s, d, "repo", "path", "content")
    src = c.orderBy("id").limit(1).select(F.col("repo").alias("r0"), F.col("path").alias("p0"), F.trim(F.substring(F.regexp_replace("content", r"\s+", " "), 1, 20)).alias("t"))
    hit = c.crossJoin(F.broadcast(src)).where(F.contains(F.lower("content"), F.lower("t")) & ~((F.col("repo") == F.col("r0")) & (F.col("path") == F.col("p0"))))
    return hit.orderBy("id").limit(5).select("id")


@query("r21_context_score", "WITH c AS (SELECT DISTINCT item_id, query_id, lower(coalesce(symbol, '')) AS sym, lower(coalesce(path, '')) AS p FROM context_items), t AS (SELECT query_id, unnest(regexp_split_to_array(lower(query_text), ' ')) AS t FROM query_log) SELECT item_id, query_id, CAST(sum(CASE WHEN contains(sym, t) THEN 3 ELSE 0 END + CASE WHEN contains(p, t) THEN 1.5 ELSE 0 END) AS DOUBLE) AS score FROM c JOIN t USING (query_id) WHERE length(t) > 2 GROUP BY 1, 2, sym, p")
def r21_context_score(s, d):
    c = table(s, d, "context_items").select("item_id", "query_id", F.lower(F.coalesce("symbol", F.lit(""))).alias("sym"), F.lower(F.coalesce("path", F.lit(""))).alias("p")).distinct()
    t = table(s, d, "query_log").select("query_id", F.filter(F.split(F.lower("query_text"), " "), lambda x: F.length(x) > 2).alias("ts")).where("size(ts) > 0")
    part = F.transform("ts", lambda x: F.when(F.contains("sym", x), 3.0).otherwise(0.0) + F.when(F.contains("p", x), 1.5).otherwise(0.0))
    return c.join(t, "query_id").select("item_id", "query_id", F.aggregate(part, F.lit(0.0), lambda a, b: a + b).alias("score"))


@query("r24_lane_warning", "SELECT lane, CASE lane WHEN 'bm25_only' THEN 'no vectors: lexical results only' WHEN 'semantic_only' THEN 'no lexical hit: similar vectors only' WHEN 'substring' THEN 'no ranked hit: plain substring matches' ELSE NULL END AS warning FROM (VALUES ('fusion'), ('bm25_only'), ('semantic_only'), ('substring'), ('empty')) v(lane)")
def r24_lane_warning(s, d):
    v = s.createDataFrame([(x,) for x in ("fusion", "bm25_only", "semantic_only", "substring", "empty")], "lane string")
    return v.select("lane", F.when(F.col("lane") == "bm25_only", "no vectors: lexical results only").when(F.col("lane") == "semantic_only", "no lexical hit: similar vectors only").when(F.col("lane") == "substring", "no ranked hit: plain substring matches").alias("warning"))
