"""Retrieval: BM25, vectors, reciprocal rank fusion with named lanes, re-ranking.

The corpus is cut down to a lane's candidates before anything global is ranked. Scores that agree to nine decimals
are ties (sums of the same terms in another order differ beyond), and ties always go to the smaller id.
Query terms, query vectors and corpus totals are single rows or a handful, hence broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratigraph.functions import text as X

K1, B, RRF_K = 1.5, 0.75, 60


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf, dl."""
    t = docs.select(F.col(id_col).alias("id"), X.tokenize(F.col(text_col)).alias("_t"))
    t = t.select("id", F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    return t.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25(docs: DataFrame, query: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """qid, id, score (positive). ``query``: qid, text; a repeated term of the query counts each time.

    One tokenisation of the corpus: documents without a query term only contribute their length.
    """
    q = query.select("qid", F.explode(X.tokenize(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qn"))
    terms = q.select("term").distinct()
    base = docs.select(F.col(id_col).alias("id"), X.tokenize(F.col(text_col)).alias("_t"))
    stats = base.agg(F.count("*").alias("n"), F.avg(F.size("_t")).alias("avgdl"))
    p = base.select("id", F.size("_t").alias("dl"), F.explode("_t").alias("term")).join(F.broadcast(terms), "term").groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = df.crossJoin(F.broadcast(stats)).select("term", idf.alias("idf"), "avgdl")
    s = p.join(F.broadcast(w), "term").join(F.broadcast(q), "term")
    part = F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return s.groupBy("qid", "id").agg(F.sum(part).alias("score")).where("score > 0")


def top(df: DataFrame, k: int, score: str = "score", per: list[str] | None = None) -> DataFrame:
    """The k best, per group if asked; ``rank`` starts at 1."""
    if per:
        w = Window.partitionBy(*per).orderBy(F.desc(F.round(score, 9)), "id")
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    small = df.orderBy(F.desc(F.round(score, 9)), "id").limit(k)
    return small.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round(score, 9)), "id")))


def knn(vectors: DataFrame, id_col: str, vec_col: str, qvec: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """id, score (minus distance, or cosine of unit vectors), rank: the k nearest to the one row ``qvec`` (qv)."""
    f = (lambda a, b: -X.l2(a, b)) if metric == "l2" else X.dot
    s = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).crossJoin(F.broadcast(qvec)).where(F.size("v") == F.size("qv"))
    return top(s.select("id", f(F.col("v"), F.col("qv")).alias("score")), k)


def rrf(ranked: DataFrame) -> DataFrame:
    """id, rrf: 1 / (60 + best rank) of each id."""
    return ranked.groupBy("id").agg((1.0 / (RRF_K + F.min("rank"))).alias("rrf"))


def combine(sem: DataFrame, lex: DataFrame, alpha: float) -> DataFrame:
    """id, score = alpha * sem + (1 - alpha) * lex over the union of both; missing counts as 0."""
    both = sem.select("id", F.col("rrf").alias("s")).join(lex.select("id", F.col("rrf").alias("l")), "id", "full_outer")
    return both.select("id", (alpha * F.coalesce("s", F.lit(0.0)) + (1 - alpha) * F.coalesce("l", F.lit(0.0))).alias("score"))


def hybrid(docs: DataFrame, id_col: str, text_col: str, vectors: DataFrame, vec_id: str, vec_col: str, query: DataFrame, qvec: DataFrame, k: int = 10, alpha: float = 0.5, max_dist: float = 1.10, strict: float = 1.00) -> DataFrame:
    """id, score, rank, lane. Lanes: fusion, bm25_only, semantic_only (strict distance), substring, empty.

    One plan: the lane is chosen by flags over the few candidate rows, not by actions.
    """
    lex = top(bm25(docs, query, id_col, text_col).select("id", "score"), 4 * k)
    dense = knn(vectors, vec_id, vec_col, qvec, 4 * k).where(F.col("score") >= -max_dist)
    dense = dense.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    fused = combine(rrf(dense), rrf(lex), alpha)
    q = query.select(F.lower("text").alias("_q")).limit(1)
    sub = docs.crossJoin(F.broadcast(q)).where(F.contains(F.lower(F.col(text_col)), F.col("_q"))).select(F.col(id_col).alias("id")).orderBy("id").limit(k)
    flags = lex.agg(F.count("*").alias("nl")).crossJoin(dense.agg(F.count("*").alias("nd"), F.count_if(F.col("score") >= -strict).alias("ns")))
    lane = F.when((F.col("nl") > 0) & (F.col("nd") > 0), "fusion").when(F.col("nl") > 0, "bm25_only").when(F.col("ns") > 0, "semantic_only").otherwise("substring")
    cand = (
        fused.select("id", "score", F.lit("fusion").alias("lane"))
        .unionByName(lex.select("id", "score", F.lit("bm25_only").alias("lane")))
        .unionByName(dense.where(F.col("score") >= -strict).select("id", "score", F.lit("semantic_only").alias("lane")))
        .unionByName(sub.select("id", F.lit(1.0).alias("score"), F.lit("substring").alias("lane")))
    )
    chosen = cand.join(F.broadcast(flags.select(lane.alias("lane"))), "lane")
    return top(chosen, k)


def coherence(scored: DataFrame, weight: float = 0.2) -> DataFrame:
    """Adds to the best chunk of each file weight * max score * its file's share. ``scored``: id, path, score."""
    f = Window.partitionBy("path")
    x = scored.withColumn("fs", F.sum("score").over(f)).withColumn("r", F.row_number().over(f.orderBy(F.desc(F.round("score", 9)), "id")))
    m = scored.agg(F.max("score").alias("ms")).crossJoin(scored.groupBy("path").agg(F.sum("score").alias("fs")).agg(F.max("fs").alias("mf")))
    x = x.crossJoin(F.broadcast(m))
    return x.select("id", "path", (F.col("score") + F.when((F.col("r") == 1) & (F.col("mf") > 0), weight * F.col("ms") * F.col("fs") / F.col("mf")).otherwise(0.0)).alias("score"))


def saturate(scored: DataFrame) -> DataFrame:
    """Penalises paths, then halves each further pick of one file. ``scored``: id, path, score."""
    p = scored.select("id", "path", (F.col("score") * X.path_penalty(F.col("path"))).alias("score"))
    n = F.row_number().over(Window.partitionBy("path").orderBy(F.desc(F.round("score", 9)), "id"))
    return p.withColumn("score", F.col("score") * F.pow(F.lit(0.5), n - 1))


def rerank(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of the saturated scores."""
    return top(saturate(scored), k)
