import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratigraph.llm.rank_walk import fused_ranking, rank_walk

SCHEMA = "q int, i int, a double, b double, c double, extra string"


def brute(rows, damping):
    """Dense transition matrix, solved exactly."""
    out = {}
    for q in {r[0] for r in rows}:
        its = [r for r in rows if r[0] == q]
        n = len(its)
        p = np.zeros((n, n))
        for k in (2, 3, 4):
            v = [-math.inf if r[k] is None or math.isnan(r[k]) else r[k] for r in its]
            for x in range(n):
                h = [y for y in range(n) if v[y] > v[x]]
                p[x, h] += 1 / 3 / n
                p[x, x] += (1 - len(h) / n) / 3
        w = np.linalg.solve(np.eye(n) - damping * p.T, np.full(n, (1 - damping) / n))
        out |= {(q, r[1]): w[x] for x, r in enumerate(its)}
    return out


def make(seed=3):
    r = random.Random(seed)
    val = lambda: r.choice([None, math.nan, 0.0, -1.5, r.random() * 10 ** r.randint(-3, 6), 7.0])
    return [(q, i, val(), val(), val(), "x") for q in range(6) for i in range(r.randint(1, 30))]


@pytest.mark.parametrize("max_group, damping", [(1000, 0.85), (1000, 0.3)])
def test_equals_dense_matrix(spark, max_group, damping):
    rows = make()
    got = {(r.q, r.i): (r.weight, r.place) for r in rank_walk(spark.createDataFrame(rows, SCHEMA), "q", "i", ["a", "b", "c"], damping, max_group=max_group).collect()}
    want = brute(rows, damping)
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][0] == pytest.approx(w, abs=1e-9)
    for q in range(6):
        order = sorted((k for k in want if k[0] == q), key=lambda k: (-round(want[k], 8), k[1]))
        assert [k for k in sorted(order, key=lambda k: got[k][1])] == order


def test_both_paths_take_the_same_steps(spark):
    df = spark.createDataFrame(make(5), SCHEMA)
    a, b = ({(r.q, r.i): (round(r.weight, 12), r.place) for r in rank_walk(df, "q", "i", ["a", "b", "c"], 0.85, max_group=m, block=3, steps=3).collect()} for m in (1000, 5))
    assert a == b


def test_long_walks_follow_all_scores(spark):
    """At any damping the leaders are those with the best mean standing, when these stand out."""
    r = random.Random(1)
    rows = [(0, i, float(i), -float((i * 7) % 40), math.exp(i % 13)) for i in range(40)]
    rows += [(0, 100 + i, 35.5 + i, -2.5 - i, math.exp(11.5 + i / 10)) for i in range(3)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "q int, i int, a double, b double, c double")
    for damping in (0.1, 0.85, 0.99):
        top = {x.i for x in rank_walk(df, "q", "i", ["a", "b", "c"], damping).where("place <= 3").collect()}
        assert top == {100, 101, 102}, damping


def test_hot_standing_and_large_path(spark):
    """A score that all items share, null or not, is one level; places by item."""
    df = spark.range(500).select(F.lit(1).alias("q"), F.col("id").alias("i"), F.lit(None).cast("double").alias("a"), F.lit(2.0).alias("b"))
    got = rank_walk(df, "q", "i", ["a", "b"], 0.5, max_group=10, block=50, steps=1).orderBy("place").collect()
    assert [x.i for x in got] == list(range(500)) and [x.place for x in got] == list(range(1, 501))


def test_range_does_not_matter_and_empty(spark):
    rows = make(9)
    df = spark.createDataFrame(rows, SCHEMA)
    a = rank_walk(df, "q", "i", ["a", "b", "c"]).select("q", "i", "place")
    b = rank_walk(df.withColumn("a", F.col("a") * 1e9 + 3), "q", "i", ["a", "b", "c"]).select("q", "i", "place")
    assert sorted(a.collect()) == sorted(b.collect())
    assert rank_walk(df.limit(0), "q", "i", ["a", "b", "c"]).count() == 0


def test_current_rows_only(spark):
    ci = spark.createDataFrame([(1, 1, 5.0, 5.0, 1), (1, 1, 0.0, 0.0, 2), (1, 2, 1.0, 1.0, 1), (1, 2, 1.0, 1.0, 1), (None, 3, 1.0, 1.0, 1)], "query_id int, item_id int, relevance_score double, confidence double, t int")
    ci = ci.withColumn("scored_at", F.timestamp_seconds("t"))
    fe = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.5), (1, 9, 1.0)], "query_id int, item_id int, score double")
    assert [(r.item_id, r.place) for r in fused_ranking(ci, fe).orderBy("place").collect()] == [(2, 1), (1, 2)]


@pytest.mark.parametrize("max_group", [1_000_000, 10])
def test_large_group_has_no_false_ties(spark, max_group):
    # 60,000 distinct scores: weights next to each other differ by less than 1e-10
    df = spark.range(60_000).select(F.lit("q").alias("q"), F.col("id").alias("i"), F.expr("cast(id * 7919 % 100003 as double)").alias("a"))
    got = rank_walk(df, "q", "i", ["a"], 0.85, max_group=max_group, block=10_000, steps=1).join(df, ["q", "i"]).orderBy("place").toPandas()
    assert (got["a"].diff().dropna() < 0).all() and got["place"].tolist() == list(range(1, 60_001))
