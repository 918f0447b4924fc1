"""One ranking from several differently scaled scores: a rank-walk Markov chain.

From an item the walk picks one of the scores, each equally likely, draws an item of the group and jumps there if it stands
strictly higher in that score, else it stays: a uniform jump among the higher items, taken with their share of the group.
With probability 1 - damping it restarts anywhere in the group. The stationary weight orders the items. Only standings
enter, so no score's range or distribution matters, and none decides alone: an item near the top of one score is left as soon
as another one is picked. (Jumping from everywhere with certainty, however few items stand higher, lets nearly all mass
climb to the leaders of single scores: the longer the walk, the less the other scores count.)

A jump to every higher item is never materialised: with the items sorted by a score, the mass that reaches an item is
the sum over all lower ones divided by the size, i.e. one sorted prefix sum per score and step. The iteration contracts by
the damping, so it ends at any damping below 1.

Groups of up to ``max_group`` items are packed together into arrays and iterated at once; the sums run over the
concatenation of many groups. Larger groups run the same steps to the same tolerance as DataFrames: weights are added up per
standing, so ties are one row, prefix sums go by blocks of ``block`` consecutive standings, and a standing shared by many
items meets its sum by a broadcast of at most ``64`` rows per score. No group is ever gathered in one task.

Cases: null and NaN scores are worst and tie with each other; ties are jumped over together; an item without a row in
a score is worst there; repeated rows count once; empty input gives an empty result; equal weights are ordered by item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratigraph.session import cut

WORST = float("-inf")


def clean(c: str):
    """Score with null and NaN as minus infinity."""
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(WORST)).otherwise(x)


def _starts(g: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)


def enough_steps(damping: float, tol: float) -> int:
    """Steps after which no weight is further than ``tol`` of the whole from the stationary one: each takes off 1 - damping."""
    return math.ceil(math.log(tol) / math.log(damping)) + 1 if damping > 0 else 1


def walk(group: np.ndarray, scores: list[np.ndarray], damping: float, tol: float, steps: int | None = None) -> np.ndarray:
    """Stationary weights of every item; ``group`` holds consecutive numbers of the groups, equal ones adjacent."""
    n = len(group)
    if n == 0:
        return np.zeros(0)
    first = _starts(group)
    size = np.diff(np.r_[first, n])[np.cumsum(np.isin(np.arange(n), first)) - 1].astype(float)
    plans = []
    hold = np.zeros(n)
    for s in scores:
        o = np.lexsort((-s, group))
        go, so = group[o], s[o]
        head = np.r_[True, (go[1:] != go[:-1]) | (so[1:] != so[:-1])]
        tie_first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        ends = np.r_[np.flatnonzero(head)[1:], n]
        tie_end = ends[np.cumsum(head) - 1]
        g_first = first[np.cumsum(np.r_[True, go[1:] != go[:-1]]) - 1]
        g_end = (g_first + size[o]).astype(int)
        hold[o] += 1 - (tie_first - g_first) / size[o]
        plans.append((o, tie_end, g_end))
    w = 1.0 / size
    for _ in range(steps or enough_steps(damping, tol)):
        new = w * hold
        for o, tie_end, g_end in plans:
            c = np.r_[0.0, np.cumsum(w[o])]
            new[o] += (c[g_end] - c[tie_end]) / size[o]
        new = damping * new / len(plans) + (1 - damping) / size
        done = (np.abs(new - w) * size).max() < tol
        w = new
        if done:
            break
    return w


def rank_walk(items: DataFrame, group: str, item: str, scores: list[str], damping: float = 0.85, tol: float = 1e-12, max_group: int = 1_000_000, block: int = 100_000, steps: int | None = None) -> DataFrame:
    """group, item, weight, place (1 is best). ``items`` has one row per (group, item) with all scores.

    ``steps`` fixes the number of steps; without it the walk goes on until no weight changes by ``tol`` of the mean weight.
    """
    # private names: the caller's may clash with those of the steps
    names = (group, item)
    src = items.select(F.col(group).alias("_group"), F.col(item).alias("_item"), *[clean(s).alias(f"_score{k}") for k, s in enumerate(scores)])
    group, item, scores = "_group", "_item", [f"_score{k}" for k in range(len(scores))]
    sizes = src.groupBy(group).count()
    # at most total/max_group groups are larger
    large = [r[0] for r in sizes.where(F.col("count") > max_group).select(group).collect()]
    schema = f"{group} {dict(src.dtypes)[group]}, {item} {dict(src.dtypes)[item]}, weight double, place bigint"
    is_large = F.col(group).isin(large) if large else F.lit(False)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(p: pd.DataFrame) -> pd.DataFrame:
            p = p.reset_index(drop=True)
            g = pd.factorize(p[group])[0]
            w = walk(g, [p[s].to_numpy(float) for s in scores], damping, tol, steps)
            q = pd.DataFrame({group: p[group], item: p[item], "weight": w})
            # sums of the same terms in another order differ in the last digits: such weights are equal; weights are
            # about 1 / size, so digits count relative to that
            o = np.lexsort((p[item].to_numpy(), -np.round(w * np.bincount(g)[g], 10), g))
            pos = np.empty(len(o), np.int64)
            gs = g[o]
            f = _starts(gs)
            pos[o] = np.arange(len(o)) - f[np.cumsum(np.isin(np.arange(len(o)), f)) - 1] + 1
            q["place"] = pos
            return q

        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= 100_000:
                p = pd.concat(held, ignore_index=True)
                last = p[group] == p[group].iloc[-1]
                if not last.all():
                    yield solve(p[~last])
                held = [p[last]]
        if held:
            p = pd.concat(held, ignore_index=True)
            if len(p):
                yield solve(p)

    small = src.where(~is_large & F.col(group).isNotNull()) if large else src.where(F.col(group).isNotNull())
    out = small.repartition(F.col(group)).sortWithinPartitions(group).mapInPandas(packed, schema)
    if large:
        out = out.unionByName(_walk_large(src.where(is_large), group, item, scores, damping, tol, block, steps).select(group, item, "weight", "place"))
    return out.select(F.col(group).alias(names[0]), F.col(item).alias(names[1]), "weight", "place")


def _levels(df: DataFrame, group: str, score: str, block: int) -> DataFrame:
    """A row per distinct value of a group: group, score, h (items that stand strictly higher), n (items with it).

    Values are spread over tasks by ranges, counts of ranges give the offsets; ties are one row, however many.
    """
    v = df.groupBy(group, score).agg(F.count("*").alias("n"))
    parts = max(1, -(-v.count() // block))
    x = cut(v.repartitionByRange(parts, F.col(group), F.desc(score)).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    off = x.groupBy(group, "_p").agg(F.sum("n").alias("_s")).select(group, "_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(group, "_p").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(off, [group, "_p"]).select(group, score, (F.col("_off") + F.col("_in")).alias("h"), "n")


def _meet(df: DataFrame, levels: DataFrame, keys: list[str], size: DataFrame) -> DataFrame:
    """Rows with what belongs to their level; levels with over a 64th of a group's items, 64 a group at most, are broadcast."""
    hot = levels.join(F.broadcast(size), keys[0]).where(F.col("n") * 64 > F.col("_size")).drop("_size")
    flag = hot.select(*keys, F.lit(True).alias("_hot"))
    x = df.join(F.broadcast(flag), keys, "left")
    return x.where("_hot").drop("_hot").join(F.broadcast(hot), keys).unionByName(x.where("_hot is null").drop("_hot").join(levels, keys))


def _walk_large(df: DataFrame, group: str, item: str, scores: list[str], damping: float, tol: float, block: int, steps: int | None) -> DataFrame:
    """The walk as DataFrames for groups that no task should hold."""
    size = cut(df.groupBy(group).agg(F.count("*").alias("_size")))  # one row per large group
    counts = None
    for k, s in enumerate(scores):
        lv = cut(_levels(df, group, s, block))
        df = cut(_meet(df, lv, [group, s], size).withColumnRenamed("h", f"h{k}").drop("n", s))
        c = lv.select(group, F.lit(k).alias("k"), "h", "n")
        counts = c if counts is None else counts.unionByName(c)
    n, keys = len(scores), [group, "k", "h"]
    cur = df.join(F.broadcast(size), group).select(group, item, "_size", F.array(*[F.col(f"h{k}") for k in range(n)]).alias("hs"), (1.0 / F.col("_size")).alias("weight"))
    cur = cut(cur)
    for _ in range(steps or enough_steps(damping, tol)):
        x = cur.select(group, item, "_size", "hs", "weight", F.posexplode("hs").alias("k", "h"))
        per = x.groupBy(*keys).agg(F.sum("weight").alias("t")).withColumn("b", F.floor(F.col("h") / block))
        below = per.groupBy(group, "k", "b").agg(F.sum("t").alias("t"))
        below = below.select(group, "k", "b", F.coalesce(F.sum("t").over(Window.partitionBy(group, "k").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("below"))
        inside = Window.partitionBy(group, "k", "b").orderBy(F.desc("h")).rowsBetween(Window.unboundedPreceding, -1)
        lower = per.withColumn("inside", F.coalesce(F.sum("t").over(inside), F.lit(0.0))).join(below, [group, "k", "b"]).select(*keys, (F.col("inside") + F.col("below")).alias("lower"))
        got = _meet(x, lower.join(counts, keys), keys, size)
        g = got.groupBy(group, item).agg(F.first("_size").alias("_size"), F.first("hs").alias("hs"), F.first("weight").alias("old"), F.sum("lower").alias("g"))
        hold = F.aggregate("hs", F.lit(0.0), lambda a, h: a + 1 - h / F.col("_size"))
        new = damping * (F.col("g") / F.col("_size") + F.col("old") * hold) / n + (1 - damping) / F.col("_size")
        step = cut(g.select(group, item, "_size", "hs", new.alias("weight"), "old"))
        delta = step.agg(F.max(F.abs(F.col("weight") - F.col("old")) * F.col("_size"))).first()[0]
        cur = step.drop("old")
        if delta is None or delta < tol:
            break
    rel = cut(cur.select(group, item, "weight", F.round(F.col("weight") * F.col("_size"), 10).alias("relative")))
    # equal weights are ordered by item in buckets of items, so that many of them are no bottleneck either
    placed = _meet(rel, cut(_levels(rel, group, "relative", block)), [group, "relative"], size)
    r = cut(placed.repartitionByRange(max(1, -(-rel.count() // block)), F.col(group), F.col("h"), F.col(item)).withColumn("_p", F.spark_partition_id()))
    off = r.groupBy(group, "h", "_p").agg(F.count("*").alias("_c"))
    off = off.select(group, "h", "_p", F.coalesce(F.sum("_c").over(Window.partitionBy(group, "h").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    own = F.row_number().over(Window.partitionBy(group, "h", "_p").orderBy(item))
    return r.withColumn("_r", own).join(F.broadcast(off.where("_off > 0")), [group, "h", "_p"], "left").withColumn("place", F.col("h") + F.coalesce("_off", F.lit(0)) + F.col("_r")).select(group, item, "weight", "place")


def fused_ranking(context_items: DataFrame, fused_entries: DataFrame, **kw) -> DataFrame:
    """query_id, item_id, weight, place from relevance_score, confidence and the fused score of current rows."""
    ci = context_items.where("query_id is not null and item_id is not null")
    cur = ci.groupBy("query_id", "item_id").agg(
        F.max(F.struct(F.coalesce("scored_at", F.lit("0001-01-01").cast("timestamp")).alias("at"), clean("relevance_score").alias("r"), clean("confidence").alias("c"))).alias("m")
    ).select("query_id", "item_id", F.col("m.r").alias("relevance_score"), F.col("m.c").alias("confidence"))
    fe = fused_entries.groupBy("query_id", "item_id").agg(F.max(clean("score")).alias("score"))
    return rank_walk(cur.join(fe, ["query_id", "item_id"], "left"), "query_id", "item_id", ["relevance_score", "confidence", "score"], **kw)
