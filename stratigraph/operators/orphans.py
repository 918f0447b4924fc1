"""References to records that do not exist at the moment of the reference.

A reference is orphaned when no row of the target table with that key is alive at the reference's time: recorded
at or before it and not deleted at or before it. Plan:

1. reduce the target table to one row per key with its lifetimes (repeats removed, map-side combined);
2. pre-aggregate the references per key, which also names the heavy keys;
3. heavy keys (at most ``1 / heavy_share`` of them by construction) take their lifetimes from a small map broadcast
   to every task, so a key with a third of all rows is never gathered in one task;
4. all other keys are joined by a shuffle on the key; both parts are united.

Cases: null or blank keys are no references; a null reference time or a null recorded_at compares with nothing, so
such a reference is an orphan and such a target row is never alive; letter case and outer blanks of keys carry no
meaning; repeated rows count once; extra columns are ignored; an empty target table makes every reference orphaned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratigraph.session import cut

BLANK = r"^\s+|\s+$"


def norm_key(c: Column) -> Column:
    """Lower case, without outer white space; null when blank."""
    k = F.lower(F.regexp_replace(c, BLANK, ""))
    return F.when(k != "", k)


def lifetimes(nodes: DataFrame, key: str = "id", born: str = "recorded_at", gone: str = "deleted_at") -> DataFrame:
    """One row per key: ``key`` and the distinct ``lives`` (array of struct born, gone)."""
    return (
        nodes.select(norm_key(F.col(key)).alias("key"), F.col(born).alias("born"), F.col(gone).alias("gone"))
        .where("key is not null and born is not null and (gone is null or gone > born)")
        .groupBy("key")
        .agg(F.collect_set(F.struct("born", "gone")).alias("lives"))
    )


def references(edges: DataFrame, ref_id: str = "edge_id", at: str = "recorded_at", ends: dict[str, str] | None = None) -> DataFrame:
    """The endpoints that are references: ref_id, endpoint, key, at. One pass over ``edges``, no union of scans."""
    ends = ends or {"from": "from_id", "to": "to_id"}
    return (
        edges.select(
            F.col(ref_id).alias("ref_id"),
            F.col(at).alias("at"),
            F.explode(F.array(*[F.struct(F.lit(e).alias("endpoint"), norm_key(F.col(c)).alias("key")) for e, c in ends.items()])).alias("e"),
        )
        .select("ref_id", "at", "e.endpoint", "e.key")
        .where("key is not null")
    )


def dead_at(at: Column, lives: Column) -> Column:
    """True when none of ``lives`` covers ``at``."""
    alive = F.exists(lives, lambda x: (x["born"] <= at) & (x["gone"].isNull() | (x["gone"] > at)))
    return ~F.coalesce(alive, F.lit(False))


def heavy_keys(refs: DataFrame, lives: DataFrame, most: int, heavy_share: float, max_lives: int) -> list[str]:
    """Keys with more than ``heavy_share`` of ``most`` references and at most ``max_lives`` lifetimes: 1 / heavy_share at most."""
    n = refs.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > heavy_share * most)
    keys = [r["key"] for r in n.orderBy(F.desc("n"), "key").limit(int(1 / heavy_share)).collect()]
    if not keys:
        return []
    size = {r["key"]: r["s"] for r in lives.where(F.col("key").isin(keys)).select("key", F.size("lives").alias("s")).collect()}
    return [k for k in keys if size.get(k, 0) <= max_lives]


def with_lives(rows: DataFrame, lives: DataFrame, heavy: list[str]) -> DataFrame:
    """Rows with the lifetimes of their key: heavy keys by a broadcast of as many short rows, all others by a shuffle."""
    if not heavy:
        return rows.join(lives, "key", "left")
    is_heavy = F.col("key").isin(heavy)
    few = rows.sparkSession.createDataFrame([(k,) for k in heavy], "key string").join(lives.where(is_heavy), "key", "left")
    return rows.where(is_heavy).join(F.broadcast(few), "key", "left").unionByName(rows.where(~is_heavy).join(lives, "key", "left"))


def orphan_references(nodes: DataFrame, edges: DataFrame, heavy_share: float = 0.005, ref_id: str = "edge_id", ends: dict[str, str] | None = None, max_lives: int = 10_000) -> DataFrame:
    """Orphaned references: ref_id, endpoint, key, at; repeated references may repeat.

    ``heavy_share``: a key with more than this share of all references is heavy; there are at most 1/heavy_share. One with
    more than ``max_lives`` lifetimes is not broadcast.
    """
    lives, refs = lifetimes(nodes), references(edges, ref_id=ref_id, ends=ends)
    heavy = heavy_keys(refs, lives, edges.count() * len(ends or "ft"), heavy_share, max_lives)
    return with_lives(refs, lives, heavy).where(dead_at(F.col("at"), F.col("lives"))).select("ref_id", "endpoint", "key", "at")


def orphan_report(nodes: DataFrame, edges: DataFrame, period: str = "month", heavy_share: float = 0.005, ref_id: str = "edge_id", ends: dict[str, str] | None = None, max_lives: int = 10_000) -> DataFrame:
    """Orphans per table end and period: endpoint, period, orphans (distinct references), keys (distinct keys).

    References are counted per end, key and period first, with the first and the last moment. Where one lifetime of the key
    covers that span, or none touches it, the count is the answer; only references of keys that are born or go within it
    are judged one by one. Counts of both are united.
    """
    lives = lifetimes(nodes)
    rows = references(edges, ref_id=ref_id, ends=ends)
    group = ["endpoint", "key", "period"]
    rows = rows.withColumn("period", F.date_trunc(period, "at"))
    heavy = heavy_keys(rows, lives, edges.count() * len(ends or "ft"), heavy_share, max_lives)
    per = rows.select(*group, "ref_id", "at").distinct().groupBy(*group).agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    life = with_lives(per, lives, heavy)
    some = lambda test: F.coalesce(F.exists("lives", test), F.lit(False))
    covered = some(lambda x: (x["born"] <= F.col("lo")) & (x["gone"].isNull() | (x["gone"] > F.col("hi"))))
    touched = some(lambda x: (x["born"] <= F.col("hi")) & (x["gone"].isNull() | (x["gone"] > F.col("lo"))))
    judged = cut(life.select(*group, "n", F.when(covered, "alive").when(touched, "both").otherwise("dead").alias("state")))
    both = judged.where("state = 'both'").select("endpoint", "key", F.col("period").alias("_p"))
    # null periods are null moments, which no lifetime touches: equality will do
    is_heavy = F.col("key").isin(heavy) if heavy else F.lit(False)
    on = [rows[c] == both[b] for c, b in (("endpoint", "endpoint"), ("key", "key"), ("period", "_p"))]
    # heavy keys times periods times ends: as bounded as the heavy keys
    single = rows.where(is_heavy).join(F.broadcast(both.where(is_heavy)), on, "left_semi").unionByName(rows.where(~is_heavy).join(both.where(~is_heavy), on, "left_semi"))
    exact = with_lives(single, lives, heavy).where(dead_at(F.col("at"), F.col("lives"))).select(*group, "ref_id", "at").distinct().groupBy(*group).agg(F.count("*").alias("n"))
    counts = judged.where("state = 'dead'").select(*group, "n").unionByName(exact)
    return counts.groupBy("endpoint", "period").agg(F.sum("n").alias("orphans"), F.count_distinct("key").alias("keys"))
