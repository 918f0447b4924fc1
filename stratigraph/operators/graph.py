"""The code graph: current nodes and edges, hydration, traversals, cycles, roll-ups.

Ids compare without letter case and outer blanks; null or blank ids are no ids; of several rows of one node the last
recorded counts, and a node deleted then is not there; repeated edges are one edge with the greatest confidence. Traversals go
level by level with joins against a visited set; each level cuts its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratigraph.session import cut

CODE_KINDS = ["type", "method", "function", "idlmethod", "idlservice"]
FIELDS = ["kind", "repo", "path", "symbol", "summary", "visibility", "native_kind", "loc_start", "loc_end", "deprecated"]


def current_nodes(nodes: DataFrame) -> DataFrame:
    """One row per living node."""
    n = nodes.withColumn("id", F.lower(F.trim("id"))).where("id != ''")
    order = F.struct("recorded_at", "kind", "repo", "path", "symbol", "loc_start", "deleted_at")
    cur = n.groupBy("id").agg(F.max_by(F.struct(*FIELDS, "deleted_at"), order).alias("n"))
    return cur.where("n.deleted_at is null").select("id", *[F.col(f"n.{c}").alias(c) for c in FIELDS])


def current_edges(edges: DataFrame) -> DataFrame:
    """from_id, to_id, kind, confidence: a row per distinct edge."""
    e = edges.select(F.lower(F.trim("from_id")).alias("from_id"), F.lower(F.trim("to_id")).alias("to_id"), "kind", F.col("confidence").cast("double").alias("confidence"))
    return e.where("from_id != '' and to_id != ''").groupBy("from_id", "to_id", "kind").agg(F.max("confidence").alias("confidence"))


def hydrate(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both end nodes; dangling ones are left out. Columns src_* and dst_*."""
    side = lambda p, k: nodes.select(F.col("id").alias(k), *[F.col(c).alias(f"{p}_{c}") for c in ("kind", "repo", "path", "symbol")])
    return edges.join(side("src", "from_id"), "from_id").join(side("dst", "to_id"), "to_id")


def reach(edges: DataFrame, starts: DataFrame, depth: int, pre_visit: bool = True) -> DataFrame:
    """start-less breadth-first search: id, depth, via (least neighbour at the first depth). ``starts``: id; edges: a -> b.

    With ``pre_visit`` starts are not reported again. Empty starts or depth 0 give an empty result.
    """
    frontier = starts.select("id").distinct()
    seen = frontier if pre_visit else frontier.limit(0)
    out = frontier.limit(0).select("id", F.lit(0).alias("depth"), F.col("id").alias("via"))
    for d in range(1, depth + 1):
        nxt = edges.join(frontier, edges["a"] == frontier["id"]).groupBy("b").agg(F.min("a").alias("via")).select(F.col("b").alias("id"), "via")
        nxt = cut(nxt.join(seen, "id", "left_anti"))
        out = out.unionByName(nxt.select("id", F.lit(d).alias("depth"), "via"))
        frontier = nxt.select("id")
        seen = seen.unionByName(frontier)
    return out


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component (its least id) of nodes on cycles of two or more. ``edges``: a, b.

    Nodes without predecessor or successor are trimmed away first; on what is left, the least id is pushed forward until
    nothing changes, and whoever reaches that id backwards within its colour is in its component.
    """
    e = cut(edges.where("a != b").select("a", "b").distinct())
    out = None
    while True:  # each round takes a component out; ends when no edge is left
        while True:  # trim
            n = e.count()
            e2 = cut(e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            e = e2
            if e.count() == n:
                break
        if not n:
            break
        colour = cut(e.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("c", F.col("id")))
        while True:
            up = e.join(colour.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("c").alias("m"))
            new = cut(colour.join(up, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c")))
            if not new.join(colour.withColumnRenamed("c", "o"), "id").where("c != o").limit(1).count():
                break
            colour = new
        inner = cut(e.join(colour.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb").select("a", "b", F.col("ca").alias("c")))
        found = cut(colour.where("id = c"))
        front = found
        while True:  # backwards inside a colour
            nxt = inner.join(front.select(F.col("id").alias("b"), F.col("c").alias("fc")), "b").where("c = fc").select(F.col("a").alias("id"), "c").distinct()
            front = cut(nxt.join(found, ["id", "c"], "left_anti"))
            if not front.limit(1).count():
                break
            found = cut(found.unionByName(front))
        out = found if out is None else out.unionByName(found)
        gone = found.select("id")
        e = cut(e.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"))
    if out is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    size = out.groupBy("c").count().where("count > 1").select("c")
    return out.join(size, "c").select("id", F.col("c").alias("component"))


def unique_names(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """name, id of names that exactly one node has and that are no noise: four characters or more, not all lower case."""
    n = nodes.where(F.col("kind").isin(kinds) & (F.length("symbol") >= 4) & ~F.col("symbol").rlike("^[a-z]+$"))
    return n.groupBy(F.col("symbol").alias("name")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


def repo_degree(pairs: DataFrame) -> DataFrame:
    """repo, degree, place, hub from (src_repo, dst_repo, n)."""
    ends = pairs.select(F.explode(F.array("src_repo", "dst_repo")).alias("repo"), "n").groupBy("repo").agg(F.sum("n").alias("degree"))
    w = Window.orderBy(F.desc("degree"), "repo")  # one row per repository
    r = ends.withColumn("place", F.row_number().over(w))
    n = ends.agg(F.count("*").alias("k"))
    return r.crossJoin(F.broadcast(n)).select("repo", "degree", "place", (F.col("place") <= F.when(F.col("k") > 6, 2).otherwise(1)).alias("hub"))
