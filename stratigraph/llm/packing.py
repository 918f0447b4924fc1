"""Filling fixed-capacity containers with items.

Only the histogram of lengths, at most ``capacity`` numbers whatever the corpus, is brought to the driver. There the
containers are planned as patterns with multiplicities: single lengths, sums of pairs and sums of a length and a pair are
indexed; going from the longest length down, the gap it leaves is filled exactly by what the index gives, as often as the counts allow; what has no exact
complement goes by best fit. Items are then numbered within their length, in buckets so that a length shared by a third
of all items is no bottleneck, and the number of an item selects its place in the plan.

Cases: an item longer than the capacity is split into full containers and one rest that is packed like any other item;
no other item is split; empty and null items need no room and go to container 0; ties are broken by id; repeated ids
are repeated items; empty input gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratigraph.llm.bpe import encode_texts
from stratigraph.session import cut


class Sums:
    """Which lengths add up to a total: single lengths, pairs indexed by their sum, triples by a length and a pair's sum."""

    def __init__(self, avail: np.ndarray, capacity: int):
        self.avail = avail
        have = np.flatnonzero(avail > 0).astype(np.int32)
        firsts, seconds = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for i, a in enumerate(have):
            b = have[: min(i + 1, int(np.searchsorted(have, capacity - a, side="right")))]
            firsts.append(np.full(len(b), a, np.int32))
            seconds.append(b)
        a, total = np.concatenate(firsts), np.concatenate(firsts) + np.concatenate(seconds)
        order = np.argsort(total, kind="stable")[::-1]  # longest first within a sum
        cut = np.searchsorted(-total[order], -np.arange(capacity, 0, -1), side="right")
        self.by = [np.zeros(0, np.int32), *np.split(a[order], cut[:-1])[::-1]] if capacity else []
        self.live = np.array([len(x) for x in self.by]) > 0

    def pairs(self, total: int, top: int) -> np.ndarray:
        """Lengths a >= b with a + b = total, both still there and at most ``top``; as a, descending."""
        a = self.by[total]
        if len(a):  # counts only fall: what is used up leaves the index for good
            self.by[total] = a = a[(self.avail[a] > 0) & (self.avail[total - a] > 0)]
            self.live[total] = len(a) > 0
        return a[np.searchsorted(-a, -top) :]

    def firsts(self, total: int, top: int) -> np.ndarray:
        """Lengths c, descending, still there and at most ``top``, for which some pair of the index adds up to the rest."""
        c = np.arange(min(top, total - 2), 0, -1)
        return c[(self.avail[c] > 0) & self.live[total - c]]


def _exact_fill(avail: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns that fill a container exactly with a longest item and one to three more; lowers ``avail``."""
    plans: list[tuple[dict[int, int], int]] = []
    sums = Sums(avail, capacity)

    def take(sizes: list[int]) -> None:
        need: dict[int, int] = {}
        for s in sizes:
            need[s] = need.get(s, 0) + 1
        m = min(int(avail[s]) // k for s, k in need.items())
        if m > 0:
            for s, k in need.items():
                avail[s] -= m * k
            plans.append((need, m))

    for big in range(capacity, 0, -1):
        if avail[big] <= 0:
            continue
        gap = capacity - big
        if gap == 0:
            take([big])
            continue
        if gap <= big and avail[gap] > 0:
            take([big, gap])
        for a in sums.pairs(gap, big):
            if avail[big] <= 0:
                break
            take([big, int(a), int(gap - a)])
        if avail[big] > 0:
            for c in sums.firsts(gap, big):
                if avail[big] <= 0:
                    break
                for b in sums.pairs(gap - int(c), int(c)):
                    if avail[big] <= 0 or avail[c] <= 0:
                        break
                    take([big, int(c), int(b), int(gap - c - b)])
    return plans


def _best_fit(avail: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over groups of equally filled containers; lowers ``avail`` to zero."""
    by_gap: dict[int, list[tuple[dict[int, int], int]]] = {}
    open_gaps = np.zeros(capacity + 1, bool)

    def put(pattern: dict[int, int], m: int) -> None:
        gap = capacity - sum(s * k for s, k in pattern.items())
        by_gap.setdefault(gap, []).append((pattern, m))
        open_gaps[gap] = True

    for s in range(capacity, 0, -1):
        c = int(avail[s])
        avail[s] = 0
        while c:
            fits = np.flatnonzero(open_gaps[s:])
            if not len(fits):
                k = capacity // s
                if c >= k:
                    put({s: k}, c // k)
                    c %= k
                else:
                    put({s: c}, 1)
                    c = 0
                continue
            gap = s + int(fits[0])
            pattern, m = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                open_gaps[gap] = False
            k = gap // s  # as many of this length as the gap holds
            full = min(m, c // k)
            if full:
                put(pattern | {s: pattern.get(s, 0) + k}, full)
                c -= full * k
                m -= full
            if m and c:
                put(pattern | {s: pattern.get(s, 0) + c}, 1)
                c, m = 0, m - 1
            if m:
                put(pattern, m)
    return [p for v in by_gap.values() for p in v]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths with their number, how many such containers), using every item once."""
    avail = np.zeros(capacity + 1, np.int64)
    for s, c in histogram.items():
        if s > 0:
            avail[s] = c
    return _exact_fill(avail, capacity) + _best_fit(avail, capacity)


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = 4096, bucket_rows: int = 200_000) -> DataFrame:
    """id, piece, pieces, size, container: one row per item, or per part of one longer than the capacity."""
    n = F.coalesce(F.col(size_col).cast("bigint"), F.lit(0))
    parts = F.greatest(F.lit(1), F.ceil(n / capacity)).cast("int")
    x = items.select(F.col(id_col), n.alias("_n"), parts.alias("pieces")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    x = cut(x.select(id_col, "piece", "pieces", F.least(F.lit(capacity), F.col("_n") - F.col("piece") * capacity).alias("size")))
    hist = {r["size"]: r["n"] for r in x.groupBy("size").agg(F.count("*").alias("n")).collect()}
    total = sum(hist.values())
    starts: list[tuple[int, int, int, int]] = []  # size, first rank, per container, first container
    used: dict[int, int] = {}
    box = 0
    for pattern, m in plan(hist, capacity):
        for s, k in pattern.items():
            starts.append((s, used.get(s, 0), k, box))
            used[s] = used.get(s, 0) + k * m
        box += m
    starts.sort()
    key = np.array([s << 44 | r for s, r, _, _ in starts], np.int64)
    rank0, per, first = (np.array([t[i] for t in starts], np.int64) for i in (1, 2, 3))

    buckets = max(8, -(-total // bucket_rows))
    x = x.withColumn("_b", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)))
    per_bucket = x.groupBy("size", "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offset = per_bucket.select("size", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("size", "_b").orderBy(id_col, "piece")
    x = x.withColumn("_r", F.row_number().over(inside) - 1).join(offset, ["size", "_b"])

    @F.pandas_udf("bigint")
    def place(size: pd.Series, rank: pd.Series) -> pd.Series:
        s, r = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        if not len(key):
            return pd.Series(np.zeros(len(s), np.int64))
        i = np.maximum(np.searchsorted(key, s << 44 | r, side="right") - 1, 0)
        return pd.Series(np.where(s > 0, first[i] + (r - rank0[i]) // per[i], 0))

    return x.select(id_col, "piece", "pieces", "size", place("size", F.col("_r") + F.col("_off")).alias("container"))


def pack_documents(docs: DataFrame, capacity: int = 4096, path: str | None = None) -> DataFrame:
    """doc_id, piece, pieces, size (tokens), container of each document."""
    return pack(encode_texts(docs, path=path, count_only=True), "doc_id", "n_tokens", capacity)
