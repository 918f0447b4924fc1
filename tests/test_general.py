import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratigraph.operators import incremental as inc
from stratigraph.operators import orphans as orph

T0 = datetime(2024, 1, 31, 23)


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


NODES = [("A", 0, None), ("b", 5, None), ("c", 0, 3), ("c", 6, None), ("c", 6, None), (None, 0, None), (" d ", 0, None), ("e", None, None), ("f", 2, 2)]
EDGES = [
    (1, "a", " A ", 0), (2, "B", "b", 4), (3, "b", "b", 5), (4, "c", "c", 2), (5, "c", "c", 3), (6, "c", "c", 6),
    (7, None, "  ", 0), (8, "gone", "d", 1), (9, "e", "f", 3), (10, "a", "a", None), (8, "gone", "d", 1),
]


def frames(spark):
    n = spark.createDataFrame([(i, at(r), at(d), "x") for i, r, d in NODES], "id string, recorded_at timestamp, deleted_at timestamp, key string")
    e = spark.createDataFrame([(i, f, t, at(r), "x") for i, f, t, r in EDGES], "edge_id int, from_id string, to_id string, recorded_at timestamp, key string")
    return n, e


def brute():
    out = set()
    for i, f, t, r in EDGES:
        for end, k in (("from", f), ("to", t)):
            k = (k or "").strip().lower()
            if k and not any((n or "").strip().lower() == k and b is not None and r is not None and b <= r and (d is None or d > r) for n, b, d in NODES):
                out.add((i, end))
    return out


@pytest.mark.parametrize("share", [0.005, 0.2, 0.9])
def test_orphans(spark, share):
    n, e = frames(spark)
    got = {(r.ref_id, r.endpoint) for r in orph.orphan_references(n, e, heavy_share=share).collect()}
    assert got == brute()
    rep = orph.orphan_report(n, e).agg(F.sum("orphans")).first()[0]
    assert rep == len(brute())


def test_orphans_empty(spark):
    n, e = frames(spark)
    assert orph.orphan_references(n, e.limit(0)).count() == 0
    assert orph.orphan_references(n.limit(0), e).select("ref_id", "endpoint").distinct().count() == sum(bool((k or "").strip()) for k in [x for r in {x[0]: x for x in EDGES}.values() for x in r[1:3]])


def test_pending(spark):
    ts = lambda h: at(h)
    files = spark.createDataFrame([("r", "a", "H1", ts(2), ts(2)), ("r", "a", "h0", ts(1), ts(9)), ("r", "b", None, ts(1), ts(1)), ("r", "c", "h3", ts(1), ts(1)), ("r", "new", "h", ts(1), ts(1))], "repo string, path string, content_hash string, mtime timestamp, ingested_at timestamp")
    chunks = spark.createDataFrame([(1, "C1"), (1, "C1"), (2, "c2")], "id long, chunk_hash string")
    log = spark.createDataFrame([(1, ts(0), ts(1), "SUCCESS"), (2, ts(0), ts(5), "success"), (3, ts(2), ts(3), "success"), (4, ts(6), None, "success"), (5, ts(6), ts(7), "failed")], "run_id int, started_at timestamp, finished_at timestamp, status string")
    man = spark.createDataFrame(
        [(2, "file", "r:a", "h1 "), (3, "file", "r:a", "old"), (2, "file", "r:c", "old"), (3, "file", "r:c", "h3"), (4, "file", "r:new", "h"), (5, "file", "r:new", "h"), (1, "chunk", "1", "c1"), (1, "chunk", "1", "c1"), (2, "chunk", "2", None), (2, "file", "r:dead", "x")],
        "run_id int, record_kind string, record_key string, seen_hash string",
    )
    got = {(r.record_kind, r.record_key) for r in inc.pending_records(files, chunks, man, log).collect()}
    assert got == {("file", "r:b"), ("file", "r:c"), ("file", "r:new"), ("chunk", "2")}
    assert inc.pending_records(files.limit(0), chunks.limit(0), man, log).count() == 0
    assert inc.pending_records(files, chunks, man.limit(0), log.limit(0)).count() == 6


def test_store_neither_skips_nor_repeats(spark, tmp_path):
    store = inc.IncrementalStore(spark, f"file://{tmp_path}/store")
    rows = lambda a, b: spark.createDataFrame([(i, f"v{i}") for i in range(a, b)], "seq long, v string")
    assert store.watermark() is None and store.read() is None
    assert store.run(rows(0, 0), "seq", lambda d: d) is None
    assert store.run(rows(0, 5), "seq", lambda d: d).count() == 5

    class Crash(Exception):
        pass

    def boom(*a):
        raise Crash

    keep, store._publish = store._publish, boom
    with pytest.raises(Crash):  # dies after its output was written and before the commit
        store.run(rows(0, 8), "seq", lambda d: d)
    store._publish = keep
    assert store.watermark() == 4 and store.read().count() == 5
    assert sorted(r.seq for r in store.run(rows(0, 9), "seq", lambda d: d).collect()) == [5, 6, 7, 8]
    assert store.run(rows(0, 9), "seq", lambda d: d) is None
    with pytest.raises(RuntimeError):  # a second run that started from the same state
        store._publish(2, "other", 99)
    assert store.watermark() == 8 and sorted(r.seq for r in store.read().collect()) == list(range(9))


def test_store_with_moments(spark, tmp_path):
    """A timestamp as the sequence: nothing is lost or repeated, and the watermark comes back as it was."""
    store = inc.IncrementalStore(spark, f"file://{tmp_path}/store2")
    rows = lambda a, b: spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, i), i) for i in range(a, b)], "seq timestamp, v int")
    assert store.run(rows(0, 3), "seq", lambda d: d).count() == 3
    assert store.watermark() == datetime(2024, 1, 1, 0, 0, 2)
    assert [r.v for r in store.run(rows(0, 5), "seq", lambda d: d).orderBy("v").collect()] == [3, 4]
    assert store.run(rows(0, 5), "seq", lambda d: d) is None and store.read().count() == 5


def test_report_equals_counting_one_by_one(spark):
    """Periods in which a key is born or goes, heavy keys, repeats and null moments."""
    rnd = random.Random(4)
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    nodes = [(f"k{i}", day(rnd.randint(0, 80)), rnd.choice([None, day(rnd.randint(20, 120))])) for i in range(30) for _ in range(rnd.randint(0, 2))]
    edges = [(i, rnd.choice(["k0", " K0", f"k{rnd.randint(0, 34)}", None]), rnd.choice(["", f"k{rnd.randint(0, 34)}"]), rnd.choice([None, *(day(rnd.randint(0, 120)) for _ in range(8))])) for i in range(400)]
    n = spark.createDataFrame(nodes, "id string, recorded_at timestamp, deleted_at timestamp")
    e = spark.createDataFrame(edges + edges[:40], "edge_id int, from_id string, to_id string, recorded_at timestamp")
    one = orph.orphan_references(n, e).distinct().groupBy("endpoint", F.date_trunc("month", "at").alias("period")).agg(F.count("*").alias("orphans"), F.count_distinct("key").alias("keys"))
    want = sorted(map(str, one.collect()))
    for share in (0.005, 0.2, 0.9):
        assert sorted(map(str, orph.orphan_report(n, e, heavy_share=share).collect())) == want
