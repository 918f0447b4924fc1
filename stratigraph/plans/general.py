"""Queries of the general training-data problems (5 and 6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratigraph.operators import incremental, orphans
from stratigraph.session import shared_folder, table


def p5_found(spark, d):
    o = orphans.orphan_references(table(spark, d, "nodes"), table(spark, d, "edges"))
    return o.select(F.col("ref_id").alias("edge_id"), "endpoint").distinct()


def p5_report(spark, d):
    o = orphans.orphan_report(table(spark, d, "nodes"), table(spark, d, "edges"))
    return o.select(F.lit("edges").alias("table_name"), "endpoint", F.date_format("period", "yyyy-MM").alias("period"), "orphans", "keys")


def p6_found(spark, d):
    # a committed run into a store of its own
    root = f"{shared_folder(spark)}/p6-{uuid.uuid4().hex}"
    p = incremental.process_pending(table(spark, d, "files"), table(spark, d, "chunks"), table(spark, d, "run_manifest"), table(spark, d, "run_log"), root)
    return p.select("record_kind", "record_key")


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found}

_ORPHANS = """
refs AS (
  SELECT DISTINCT edge_id, 'from' AS endpoint, lower(regexp_replace(from_id, '^\\s+|\\s+$', '', 'g')) AS key, recorded_at AS refs_at FROM edges
  UNION
  SELECT DISTINCT edge_id, 'to', lower(regexp_replace(to_id, '^\\s+|\\s+$', '', 'g')), recorded_at FROM edges),
lives AS (SELECT DISTINCT lower(regexp_replace(id, '^\\s+|\\s+$', '', 'g')) AS key, recorded_at AS born, deleted_at AS gone FROM nodes),
orphans AS (
  SELECT r.* FROM refs r WHERE r.key IS NOT NULL AND r.key <> '' AND NOT EXISTS (
    SELECT 1 FROM lives l WHERE l.key = r.key AND l.born <= r.refs_at AND (l.gone IS NULL OR l.gone > r.refs_at)))
"""

SQL = {
    "p5_found": f"WITH {_ORPHANS} SELECT DISTINCT edge_id, endpoint FROM orphans",
    "p5_report": f"WITH {_ORPHANS} SELECT 'edges' AS table_name, endpoint, strftime(date_trunc('month', refs_at), '%Y-%m') AS period, count(*) AS orphans, count(DISTINCT key) AS keys FROM orphans GROUP BY 1, 2, 3",
    "p6_found": """
WITH ok AS (SELECT run_id, max(finished_at) AS fin FROM run_log WHERE lower(trim(status)) = 'success' AND finished_at IS NOT NULL GROUP BY run_id),
m AS (SELECT lower(trim(record_kind)) AS record_kind, record_key, lower(trim(seen_hash)) AS h, fin, run_id FROM run_manifest JOIN ok USING (run_id)),
seen AS (SELECT record_kind, record_key, h FROM (
  SELECT *, row_number() OVER (PARTITION BY record_kind, record_key ORDER BY fin DESC, run_id DESC, h DESC NULLS LAST) AS rn FROM m) WHERE rn = 1),
cur AS (
  SELECT 'file' AS record_kind, repo || ':' || path AS record_key, lower(trim(content_hash)) AS h FROM (
    SELECT repo, path, content_hash, row_number() OVER (PARTITION BY repo, path ORDER BY mtime DESC NULLS LAST, ingested_at DESC) AS rn FROM files) WHERE rn = 1
  UNION ALL
  SELECT 'chunk', CAST(id AS VARCHAR), CASE WHEN min(lower(trim(chunk_hash))) = max(lower(trim(chunk_hash))) THEN min(lower(trim(chunk_hash))) END FROM chunks WHERE id IS NOT NULL GROUP BY id)
SELECT cur.record_kind, cur.record_key FROM cur LEFT JOIN seen USING (record_kind, record_key)
WHERE cur.h IS NULL OR seen.h IS NULL OR cur.h <> seen.h
""",
}
