"""Arriving files as a stream: each micro-batch is chunked and merged into the table of chunks.

The merge is idempotent: a batch replaces all chunks of the files it holds, under a folder named by the batch number, so a batch
repeated after a failure overwrites its own output and nothing else. Readers take, per file, the chunks of the latest batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratigraph.operators.outline import chunks


def ingest(files: DataFrame, out: str, checkpoint: str, limit: int = 1500) -> StreamingQuery:
    """Start the stream of files (repo, path, content, mtime); runs over what is there and ends."""

    def merge(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("repo", "path").agg(F.max_by("content", "mtime").alias("content"))
        c = chunks(last, limit)
        empty = last.select("repo", "path").join(c.select("repo", "path").distinct(), ["repo", "path"], "left_anti")
        c.unionByName(empty, allowMissingColumns=True).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of the latest batch of every file."""
    c = spark.read.parquet(out)
    newest = c.groupBy("repo", "path").agg(F.max("batch").alias("batch"))
    return c.join(newest, ["repo", "path", "batch"], "left_semi").where("id is not null")
