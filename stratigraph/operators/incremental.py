"""Processing only new or changed records, with a watermark on a monotonic commit sequence.

``commits`` turns the run log into a commit sequence: successful, finished runs numbered by the moment they
finished. A run reads the log once at its start and fixes the upper limit there (``upper_limit``): commits that
appear while it runs belong to the next run. ``seen_state`` is what the commits up to that limit saw of each record
(the latest commit that lists a record wins); ``pending`` is every present record whose state differs from it.

``IncrementalStore`` keeps output and watermark together: a commit writes the output under a new version folder and
then publishes one small commit file, created exclusively and naming both the folder and the watermark; ``process_pending``
is such a run over files and chunks. A run that dies
before that leaves nothing visible, so no record is skipped; a run repeated after it finds the new watermark, so
none is processed twice.

Cases: status letter case and blanks carry no meaning; a run without finished_at is no commit; hashes compare
without letter case and outer blanks; a record with a null hash is always pending; a null seen_hash never matches;
repeated rows count once; records that are gone are not pending; if one commit lists a record with several hashes, the
greatest counts; commits with one finish time are ordered by run_id.
"""

from __future__ import annotations

import datetime
import decimal
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def norm_hash(c: Column) -> Column:
    """Hash without letter case and outer blanks; null when blank."""
    h = F.lower(F.trim(c))
    return F.when(h != "", h)


def commits(run_log: DataFrame, finished_before=None) -> DataFrame:
    """run_id, seq: the successful finished runs in commit order. The log grows slowly (a row per run)."""
    ok = run_log.where((F.lower(F.trim("status")) == "success") & F.col("finished_at").isNotNull())
    if finished_before is not None:
        ok = ok.where(F.col("finished_at") <= F.lit(finished_before))
    one = ok.groupBy("run_id").agg(F.max("finished_at").alias("finished_at"))
    # numbering needs no partition key: one row per run, and only run_id and a time travel
    return one.select("run_id", F.struct("finished_at", "run_id").alias("seq"))


def upper_limit(run_log: DataFrame):
    """The sequence number (finished_at) of the last commit, read once at the start of a run; None without commits."""
    return commits(run_log).agg(F.max("seq.finished_at")).first()[0]


def current_files(files: DataFrame) -> DataFrame:
    """record_kind, record_key, hash of the current version (greatest mtime) of each file."""
    cur = files.where("repo is not null and path is not null").groupBy("repo", "path").agg(F.max_by("content_hash", F.struct(F.coalesce("mtime", F.lit("0001-01-01").cast("timestamp")), "ingested_at")).alias("h"))
    return cur.select(F.lit("file").alias("record_kind"), F.concat("repo", F.lit(":"), "path").alias("record_key"), norm_hash(F.col("h")).alias("hash"))


def current_chunks(chunks: DataFrame) -> DataFrame:
    """record_kind, record_key, hash of each chunk; a chunk listed with several hashes has a null one."""
    cur = chunks.where("id is not null").groupBy("id").agg(F.max(norm_hash(F.col("chunk_hash"))).alias("hi"), F.min(norm_hash(F.col("chunk_hash"))).alias("lo"))
    return cur.select(F.lit("chunk").alias("record_kind"), F.col("id").cast("string").alias("record_key"), F.when(F.col("hi") == F.col("lo"), F.col("hi")).alias("hash"))


def seen_state(run_manifest: DataFrame, run_log: DataFrame, limit=None) -> DataFrame:
    """record_kind, record_key, seen: the hash in the latest commit that lists the record."""
    c = commits(run_log, limit)
    m = run_manifest.select("run_id", F.lower(F.trim("record_kind")).alias("record_kind"), "record_key", norm_hash(F.col("seen_hash")).alias("h"))
    joined = m.join(c, "run_id")
    last = joined.groupBy("record_kind", "record_key").agg(F.max(F.struct("seq", F.coalesce("h", F.lit("")).alias("h"))).alias("a"))
    return last.select("record_kind", "record_key", F.when(F.col("a.h") != "", F.col("a.h")).alias("seen"))


def pending(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Records of ``current`` that the next run has to process: record_kind, record_key, hash; each once."""
    return (
        current.join(seen, ["record_kind", "record_key"], "left")
        .where(F.col("hash").isNull() | F.col("seen").isNull() | (F.col("hash") != F.col("seen")))
        .select("record_kind", "record_key", "hash")
    )


def pending_records(files: DataFrame, chunks: DataFrame, run_manifest: DataFrame, run_log: DataFrame) -> DataFrame:
    """All files and chunks to process, judged by the commits up to the limit fixed now."""
    limit = upper_limit(run_log)
    return pending(current_files(files).unionByName(current_chunks(chunks)), seen_state(run_manifest, run_log, limit))


def process_pending(files: DataFrame, chunks: DataFrame, run_manifest: DataFrame, run_log: DataFrame, root: str) -> DataFrame:
    """One run over all pending files and chunks, committed to the store under ``root``; what it has processed.

    The watermark is the sequence number up to which commits were read when the run began.
    """
    limit = upper_limit(run_log)
    work = pending(current_files(files).unionByName(current_chunks(chunks)), seen_state(run_manifest, run_log, limit))
    return IncrementalStore(files.sparkSession, root).commit(work, limit)


_KINDS = {"datetime": datetime.datetime, "date": datetime.date}


def _pack(x):
    """A watermark for JSON: numbers and texts as they are, moments with their kind."""
    for name, kind in _KINDS.items():
        if type(x) is kind:
            return {name: x.isoformat()}
    return {"decimal": str(x)} if isinstance(x, decimal.Decimal) else x


def _unpack(x):
    if not isinstance(x, dict):
        return x
    (name, text), = x.items()
    return decimal.Decimal(text) if name == "decimal" else _KINDS[name].fromisoformat(text)


class IncrementalStore:
    """Versioned output whose data and watermark become visible together.

    Layout under ``root`` (a folder all executors share): ``data/version=<version>/`` holds Parquet, ``commits/<seq>.json``
    one commit each. The commit file is created exclusively: of two runs that race for one sequence number one fails
    and publishes nothing. This needs a file system on which creating a file that exists fails, as on HDFS and local disks;
    object stores need one with conditional writes. A run that dies earlier leaves a version that no commit names.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[dict]:
        """All commits, by one read of the folder; a row per run."""
        if not self._fs.exists(self._path(f"{self.root}/commits")):
            return []
        rows = self.spark.read.option("pathGlobFilter", "*.json").text(f"{self.root}/commits", wholetext=True).collect()
        out = [json.loads(r[0]) for r in rows if r[0].strip()]
        return sorted([c | {"watermark": _unpack(c["watermark"])} for c in out], key=lambda c: c["seq"])

    def watermark(self):
        """Upper limit of the last commit; None before the first."""
        c = self._commits()
        return c[-1]["watermark"] if c else None

    def run(self, source: DataFrame, seq_col: str, transform) -> DataFrame | None:
        """Process the rows with watermark < seq_col <= limit, the limit being fixed now; None if there are none."""
        done = self._commits()
        low = done[-1]["watermark"] if done else None
        high = source.agg(F.max(seq_col)).first()[0]
        if high is None or (low is not None and high <= low):
            return None
        part = source.where(F.col(seq_col) <= F.lit(high))
        if low is not None:
            part = part.where(F.col(seq_col) > F.lit(low))
        return self.commit(transform(part), high, len(done) + 1)

    def commit(self, output: DataFrame, watermark, seq: int | None = None) -> DataFrame:
        """Write an output and publish it with its watermark; the output as it was written."""
        seq = seq or len(self._commits()) + 1
        version = "v" + uuid.uuid4().hex
        at = f"{self.root}/data/version={version}"
        output.write.parquet(at)
        self._publish(seq, version, watermark)
        return self.spark.read.schema(output.schema).parquet(at)

    def _publish(self, seq: int, version: str, high) -> None:
        final = self._path(f"{self.root}/commits/{seq:012d}.json")
        try:
            out = self._fs.create(final, False)
        except Exception as e:  # whoever creates the file first has the number
            raise RuntimeError(f"commit {seq} was taken by another run; nothing was published") from e
        out.write(bytearray(json.dumps({"seq": seq, "version": version, "watermark": _pack(high)}).encode()))
        out.close()

    def read(self) -> DataFrame | None:
        """All committed output: one scan of the folder, of which only committed versions count."""
        c = self._commits()
        if not c:
            return None
        good = self.spark.createDataFrame([(x["version"],) for x in c], "version string")
        return self.spark.read.parquet(f"{self.root}/data").join(F.broadcast(good), "version", "left_semi").drop("version")
