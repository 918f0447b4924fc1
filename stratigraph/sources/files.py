"""Sources and sinks: a folder of repositories as a table of files, JSON rows, atomic tables."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratigraph.functions import text as X


def ignore_regex(lines: list[str]) -> list[tuple[str, bool]]:
    """(regular expression, ignored) of the rules of an ignore file; the last one that matches decides."""
    out = []
    for line in lines:
        p = line.rstrip()
        if not p or p.startswith("#"):
            continue
        keep = p.startswith("!")
        p = p[1:] if keep else p
        folder, anchored = p.endswith("/"), "/" in p.rstrip("/")
        body = fnmatch.translate(p.strip("/").replace("**/", "\0")).removesuffix(r"\Z").removesuffix(r"\z").replace("\0", "(?:.*/)?").replace(".*", "[^/]*") if "**" not in p else fnmatch.translate(p.strip("/"))[:-2]
        body = re.sub(r"^\(\?s:(.*)\)$", r"\1", body)
        out.append((("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if folder else "(?:/.*)?$"), not keep))
    return out


def walk(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """repo, path, content, size, mtime of the files below ``root/<repo>/``; ignored and never-indexed ones left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split(":", 1)[-1].rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^.*?" + re.escape(base) + "/", "")
    f = raw.select(F.regexp_extract(rel, "^([^/]+)/", 1).alias("repo"), F.regexp_replace(rel, "^[^/]+/", "").alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    verdict = F.lit(False)
    for rx, drop in ignore_regex(ignore or []):
        verdict = F.when(F.col("path").rlike(rx), F.lit(drop)).otherwise(verdict)
    return f.where(~verdict & ~X.denied(F.col("path")))


def json_rows(df: DataFrame, version: int = 1) -> DataFrame:
    """Each row as a JSON text in an envelope with the schema version."""
    return df.select(F.to_json(F.struct(F.lit(version).alias("schema_version"), F.struct(*df.columns).alias("row"))).alias("json"))
