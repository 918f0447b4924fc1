"""Queries of the row generators. SQL cannot parse source files: the tests hold these against fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratigraph.operators import outline as O
from stratigraph.plans.reference import current_files


def _outline(*exts):
    def run(s, d):
        f = current_files(s, d, "content").where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*exts))
        return O.declarations(f)

    return run


def gen1_chunks(s, d):
    return O.chunks(current_files(s, d, "content").where("not endswith(path, '.md')")).select("id", "repo", "path", "start_line", "end_line", "content")


def gen2_markdown_chunks(s, d):
    return O.chunks(current_files(s, d, "content").where("endswith(path, '.md')")).select("id", "repo", "path", "start_line", "end_line", "content")


QUERIES = {
    "gen1_chunker": gen1_chunks, "gen2_markdown_chunker": gen2_markdown_chunks, "gen3_python_outline": _outline("py"), "gen4_go_outline": _outline("go"), "gen5_ts_outline": _outline("ts", "js"), "gen6_rust_outline": _outline("rs"), "gen7_java_outline": _outline("java"),
}
SQL: dict[str, str] = {}
