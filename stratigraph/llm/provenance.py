"""Files that nobody of the repository wrote by hand: generated, minified, third-party copies, data saved as code.

What decides, in this order:

* declared: the repository's attribute files mark the path as generated or vendored. Within a file the last match wins,
  and a file in a deeper directory wins over one above it; ``-attr`` declares the contrary, ``!attr`` takes back what was
  said before. A path that is declared to be neither is not a case.
* pattern: in repositories without attribute files, equivalent patterns: those that public attribute files have in common
  (``EQUIVALENT``), and those mined here. An ending of file names, a directory or both together become a pattern where
  nearly all files that match it, in several repositories, are declared so or carry evidence of their contents.
* evidence, which seeds the patterns and decides on its own where none matches. Generated: a comment before the first
  code says that a tool made the file (several languages), or the code consists of trivial accessors. Minified: code
  without its strings and comments has long lines, hardly any white space and short names. Data: nearly all of the
  code is literals, with a handful of words around them.
* copied: the five-word shingles of the code, without comments, overlap those of a file under a vendored pattern by
  ``overlap`` (of the smaller) and ``similarity`` (Jaccard). One plan at any size: the vendored texts are cut into blocks of a
  bounded number of shingles, each sent to the scans once; counts are exact. A table with more vendored code takes more scans.

Cases: null contents are judged by path only; empty contents have no content evidence; repeated rows and old versions do
not count; equal texts are examined once; a missing attribute file declares nothing; a pattern that ends in a slash
matches nothing, as in attribute files; empty input, empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratigraph.llm.bpe import spread
from stratigraph.llm.syntax import current_files
from stratigraph.session import cut

# What public attribute files declare about directories meant for code of others, and what tools write at the top of
# their output.
EQUIVALENT = """
**/vendor/** linguist-vendored
**/third_party/** linguist-vendored
**/third-party/** linguist-vendored
**/thirdparty/** linguist-vendored
**/external/** linguist-vendored
**/extern/** linguist-vendored
**/deps/** linguist-vendored
**/node_modules/** linguist-vendored
**/bower_components/** linguist-vendored
**/Godeps/** linguist-vendored
**/contrib/[A-Za-z]*-[0-9]*.[0-9]*/** linguist-vendored
**/contrib/[A-Za-z]*-v[0-9]*.[0-9]*/** linguist-vendored
"""
MADE_BY_TOOL = re.compile(
    r"code generated by \S+.*do not (edit|modify)|<auto-?generated|@generated\b|auto-?generated file|(automatically|auto-?) ?generated by \S+"
    r"|this (file|code|module|source) (is|was|has been) (auto|machine|automatically|programmatically)|machine generated|generated (on|from|by) .*(do not (edit|modify)|build \d|\.(proto|thrift|idl|g4|y|xsd|wsdl)\b)"
    r"|^\W*generated (on|from|by) \S+|output of \W?[\w.-]+.*(regenerate|do not edit|instead of editing)|regenerate instead|changes will be (lost|overwritten)"
    r"|automatisch (erzeugt|generiert|erstellt)|maschinell erzeugt|(produit|généré|generé) (par|automatiquement)|fichier (généré|produit)|(generado|creado) automáticamente|generato automaticamente"
    r"|gerado automaticamente|automatisch gegenereerd|wygenerowan\w+ automatycznie|automatycznie wygenerowan|сгенерирован\w* автоматически|автоматически (создан|сгенерирован)|自动生成|請勿編輯|请勿编辑",
    re.I | re.M,
)
_STUB = re.compile(r"method stub|generated stubs", re.I)
_STRINGS = re.compile(r"'''[\s\S]*?'''|\"\"\"[\s\S]*?\"\"\"|`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_COMMENTS = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|^\s*#(?![!\[])[^\n]*", re.M)
_CODE_PARTS = re.compile(rf"(?P<s>{_STRINGS.pattern})|(?P<c>//[^\n]*|/\*[\s\S]*?\*/|(?<![^\n\s])#(?![!\[])[^\n]*)")
_TOP = re.compile(r"\A(?:\s*(?://[^\n]*|/\*[\s\S]*?\*/|#(?![!\[])[^\n]*|#![^\n]*|<!--[\s\S]*?-->))+")
_ACCESSOR = re.compile(r"^\s*return (?:self|this|m|[a-z])\.\w+(?:\[\d+\])?;?\s*$|^\s*(?:self|this)\.\w+ = \w+;?\s*$|\{\s*(?:return )?[\w.]+(?:\[\d+\])?;?\s*\}|\{\s*[\w.]+(?:\[\d+\])?\s*=\s*\w+;\s*\}", re.M)
_NUMBER = re.compile(r"-?\b\d[\w.]*")
_NAME = re.compile(r"(?<![\w$])[A-Za-z_$][\w$]*")
_LONG_LINE = re.compile(r"[^\n]{500}")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_HASHES: dict[str, int] = {}
SHINGLE = 5


def split_code(text: str) -> tuple[str, list[str]]:
    """Code with each string as one mark and without comments, and the strings."""
    strings: list[str] = []

    def take(m: re.Match) -> str:
        if m.lastgroup == "s":
            strings.append(m[0])
            return '"S"'
        return " "

    return _CODE_PARTS.sub(take, text), strings


def content_evidence(text: str | None, ext: str = "") -> str:
    """generated, minified, data or nothing, by the text alone."""
    if not text or ext == "md":
        return ""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    top = _TOP.match(text)
    if top:
        for line in top[0].split("\n"):
            if MADE_BY_TOOL.search(line) and not _STUB.search(line):
                return "generated"
    acc = len(_ACCESSOR.findall(text))
    blank = sum(map(text.count, " \n\t")) / len(text)
    digits = sum(map(text.count, "0123456789")) / len(text)
    quotes = text.count('"') + text.count("'")
    if acc < 6 and blank > 0.14 and digits < 0.1 and quotes < 0.04 * len(text) and not _LONG_LINE.search(text):
        return ""  # neither dense nor full of numbers, strings or accessors
    code, strings = split_code(text)
    lines = [x.strip() for x in code.split("\n") if x.strip()]
    if not lines:
        return ""
    names = _NAME.findall(code)
    names = [x for x in names if x != "S"]
    dense = sum(map(len, lines))
    blank = sum(c.isspace() for c in code) / max(1, len(code))
    longest = max(map(len, lines))
    short = sum(len(x) <= 3 for x in names) / max(1, len(names))
    if len(names) >= 20 and dense / len(lines) >= 110 and longest >= 160 and blank < 0.1 and short > 0.5:
        return "minified"
    numbers = len(_NUMBER.findall(code))
    # what reads as prose or as a template is no data
    solid = sum(len(s) for s in strings if s.count(" ") + s.count("\n") * 4 < 0.06 * len(s) or s.count(" ") < 2)
    literal = solid + sum(len(x) for x in _NUMBER.findall(code))
    words = set(names)
    if len(words) <= 14 and (numbers + len(strings) >= 24 or literal >= 250) and literal >= 0.5 * (len(re.sub(r"\s", "", code)) + solid - 3 * len(strings) - len(names) * 4):
        return "data"
    acc = len(_ACCESSOR.findall(code))
    if acc >= 6 and acc / len(lines) >= 0.25:
        return "generated"
    return ""


def shingles(text: str) -> np.ndarray:
    """Distinct 60-bit hashes of the five-word shingles of the code without comments."""
    code = _COMMENTS.sub(" ", text)
    toks = _TOKEN.findall(code)
    for t in set(toks).difference(_HASHES):
        if len(_HASHES) > 200_000:
            _HASHES.clear()
            return shingles(text)
        _HASHES[t] = zlib.crc32(t.encode())
    w = np.fromiter(map(_HASHES.__getitem__, toks), np.uint64, len(toks))
    if len(w) < SHINGLE:
        return np.zeros(0, np.int64)
    h = np.zeros(len(w) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (w[i : i + len(h)] + np.uint64(0x632BE59BD9B4E019))
        h ^= h >> np.uint64(31)
    return np.unique(h >> np.uint64(4)).astype(np.int64)


# ---- attribute files


def parse_attributes(text: str | None) -> list[tuple[str, str, bool | None]]:
    """(pattern, generated or vendored, set, unset or None for taken back) of the lines that speak of the two."""
    out = []
    for line in (text or "").splitlines():
        parts = line.split()
        if len(parts) < 2 or parts[0].startswith("#"):
            continue
        for a in parts[1:]:
            m = re.fullmatch(r"([-!]?)linguist-(generated|vendored)(?:=(\w+))?", a)
            if m:
                out.append((parts[0], m[2], None if m[1] == "!" else not m[1] and (m[3] or "true").lower() not in ("false", "0", "no")))
    return out


def glob_regex(pattern: str) -> str:
    """Regular expression, for paths relative to the attribute file's directory, of one pattern."""
    if pattern.endswith("/"):
        return r"(?!)"  # a directory has no attributes of its own
    anchored = "/" in pattern
    p = pattern.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i:]:
            j = p.index("]", i + 1)
            body = p[i + 1 : j]
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("" if anchored else "(?:.*/)?") + out


def decide_declared(path: str, files: list[tuple[str, str]]) -> str | None:
    """'generated', 'vendored', 'none' (declared not to be) or None, by (directory, text) of the attribute files above."""
    state: dict[str, bool] = {}
    for d, text in sorted(files, key=lambda x: x[0].count("/")):
        rel = path[len(d) :]
        for pattern, what, on in parse_attributes(text):
            if re.fullmatch(glob_regex(pattern), rel):
                if on is None:
                    state.pop(what, None)
                else:
                    state[what] = on
    if any(state.values()):
        return next(k for k, v in state.items() if v)
    return "none" if state else None


def equivalent(path, what: str = "vendored"):
    """Whether a pattern of ``EQUIVALENT`` marks a path, as a column expression."""
    return path.rlike("^(?:" + "|".join(glob_regex(p) for p, w, on in parse_attributes(EQUIVALENT) if w == what and on) + ")$")


def declared(cur: DataFrame) -> DataFrame:
    """repo, path, declared: joins every path of a repository with attribute files to those in the directories above it."""
    attrs = cur.where(F.col("path").rlike(r"(^|/)\.gitattributes$") & F.col("content").isNotNull()).select("repo", F.regexp_replace("path", r"[^/]*$", "").alias("dir"), F.col("content").alias("attr"))
    own = cur.select("repo", "path").join(attrs.select("repo").distinct(), "repo", "left_semi")
    part = F.split(F.regexp_replace("path", r"[^/]*$", ""), "/")
    ups = own.withColumn("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(part) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(part, 1, i), "/"), F.lit("/"))))))
    # as many rows a path as it has attribute files above it, i.e. at most its depth
    hit = ups.join(attrs, ["repo", "dir"]).groupBy("repo", "path").agg(F.collect_list(F.struct("dir", "attr")).alias("a"))

    @F.pandas_udf("string")
    def judge(path: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([decide_declared(p, [(x["dir"], x["attr"]) for x in xs]) for p, xs in zip(path, a)])

    return hit.select("repo", "path", judge("path", "a").alias("declared")).where("declared is not null")


# ---- copies


class Known:
    """Vendored texts by their shingles, of a size checked before it is shipped; tells which texts are copies."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(x) for x in sets], np.int64)
        h = np.concatenate([np.asarray(x, np.int64) for x in sets]) if sets else np.zeros(0, np.int64)
        own = np.repeat(np.arange(len(sets), dtype=np.int32), self.n)
        o = np.argsort(h, kind="stable")
        self.text = own[o]
        self.h, self.start = np.unique(h[o], return_index=True)
        self.end = np.r_[self.start[1:], len(h)] if len(h) else self.start

    def copied(self, text: str, overlap: float, similarity: float) -> bool:
        """Whether some vendored text overlaps this one enough: exact counts, by the lists of its shingles."""
        s = shingles(text)
        if not len(s) or not len(self.h):
            return False
        i = np.minimum(np.searchsorted(self.h, s), len(self.h) - 1)
        i = i[self.h[i] == s]
        if len(i) < similarity * len(s):
            return False  # all of them together are too few for any one
        a, k = self.start[i], self.end[i] - self.start[i]
        at = np.repeat(a - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())
        both = np.bincount(self.text[at], minlength=len(self.n))
        return bool(((both >= overlap * np.minimum(self.n, len(s))) & (both >= similarity * (self.n + len(s) - both))).any())


def vendored_shingles(texts: DataFrame) -> DataFrame:
    """k1, k2, n, hs: the shingles of each distinct text. ``texts``: k1, k2, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hs = [shingles(t).tolist() for t in b["content"]]
            yield pd.DataFrame({"k1": b["k1"], "k2": b["k2"], "n": [len(h) for h in hs], "hs": hs})

    return texts.mapInPandas(run, "k1 bigint, k2 bigint, n int, hs array<bigint>").where("n > 0").dropDuplicates(["k1", "k2"])


def blocks_of(v: DataFrame, most: int) -> tuple[DataFrame, int]:
    """``v`` with the block of each text, and how many blocks: by hash, about ``most`` shingles in each."""
    n = max(1, -(-(v.agg(F.sum("n")).first()[0] or 0) // most))
    return v.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "k1", "k2"), F.lit(n)).cast("int")), n


def known_block(v: DataFrame, block: int) -> Known:
    """The vendored texts of one block as arrays: the size of a block, whatever the size of the table."""
    return Known(list(v.where(F.col("block") == block).select("hs").toPandas()["hs"]))


def copied_in_blocks(texts: DataFrame, v: DataFrame, first: int, n: int, overlap: float, similarity: float) -> DataFrame:
    """k1, k2 of texts (k1, k2, content) that are copies of a vendored text of the blocks from ``first`` on: a scan a block."""
    out = texts.sparkSession.createDataFrame([], "k1 bigint, k2 bigint")
    for block in range(first, n):
        box = texts.sparkSession.sparkContext.broadcast(known_block(v, block))

        def run(batches: Iterator[pd.DataFrame], box=box) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.loc[[box.value.copied(t, overlap, similarity) for t in b["content"]], ["k1", "k2"]]

        out = out.unionByName(cut(spread(texts).mapInPandas(run, "k1 bigint, k2 bigint").distinct()))
    return out.distinct()


def copies(texts: DataFrame, overlap: float = 0.8, similarity: float = 0.5, block: int = 4_000_000) -> DataFrame:
    """k1, k2 of texts that are copies of a vendored text. ``texts``: k1, k2, content, origin."""
    v, n = blocks_of(cut(vendored_shingles(texts.where("origin").select("k1", "k2", "content"))), block)
    return copied_in_blocks(texts.where("not origin").select("k1", "k2", "content"), v, 0, n, overlap, similarity)


# ---- mined patterns


def path_patterns(path):
    """Endings of the file name, names of directories, and the last directory with each ending, as attribute patterns."""
    base = F.regexp_extract(path, r"[^/]*$", 0)
    ends = F.filter(F.array(*[F.regexp_extract(base, e, 1) for e in (r"[0-9A-Za-z]([_.-][A-Za-z]+[0-9]?\.[A-Za-z]+)$", r"[0-9A-Za-z]([_.-][A-Za-z]+[0-9]?_[A-Za-z]+\.[A-Za-z]+)$", r"[a-z0-9]([A-Z][a-z]+\.[A-Za-z]+)$")]), lambda e: e != "")
    dirs = F.filter(F.split(F.regexp_replace(path, r"[^/]*$", ""), "/"), lambda s: s != "")
    last = F.slice(F.reverse(dirs), 1, 1)
    both = F.flatten(F.transform(last, lambda d: F.transform(ends, lambda e: F.concat(F.lit("**/"), d, F.lit("/*"), e))))
    return F.array_distinct(F.concat(F.transform(ends, lambda e: F.concat(F.lit("*"), e)), F.transform(dirs, lambda d: F.concat(F.lit("**/"), d, F.lit("/**"))), both))


def mined_patterns(judged: DataFrame, precision: float = 0.98, support: int = 20, repos: int = 3) -> DataFrame:
    """pattern, files, share: patterns whose files are declared or carry evidence nearly always.

    ``judged``: repo, path, declared, reason. What is declared counts before what the contents look like: a path declared
    to be neither generated nor vendored counts against its patterns.
    """
    hit = F.when(F.col("declared").isNotNull(), F.col("declared") != "none").otherwise(F.col("reason") != "")
    e = judged.select("repo", hit.cast("int").alias("hit"), F.explode(path_patterns(F.col("path"))).alias("pattern"))
    per = e.groupBy("pattern", "repo").agg(F.count("*").alias("n"), F.sum("hit").alias("m"))
    g = per.groupBy("pattern").agg(F.sum("n").alias("files"), F.sum("m").alias("hits"), F.count("*").alias("repos"))
    return g.where((F.col("files") >= support) & (F.col("repos") >= repos) & (F.col("hits") >= precision * F.col("files"))).select("pattern", "files", (F.col("hits") / F.col("files")).alias("share"))


def provenance(files: DataFrame, overlap: float = 0.8, similarity: float = 0.5, block: int = 4_000_000) -> DataFrame:
    """repo, path, reason (empty for hand-written source), evidence, pattern of every current file.

    ``reason``: declared generated, declared vendored, pattern, generated, minified, data, copied; the pattern that decides
    and what the contents say stand beside it. Contents are looked at where they are read and never shuffled: a first pass
    takes the shingles of vendored texts, a second one gives each row its evidence and compares it with the first ``block``
    of those, further ones with further blocks; only short rows move on.
    """
    old = F.lit("0001-01-01").cast("timestamp")
    rows = files.where("repo is not null and path is not null").select(
        "repo", "path", F.struct(F.coalesce("mtime", old).alias("m"), F.coalesce("ingested_at", old).alias("g"), F.coalesce(F.xxhash64("content"), F.lit(0)).alias("k")).alias("at"),
        F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), equivalent(F.col("path")).alias("vendored"),
        F.xxhash64("content").alias("k1"), F.xxhash64(F.lit(5), "content").alias("k2"), "content",
    )
    v = cut(vendored_shingles(rows.where("vendored and content is not null and ext != 'md'").select("k1", "k2", "content")))
    v, n = blocks_of(v, block)
    box = files.sparkSession.sparkContext.broadcast(known_block(v, 0))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = box.value
        memo: dict[tuple, tuple] = {}
        for b in batches:
            out = []
            for k1, k2, ext, own, t in zip(b["k1"], b["k2"], b["ext"], b["vendored"], b["content"]):
                if t is None or t == "" or ext == "md" or own:
                    out.append(("", False))
                    continue
                key = (k1, k2, ext)
                if key not in memo:
                    if len(memo) > 20_000:
                        memo.clear()
                    ev = content_evidence(t, ext)
                    memo[key] = (ev, not ev and known.copied(t, overlap, similarity))
                out.append(memo[key])
            b = b.drop(columns=["content"])
            b["ev"], b["copied"] = ([o[i] for o in out] for i in range(2))
            yield b

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in rows.columns if c != "content") + ", ev string, copied boolean"
    seen = spread(rows).mapInPandas(look, schema)
    # the current version of each file, in short rows
    names = ["ext", "vendored", "k1", "k2", "ev", "copied"]
    cur = cut(seen.groupBy("repo", "path").agg(F.max_by(F.struct(*names), "at").alias("c")).select("repo", "path", *[F.col(f"c.{c}").alias(c) for c in names]))
    other = rows.where("not vendored and content is not null and ext != 'md'").select("k1", "k2", "content")
    same = copied_in_blocks(other, v, 1, n, overlap, similarity).unionByName(v.select("k1", "k2")).distinct().withColumn("same", F.lit(True))
    attr_files = cut(current_files(files.where(F.col("path").rlike(r"(^|/)\.gitattributes$"))).select("repo", "path", "content"))
    said = declared(cur.select("repo", "path").join(attr_files, ["repo", "path"], "left"))
    slim = cur.join(same, ["k1", "k2"], "left").join(said, ["repo", "path"], "left")
    plain = F.col("ext") == "md"
    found = F.when(F.col("vendored"), "vendored").when(plain, "").when(F.col("ev") != "", F.col("ev")).when(F.col("copied") | F.col("same"), "copied").otherwise("")
    judged = cut(slim.select("repo", "path", "ext", "declared", found.alias("reason")))
    # patterns: a few, each backed by many files, looked up by name in the repositories that declare nothing
    pats = mined_patterns(judged.where(~plain))
    free = judged.where(F.col("declared").isNull() & ~plain).join(attr_files.select("repo").distinct(), "repo", "left_anti").select("repo", "path", F.explode(path_patterns(F.col("path"))).alias("pattern"))
    by_pattern = free.join(pats, "pattern").groupBy("repo", "path").agg(F.min("pattern").alias("mined"))
    by_rule = F.when(F.col("reason") == "vendored", F.coalesce("mined", F.lit("equivalent"))).otherwise(F.col("mined"))
    reason = F.when(F.col("declared") == "none", "").when(F.col("declared").isNotNull(), F.concat(F.lit("declared "), "declared")).when(F.col("pattern").isNotNull(), "pattern").otherwise(F.col("reason"))
    return judged.join(by_pattern, ["repo", "path"], "left").withColumn("pattern", by_rule).select("repo", "path", reason.alias("reason"), F.col("reason").alias("evidence"), "pattern")
