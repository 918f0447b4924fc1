"""Functions and methods paired with their documentation.

The description of a declaration is its ``docs``; where those are null, the comment directly above it in the current
version of its file (in Python: the string that opens its body). Lines that say nothing are dropped: rulings,
placeholders and notes to self, the declaration's own name or words, tags without an explanation, pointers elsewhere,
disabled code, licence notices. What has nothing left has no description of its own.

Such methods inherit: the classes' bases are parsed, and overridden methods are joined along them, level by level, until no
more resolve; a method takes the description of the nearest ancestor's method of the same name. Unresolved ones are
dropped. ``origin`` tells own from inherited descriptions.

Cases: an empty docs array is no description, and no reason to look into the file; null names never match;
repeated rows count once; wrapped and null signatures are kept as they are, white space collapsed; a base that several
types of a repository are named by resolves to the one in the same file, else to none; cyclic hierarchies end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratigraph.session import cut

# Words and openings of documentation that says nothing.
_FILLER = set("a an the this that these those its it of for to and or in on with by is are".split())
_GENERIC = set("function method".split())
_PLACEHOLDER = re.compile(
    r"^\W*(todo|fixme|xxx+|hack|wip|tbd|tba|n/?a|none|nothing|null|\?+|placeholder|stub|dummy|fill (me )?in|write me|document me|docs?|doc(umentation)?|description|summary|no (description|documentation|docs)|undocumented|to be (done|documented|written|defined|determined)"
    r"|add (a )?(description|docs?|documentation|comment)s?( here)?|(missing|needs) (docs?|documentation|description)|work in progress|auto-?generated (method|function|constructor)? ?stub|(description|documentation|docs) (goes )?here|lorem ipsum.*|coming soon|not documented( yet)?|later|temp|temporary|test)\W*$"
    r"|^\W*(todo|fixme|xxx+|hack|wip|tbd)\b\W|^\W*auto-?generated\b|^\W*note to self\b|^\W*(remember|don'?t forget) to\b",
    re.I,
)
_POINTER = re.compile(
    r"^\W*(@see|@inheritdoc|\{@inheritdoc\}|inherit(ed|s)?[ -]?(doc|from|documentation)|\(?non-javadoc\)?|see\b|cf\b|ditto\b|idem\b|same (as|here)\b|as above|as below|refer to|described (in|above|below|elsewhere)|documented (in|above|below|elsewhere|at)|for (details|more|documentation),? see|docs? (in|at)\b|overrides? (the )?(base|super|parent)\b|implements? (the )?interface\b|@override\b|copied from\b|like above)",
    re.I,
)
_LICENCE = re.compile(r"copyright|spdx-license|licen[cs]ed under|all rights reserved|see (notice|licen[cs]e)|permission is hereby granted|without warranties|apache license|mit license|gnu general public|\(c\) \d{4}|redistribution and use", re.I)
_CODE = re.compile(r"[;{}]\s*$|^\W*[\w.\[\]]+\s*(:=|[-+*/|&]?=)\s*\S|^[\w.]+\([^()]*(\([^()]*\)[^()]*)*\)\s*[;{:]?$|^(return|if|for|while|else|elif|import|from|package|var|let|const|def|func|fn|class|public|private|switch|case|try|catch|throw|raise|print|assert|break|continue|del|yield|await|new)\b[^.!?]*[=;(){}\[\]:]|^\}|=>|->\s*\{|^(return|break|continue|pass)\W*\w*\W*$")
_TAG = re.compile(r"^(?:[@\\:](?P<t>[A-Za-z]\w*)\b:?|:(?P<s>\w+)(?:\s+[\w.*]+)*:)\s*(?P<r>.*)$")
_PARAM_TAGS = set("param parameter arg argument params tparam typeparam prop property throws exception raises raise template keyword var ivar cvar type rtype".split())
_SECTION = re.compile(r"^(args?|arguments?|parameters?|params?|returns?|return value|raises|throws|yields|exceptions?|examples?|notes?|attributes|# *(arguments|panics|errors|safety|examples?|returns))\s*:?\s*$", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")
_SPLIT = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\W\d_a-zA-Z]+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])")


def _stem(w: str) -> str:
    """Rough stem: inflected forms of one word share it."""
    w = w.lower()
    for end, rest in (("ies", "y"), ("ied", "y"), ("ying", "y"), ("ings", ""), ("ing", ""), ("ers", ""), ("er", ""), ("ors", ""), ("or", ""), ("ed", ""), ("es", ""), ("s", ""), ("e", ""), ("ation", "")):
        if w.endswith(end) and len(w) - len(end) >= 2:
            w = w[: -len(end)] + rest
            break
    if len(w) >= 4 and w[-1] == w[-2] and w[-1] not in "aeiou":
        w = w[:-1]
    return w.removesuffix("e") if len(w) > 3 else w


def name_words(name: str | None) -> set[str]:
    """Stems of the words of an identifier and of the identifier itself."""
    if not name:
        return set()
    parts = _SPLIT.findall(name)
    return {_stem(p) for p in parts} | {name.lower(), _stem(name), "".join(parts).lower()}


def comment_lines(raw: list[str | None] | None) -> list[str]:
    """Text lines of comment lines that still have their markers."""
    text = "\n".join(x for x in raw or [] if x is not None).replace("\r\n", "\n").replace("\r", "\n").strip()
    m = re.match(r"(?i)^[rubf]{0,2}(\"\"\"|'''|\"|')", text)
    if m and text.endswith(m[1]) and len(text) >= len(m[0]) + len(m[1]):
        return [x.strip() for x in text[m.end() : -len(m[1])].split("\n")]
    out = []
    for line in text.split("\n"):
        x = line.strip()
        x = re.sub(r"^(///?!?|//!|/\*\*?!?|\*(?!/)|#+!?|--|;+|<!--|\"\"\"|''')\s?", "", x) if not re.fullmatch(r"[*#/\-=~_]{4,}", x) else x
        x = re.sub(r"\s*(\*+/|-->|\"\"\"|''')$", "", x)
        out.append(x.strip())
    return out


def _own(text: str, known: set[str]) -> bool:
    """Whether a text has no word besides articles and the known stems."""
    ws = [w.lower() for w in _WORD.findall(re.sub(r"[_]", " ", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text)))]
    if text.strip(" .:()`'\"").lower() in known:
        return True
    rest = [w for w in ws if w not in _FILLER and w not in _GENERIC]
    return all(_stem(w) in known or w in known for w in rest)


def says(text: str, known: set[str]) -> bool:
    """Whether one sentence says something."""
    t = text.strip()
    if not any(c.isalpha() for c in t) or _PLACEHOLDER.search(t) or _POINTER.search(t) or _LICENCE.search(t):
        return False
    if _CODE.search(t):
        return False
    return not _own(t, known)


def meaningful(raw: list[str | None] | None, name: str | None) -> str:
    """The lines of a documentation comment that say something, joined by line breaks; empty if none does."""
    known = name_words(name)
    kept = []
    lines = comment_lines(raw)
    if any(_PLACEHOLDER.search(x) and re.match(r"^\W*auto-?generated\b", x, re.I) for x in lines[:1]):
        lines = lines[1:]
    licence = False
    for line in lines:
        if not line:
            licence = False
            continue
        if _LICENCE.search(line):
            licence = True  # a notice goes on to the end of its paragraph
            continue
        if licence or _SECTION.match(line):
            continue
        m = _TAG.match(line)
        if m:
            tag, rest = (m["t"] or m["s"] or "").lower(), m["r"].strip()
            if tag in ("see", "inheritdoc", "override", "author", "since", "version", "todo", "license", "copyright", "ignore", "internal", "private", "public", "noinspection", "suppresswarnings"):
                continue
            words = set(known)
            rest = re.sub(r"^\{[^}]*\}\s*", "", rest)
            if tag in _PARAM_TAGS and m["t"]:
                p = re.match(r"^\[?([\w.$*]+)[^\s\]]*\]?\s*(?:[-:–]\s*)?", rest)
                if p:
                    words |= name_words(p[1])
                    rest = rest[p.end() :]
            elif m["s"]:
                words |= set().union(*[name_words(x) for x in line.split(":")[1].split()])
            if rest and says(rest, words | {"return", "value", "result", _stem("returns"), _stem("parameter"), _stem("value")}):
                kept.append(line)
            continue
        good = [s for s in _SENTENCE.split(line) if s and says(s, known)]
        if good:
            kept.append(" ".join(good))
    return "\n".join(kept)


def source_comment(lines: list[str], start: int, name: str | None, ext: str) -> list[str] | None:
    """Raw lines of the comment directly above line ``start`` (1-based), or of the string that opens a Python body."""
    if not start or start < 1 or start > len(lines):
        return None
    if ext == "py":
        text = "\n".join(lines[start - 1 :])
        d = re.search(r"^[ \t]*(?:async[ \t]+)?def\b", text, re.M)
        if not d or text.count("\n", 0, d.start()) > 20:
            return None
        i, depth, quote = d.end(), 0, ""
        while i < len(text):  # to the colon that ends the head
            c = text[i]
            if quote:
                if c == "\\":
                    i += 1
                elif c == quote:
                    quote = ""
            elif c in "\"'":
                quote = c
            elif c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif c == ":" and depth == 0:
                break
            i += 1
        body = re.match(r":[ \t]*(?:#[^\n]*)?\s*(?:#[^\n]*\n\s*)*([rRuU]?(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))[ \t]*(?:\n|;|#|$)", text[i:])
        return body[1].split("\n") if body else None
    i = start - 2
    while i >= 0 and re.match(r"^\s*(@[\w.]+(\([^)]*\))?|#!?\[.*\])\s*$", lines[i]):
        i -= 1  # annotations between
    end = i
    if i >= 0 and lines[i].rstrip().endswith("*/"):
        while i >= 0 and "/*" not in lines[i]:
            i -= 1
        if i < 0 or not lines[i].lstrip().startswith("/*"):
            return None
        return lines[i : end + 1]
    while i >= 0 and lines[i].lstrip().startswith("//"):
        i -= 1
    return lines[i + 1 : end + 1] if i < end else None


def _current_key(files: DataFrame) -> DataFrame:
    """The (repo, path, mtime, ingested_at) of current versions, without touching contents."""
    old = F.lit("0001-01-01").cast("timestamp")
    return files.groupBy("repo", "path").agg(F.max(F.struct(F.coalesce("mtime", old).alias("m"), F.coalesce("ingested_at", old).alias("g"))).alias("_k"))


def found_in_source(todo: DataFrame, files: DataFrame) -> DataFrame:
    """decl_id and comment (array of raw lines) of declarations by their files. ``todo``: decl_id, repo, path, name, start_line.

    Contents meet one row per file, which lists the file's declarations, never a row per declaration.
    """
    old = F.lit("0001-01-01").cast("timestamp")
    per_file = todo.groupBy("repo", "path").agg(F.collect_list(F.struct("decl_id", "name", "start_line")).alias("ds"))
    want = per_file.join(_current_key(files), ["repo", "path"]).select("repo", "path", F.col("_k.m").alias("_m"), F.col("_k.g").alias("_g"), "ds")
    text = files.where("content is not null").select("repo", "path", F.coalesce("mtime", old).alias("_m"), F.coalesce("ingested_at", old).alias("_g"), "content")
    src = want.join(text, ["repo", "path", "_m", "_g"]).select("path", "content", "ds")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content, ds in zip(b["path"], b["content"], b["ds"]):
                lines = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                ext = path.rsplit(".", 1)[-1].lower()
                for x in ds:
                    c = source_comment(lines, x["start_line"], x["name"], ext)
                    if c:
                        rows.append((x["decl_id"], c))
            yield pd.DataFrame(rows, columns=["decl_id", "comment"])

    kind = dict(todo.dtypes)["decl_id"]
    return src.mapInPandas(run, f"decl_id {kind}, comment array<string>").dropDuplicates(["decl_id"])


def meaningful_column(docs, name):
    """``meaningful`` as a column."""

    @F.pandas_udf("string")
    def run(d: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([meaningful(None if x is None else list(x), y) for x, y in zip(d, n)])

    return run(docs, name)


def base_name(c):
    """Simple name of a base: without generics, qualifiers and blanks."""
    return F.regexp_extract(F.regexp_replace(c, r"\s|<.*$|\[.*$|\(.*$", ""), r"([A-Za-z_]\w*)$", 1)


def parents(types: DataFrame) -> DataFrame:
    """child, up: each base that names exactly one other type of its file, else exactly one other of its repository.

    Types are counted per name before anything is joined, so a name that thousands of types share is one row.
    """
    t = types.select("decl_id", "repo", "path", "name").where("name is not null")
    b = types.select("decl_id", "repo", "path", F.col("name").alias("own"), F.explode("bases").alias("_b")).select("decl_id", "repo", "path", "own", base_name(F.col("_b")).alias("name")).where("name != ''")
    for p, keys in (("f", ["repo", "path", "name"]), ("r", ["repo", "name"])):
        g = t.groupBy(*keys).agg(F.count("*").alias(f"{p}_n"), F.min("decl_id").alias(f"{p}_lo"), F.max("decl_id").alias(f"{p}_hi")).where(F.col(f"{p}_n") <= 2)
        b = b.join(g, keys, "left")
        other = F.when(F.col(f"{p}_lo") == F.col("decl_id"), F.col(f"{p}_hi")).otherwise(F.col(f"{p}_lo"))
        # a type that is named like its base counts among the types of that name itself
        same = F.col("own").eqNullSafe(F.col("name"))
        b = b.withColumn(f"{p}_up", F.when(same & (F.col(f"{p}_n") == 2), other).when(~same & (F.col(f"{p}_n") == 1), F.col(f"{p}_lo")))
    return b.select(F.col("decl_id").alias("child"), F.coalesce("f_up", "r_up").alias("up")).where("up is not null").distinct()


def inherited(methods: DataFrame, types: DataFrame) -> DataFrame:
    """decl_id, description of methods without one that an ancestor's method of the same name has, at any depth.

    ``methods``: decl_id, parent_id, name, description; ``types``: decl_id, repo, path, name, bases.
    """
    up = cut(parents(types))
    done = methods.where("description != ''").groupBy(F.col("parent_id").alias("up"), "name").agg(F.min("description").alias("text"))
    open_ = methods.where("description = '' and parent_id is not null and name is not null").select("decl_id", "name", F.col("parent_id").alias("at"))
    out = seen = None
    while True:  # ends: no method meets a type twice
        nxt = open_.join(up, open_["at"] == up["child"]).select("decl_id", "name", "up").distinct()
        stepped = cut(nxt if seen is None else nxt.join(seen, ["decl_id", "up"], "left_anti"))  # a cycle ends
        seen = stepped.select("decl_id", "up") if seen is None else seen.unionByName(stepped.select("decl_id", "up"))
        if not stepped.limit(1).count():
            break
        got = stepped.join(done, ["up", "name"]).groupBy("decl_id").agg(F.min_by("text", "up").alias("description"))
        out = got if out is None else out.unionByName(got)
        open_ = stepped.join(got, "decl_id", "left_anti").select("decl_id", "name", F.col("up").alias("at"))
    return out if out is not None else methods.where("1 = 0").select("decl_id", "description")


def pairs(declarations: DataFrame, files: DataFrame, inherit: bool = True) -> DataFrame:
    """decl_id, repo, path, name, signature, description, origin (own, inherited) of functions and methods."""
    cols = ["decl_id", "parent_id", "repo", "path", "kind", "name", "signature", "docs", "start_line"]
    d = declarations.where("kind in ('function', 'method') and decl_id is not null").select(*cols).dropDuplicates(["decl_id"])
    sc = found_in_source(d.where("docs is null and repo is not null and path is not null"), files)
    d = d.join(sc, "decl_id", "left").withColumn("docs", F.coalesce("docs", "comment")).drop("comment")
    d = d.withColumn("description", meaningful_column("docs", "name")).drop("docs")
    tidy = F.trim(F.regexp_replace("signature", r"\s+", " "))
    shape = ["decl_id", "repo", "path", "name", tidy.alias("signature"), "description"]
    if not inherit:
        return d.where("description != ''").select(*shape, F.lit("own").alias("origin"))
    d = cut(d)
    types = declarations.where("kind in ('class', 'struct', 'interface', 'record', 'enum') and decl_id is not null").select("decl_id", "repo", "path", "name", "bases").dropDuplicates(["decl_id"])
    inh = inherited(d.select("decl_id", "parent_id", "name", "description"), types)
    own = d.where("description != ''").select(*shape, F.lit("own").alias("origin"))
    return own.unionByName(d.drop("description").join(inh, "decl_id").select(*shape, F.lit("inherited").alias("origin")))
