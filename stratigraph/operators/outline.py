"""Row generators: declarations of source files, chunks, interface definitions, package manifests.

Files are cut into rows where they are read (``mapInPandas``); contents are not shuffled. Python is parsed with its own
grammar; the brace languages are scanned once with strings and comments blanked out, matching heads by the language's
patterns and finding their ends by braces. A file that does not parse gives the declarations before its error or none.
Null and empty contents give no rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "repo string, path string, kind string, name string, qualified_name string, depth int, start_line int, end_line int, visibility string, bases array<string>, docs string"
_BLANK = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)'|'(?:[^'\\\n]|\\.){2,}'")
_ID = r"[A-Za-z_$][\w$]*"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|async|export|default|declare|readonly|virtual|partial|data|case|implicit|inline|suspend|fileprivate|extern|unsafe|const|native|synchronized|new)\s+)*"

# Heads of declarations by language, as (kind, pattern with the groups name and bases).
HEADS: dict[str, list[tuple[str, str]]] = {
    "go": [("struct", rf"^type\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+struct\b"), ("interface", rf"^type\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+interface\b"), ("method", rf"^func\s+\(\s*(?:{_ID}\s+)?\*?(?P<recv>{_ID})(?:\[[^\]]*\])?\s*\)\s*(?P<name>{_ID})\s*\("), ("function", rf"^func\s+(?P<name>{_ID})\s*[\[(]"), ("delegate", rf"^type\s+(?P<name>{_ID})\s+")],
    "rs": [("struct", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|union)\s+(?P<name>{_ID})"), ("enum", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>{_ID})"), ("interface", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>{_ID})"), ("impl", rf"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:(?P<bases>[\w:<>, ]+?)\s+for\s+)?(?P<name>{_ID})"), ("namespace", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>{_ID})\s*\{{"), ("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern\s+S?)\s+)*fn\s+(?P<name>{_ID})"), ("delegate", rf"^\s*macro_rules!\s*(?P<name>{_ID})")],
    "java": [("class", rf"^\s*{_MODS}class\s+(?P<name>{_ID})[^{{;]*?(?:extends\s+(?P<bases>[^{{]+?))?\s*\{{"), ("interface", rf"^\s*{_MODS}@?interface\s+(?P<name>{_ID})"), ("enum", rf"^\s*{_MODS}enum\s+(?P<name>{_ID})"), ("record", rf"^\s*{_MODS}record\s+(?P<name>{_ID})"), ("function", rf"^\s*{_MODS}(?:<[^>]+>\s*)?(?!return\b|new\b|else\b|throw\b)[\w$.<>\[\], ?]+\s+(?P<name>{_ID})\s*\([^;{{}}]*\)[^;{{}}=]*[{{;]"), ("ctor", rf"^\s*{_MODS}(?P<name>[A-Z][\w$]*)\s*\([^;{{}}]*\)\s*(?:throws\s+[\w., ]+)?\{{")],
    "ts": [("class", rf"^\s*{_MODS}class\s+(?P<name>{_ID})(?:<[^{{]*?>)?(?:\s+extends\s+(?P<bases>[^{{]+?))?\s*(?:implements[^{{]*)?\{{"), ("interface", rf"^\s*{_MODS}interface\s+(?P<name>{_ID})"), ("enum", rf"^\s*{_MODS}enum\s+(?P<name>{_ID})"), ("namespace", rf"^\s*{_MODS}(?:namespace|module)\s+(?P<name>{_ID})"), ("function", rf"^\s*{_MODS}function\s*\*?\s*(?P<name>{_ID})"), ("function", rf"^\s*{_MODS}(?:const|let|var)\s+(?P<name>{_ID})[^=\n]*=\s*(?:async\s*)?(?:\([^)]*\)|{_ID})[^=\n]*=>"), ("member", rf"^\s+{_MODS}(?:get\s+|set\s+|\*\s*)?#?(?!(?:if|for|while|switch|catch|return|function|super|constructor_)\b)(?P<name>{_ID})\s*(?:<[^>]*>)?\([^;{{}}]*\)[^;{{}}=]*\{{")],
}
HEADS["js"] = HEADS["tsx"] = HEADS["jsx"] = HEADS["ts"]
HEADS["cs"] = [("namespace", rf"^\s*namespace\s+(?P<name>[\w.]+)"), *HEADS["java"], ("struct", rf"^\s*{_MODS}struct\s+(?P<name>{_ID})")]
HEADS["kt"] = [("class", rf"^\s*{_MODS}(?:class|object)\s+(?P<name>{_ID})"), ("interface", rf"^\s*{_MODS}interface\s+(?P<name>{_ID})"), ("function", rf"^\s*{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w.<>]+\.)?(?P<name>{_ID})\s*\(")]
HEADS["scala"] = [("class", rf"^\s*{_MODS}(?:class|object)\s+(?P<name>{_ID})(?:[^{{\n]*?extends\s+(?P<bases>[^{{\n]+))?"), ("interface", rf"^\s*{_MODS}trait\s+(?P<name>{_ID})"), ("function", rf"^\s*{_MODS}def\s+(?P<name>{_ID})")]
HEADS["swift"] = [("class", rf"^\s*{_MODS}(?:class|extension|actor)\s+(?P<name>{_ID})(?:\s*:\s*(?P<bases>[^{{]+?))?\s*\{{"), ("struct", rf"^\s*{_MODS}struct\s+(?P<name>{_ID})"), ("enum", rf"^\s*{_MODS}enum\s+(?P<name>{_ID})"), ("interface", rf"^\s*{_MODS}protocol\s+(?P<name>{_ID})"), ("function", rf"^\s*{_MODS}func\s+(?P<name>{_ID})")]
HEADS["m"] = [("class", rf"^@(?:interface|implementation)\s+(?P<name>{_ID}(?:\s*\([^)]*\))?)(?:\s*:\s*(?P<bases>{_ID}))?"), ("interface", rf"^@protocol\s+(?P<name>{_ID})"), ("method", r"^[-+]\s*\([^)]*\)\s*(?P<name>[\w:]+)")]
TYPES = {"class", "struct", "interface", "enum", "record", "namespace", "impl"}
_COMPILED = {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in HEADS.items()}


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def brace_outline(text: str, ext: str) -> list[tuple]:
    """(kind, name, qualified, depth, start, end, visibility, bases, docs) of one file, in order."""
    body = _BLANK.sub(_blank, text.replace("\r\n", "\n").replace("\r", "\n"))
    closer: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[{}]", body):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            closer[stack.pop()] = m.start()
    starts = [0, *(m.end() for m in re.finditer("\n", body))]
    line_of = lambda p: __import__("bisect").bisect_right(starts, p)
    found: dict[int, tuple] = {}
    for kind, rx in _COMPILED.get(ext, []):
        for m in rx.finditer(body):
            at = m.start("name")
            if at in found:
                continue
            first = m.start() + len(m[0]) - len(m[0].lstrip())
            brace, semi = body.find("{", at), body.find(";", at)
            stop = closer.get(brace, len(body) - 1) if brace >= 0 and (semi < 0 or brace < semi or ext in ("rs", "go")) else semi if semi >= 0 else body.find("\n", at)
            if ext == "m" and kind in ("class", "interface"):
                stop = max(at, body.find("@end", at))
            found[at] = (kind, m["name"], first, stop if stop >= 0 else len(body), (m.groupdict().get("bases") or "").strip(), m.groupdict().get("recv"), m[0])
    lines = body.split("\n")
    widen: dict[str, int] = {}  # types reach to the end of the methods and blocks attached to them
    for kind, name, _, stop, _, recv, _ in found.values():
        owner = recv or (name if kind == "impl" else None)
        if owner:
            widen[owner] = max(widen.get(owner, 0), line_of(stop))
    out: list[tuple] = []
    open_: list[tuple[str, str, int]] = []
    for at in sorted(found):
        kind, name, first, stop, bases, recv, head = found[at]
        while open_ and open_[-1][2] < first:
            open_.pop()
        owner = [o for o in open_ if o[0] in TYPES]
        if open_ and not owner or kind == "member" and not owner or any(o[0] not in TYPES for o in open_):
            continue  # inside a function
        if kind in ("function", "member") and owner and owner[-1][0] != "namespace":
            kind = "ctor" if name == "constructor" or name == owner[-1][1] else "method"
        qual = ".".join([*(o[1] for o in owner), *([recv] if recv else []), name])
        if re.search(r"\bprivate\b|\bfileprivate\b|#" + re.escape(name), head):
            vis = "private"
        elif re.search(r"\bprotected\b", head):
            vis = "protected"
        elif ext == "go":
            vis = "public" if name[:1].isupper() else "private"
        elif ext == "rs":
            vis = "public" if re.search(r"\bpub\b", head) else "private"
        else:
            vis = "private" if name.startswith("_") and ext in ("ts", "js") else "public"
        if kind != "impl":
            top, end = line_of(first), line_of(stop)
            while top > 1 and re.match(r"\s*@[A-Za-z]", lines[top - 2]) and ext != "m":
                top -= 1  # annotations belong to the declaration
            if kind in ("struct", "enum", "interface", "delegate"):
                end = max(end, widen.get(name, 0))
            out.append((kind, name, qual, len(owner) + bool(recv), top, end, vis, [b.strip() for b in re.split(r",", bases) if b.strip()], None))
        open_.append((kind, name, stop))
    return out


def python_outline(text: str) -> list[tuple]:
    """The same for Python, by its own parser."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple] = []

    def visit(body: list, trail: list[str], in_class: bool) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                cls = isinstance(n, ast.ClassDef)
                prop = any(isinstance(d, ast.Name) and d.id == "property" for d in n.decorator_list)
                kind = "class" if cls else "ctor" if in_class and n.name == "__init__" else "property" if in_class and prop else "method" if in_class else "function"
                vis = "private" if n.name.startswith("_") and not (n.name.startswith("__") and n.name.endswith("__")) else "public"
                out.append((kind, n.name, ".".join([*trail, n.name]), len(trail), start, n.end_lineno, vis, [ast.unparse(b) for b in n.bases] if cls else [], ast.get_docstring(n)))
                if cls:
                    visit(n.body, [*trail, n.name], True)
            elif isinstance(n, ast.Assign | ast.AnnAssign):
                t = n.targets[0] if isinstance(n, ast.Assign) else n.target
                if isinstance(t, ast.Name):
                    out.append(("field", t.id, ".".join([*trail, t.id]), len(trail), n.lineno, n.end_lineno, "private" if t.id.startswith("_") else "public", [], None))

    visit(tree.body, [], False)
    return out


def declarations(files: DataFrame) -> DataFrame:
    """A row per declaration of each file (repo, path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for repo, path, text in zip(b["repo"], b["path"], b["content"]):
                ext = path.rsplit(".", 1)[-1].lower() if path and "." in path else ""
                if text:
                    rows += [(repo, path, *r) for r in (python_outline(text) if ext == "py" else brace_outline(text, "m" if ext == "h" else ext))]
            yield pd.DataFrame(rows, columns=["repo", "path", "kind", "name", "qualified_name", "depth", "start_line", "end_line", "visibility", "bases", "docs"])

    return files.select("repo", "path", "content").mapInPandas(run, SCHEMA)


# ---- chunks


def split_regions(text: str, markdown: bool) -> list[str]:
    """Pieces that are never split: markdown sections and code blocks, else top-level blocks of lines."""
    if markdown:
        parts = re.split(r"(?m)^(?=#{1,6} )|^(?=```)", text)
    else:
        parts = re.split(r"(?m)^(?=[^\s})\]])", text)
    return [p for p in parts if p]


def chunk_text(text: str, limit: int = 1500, markdown: bool = False) -> list[tuple[int, int, int, str]]:
    """(start byte, start line, end line, content) of greedy chunks of at most ``limit`` bytes, a longer region alone.

    The contents, with those of white space only, add up to the text.
    """
    out, cur, size, byte, line = [], "", 0, 0, 1

    def flush() -> None:
        nonlocal cur, size, byte, line
        if cur:
            n = cur.count("\n")
            if cur.strip():
                out.append((byte, line, line + n - cur.endswith("\n"), cur))
            byte, line, cur, size = byte + size, line + n, "", 0

    for r in split_regions(text, markdown):
        n = len(r.encode())
        if cur and size + n > limit:
            flush()
        cur, size = cur + r, size + n
    flush()
    return out


def chunks(files: DataFrame, limit: int = 1500) -> DataFrame:
    """id, repo, path, start_line, end_line, content; the id depends on repo, path and first byte only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r, p, *c) for r, p, t in zip(b["repo"], b["path"], b["content"]) if t for c in chunk_text(t, limit, p.lower().endswith((".md", ".markdown")))]
            yield pd.DataFrame(rows, columns=["repo", "path", "byte", "start_line", "end_line", "content"])

    c = files.select("repo", "path", "content").mapInPandas(run, "repo string, path string, byte bigint, start_line int, end_line int, content string")
    return c.withColumn("id", F.xxhash64("repo", "path", "byte"))


# ---- interface definitions and manifests, native expressions only


def proto_methods(files: DataFrame) -> DataFrame:
    """repo, path, package, service, method, input, output of protobuf services."""
    s = files.select("repo", "path", F.regexp_extract("content", r"(?m)^\s*package\s+([\w.]+)\s*;", 1).alias("package"), F.explode(F.regexp_extract_all("content", F.lit(r"service\s+\w+\s*\{(?:[^{}]|\{[^{}]*\})*\}"), F.lit(0))).alias("b"))
    s = s.select("repo", "path", "package", F.regexp_extract("b", r"service\s+(\w+)", 1).alias("service"), F.explode(F.regexp_extract_all("b", F.lit(r"rpc\s+\w+\s*\([^)]*\)\s*returns\s*\([^)]*\)"), F.lit(0))).alias("m"))
    g = lambda i: F.regexp_extract("m", r"rpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)", i)
    return s.select("repo", "path", "package", "service", g(1).alias("method"), g(2).alias("input"), g(3).alias("output"))


def thrift_methods(files: DataFrame) -> DataFrame:
    """The same of thrift services; methods of one argument."""
    s = files.select("repo", "path", F.regexp_extract("content", r"(?m)^\s*namespace\s+\S+\s+([\w.]+)", 1).alias("package"), F.explode(F.regexp_extract_all("content", F.lit(r"service\s+\w+[^{]*\{[^{}]*\}"), F.lit(0))).alias("b"))
    s = s.select("repo", "path", "package", F.regexp_extract("b", r"service\s+(\w+)", 1).alias("service"), F.explode(F.regexp_extract_all("b", F.lit(r"[\w.<>, ]+?\s+\w+\s*\(\s*\d+\s*:\s*(?:required\s+|optional\s+)?[\w.]+\s+\w+\s*\)"), F.lit(0))).alias("m"))
    g = lambda i: F.trim(F.regexp_extract("m", r"([\w.<>, ]+?)\s+(\w+)\s*\(\s*\d+\s*:\s*(?:required\s+|optional\s+)?([\w.]+)\s+\w+", i))
    return s.select("repo", "path", "package", "service", g(2).alias("method"), g(3).alias("input"), g(1).alias("output"))


def package_names(files: DataFrame) -> DataFrame:
    """repo, path, package of manifests: package.json, Cargo.toml, pyproject.toml, go.mod."""
    base = F.substring_index("path", "/", -1)
    name = (
        F.when(base == "package.json", F.get_json_object("content", "$.name"))
        .when(base.isin("Cargo.toml", "pyproject.toml"), F.regexp_extract("content", r"(?s)\[(?:package|project|tool\.poetry)\][^\[]*?name\s*=\s*[\"']([^\"']+)", 1))
        .when(base == "go.mod", F.regexp_extract("content", r"(?m)^\s*module\s+\"?([^\"\s]+)", 1))
    )
    return files.select("repo", "path", name.alias("package")).where("package is not null and package != ''")
