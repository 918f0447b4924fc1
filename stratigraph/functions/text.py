"""Scalar functions over identifiers, paths and texts, all as column expressions inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
# Directories and endings that are never indexed, and the extensions of languages.
DENY_DIRS = [".git", ".hg", ".svn", ".jj", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "node_modules", ".next", ".nuxt", ".turbo", ".parcel-cache", "dist", "build", "out", ".eggs", "target", ".cache", ".gradle", ".idea", ".vscode"]
DENY_ENDS = [".pb.go", "_pb.go", ".pb.cc", ".pb.h", "_pb2.py", "_pb2_grpc.py", "_test.go", ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", ".min.js", ".min.css", ".lepus.ts", ".lepus.tsx"]
SYMBOL_QUERY = r"^(?:[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\\|->|\.)[A-Za-z_][A-Za-z0-9_]*)+|_[A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9]*[A-Z_][A-Za-z0-9_]*|[A-Z][A-Za-z0-9]*)$"
LANGUAGE_OF = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "scala": "scala", "cs": "csharp", "swift": "swift", "m": "objc", "h": "objc", "md": "markdown", "markdown": "markdown"}


def identifiers(text: Column) -> Column:
    """All identifiers of a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"([a-zA-Z_][a-zA-Z0-9_]*)"), F.lit(1))


def sub_tokens(ident: Column) -> Column:
    """Lower-case parts of an identifier: by underscores if it has any, else by case and digits."""
    snake = F.filter(F.split(F.lower(ident), "_"), lambda p: p != "")
    camel = F.transform(F.regexp_extract_all(ident, F.lit(f"({_PARTS})"), F.lit(1)), lambda p: F.lower(p))
    return F.when(F.contains(ident, F.lit("_")), snake).otherwise(camel)


def tokenize(text: Column) -> Column:
    """Identifier-aware tokens: each compound in lower case and, where it has two or more, its parts."""
    none = F.array().cast("array<string>")
    # the parts are bound by the inner transform, so that they are worked out once an identifier
    with_parts = lambda i: F.transform(F.array(sub_tokens(i)), lambda p: F.concat(F.array(F.lower(i)), F.when(F.size(p) > 1, p).otherwise(none)))
    return F.flatten(F.flatten(F.transform(identifiers(F.coalesce(text, F.lit(""))), with_parts)))


def is_symbol_query(q: Column) -> Column:
    """Whether a query looks like a symbol: qualified, with capitals or underscores."""
    return F.trim(q).rlike(SYMBOL_QUERY)


def symbol_name(q: Column) -> Column:
    """What follows the last separator: ``::``, else a backslash, else ``->``, else a dot."""
    return F.when(F.contains(q, F.lit("::")), F.substring_index(q, "::", -1)).when(F.contains(q, F.lit("\\")), F.substring_index(q, "\\", -1)).when(F.contains(q, F.lit("->")), F.substring_index(q, "->", -1)).otherwise(F.substring_index(q, ".", -1))


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def parent(p: Column) -> Column:
    return F.regexp_extract(p, r"^(.*)/[^/]*$", 1)


def stem(p: Column) -> Column:
    return F.regexp_replace(basename(p), r"(?<=.)\.[^.]*$", "")


def extension(p: Column) -> Column:
    return F.lower(F.regexp_extract(basename(p), r".\.([^.]+)$", 1))


def language_of(p: Column) -> Column:
    """Language by extension; null if none is known."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])[extension(p)]


def denied(p: Column) -> Column:
    """Whether a directory or the ending of a path is on the list of what is never indexed."""
    dirs = F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1)
    ends = "|".join(e.replace(".", r"\.") for e in DENY_ENDS)
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in DENY_DIRS])) | F.lower(basename(p)).rlike(f"(?:{ends})$")


def node_id(kind: Column, repo: Column, path: Column, symbol: Column) -> Column:
    """First 128 bits of SHA-256 over the four parts, in hex; a null symbol is an empty one."""
    z = F.char(F.lit(0))
    return F.substring(F.sha2(F.concat(kind, z, repo, z, path, z, F.coalesce(symbol, F.lit(""))), 256), 1, 32)


def collapse(t: Column) -> Column:
    """Trimmed, with single blanks."""
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def preview(t: Column, n: int = 200) -> Column:
    """The first ``n`` characters without line breaks, with an ellipsis where something is left out."""
    c = collapse(t)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def safe_name(t: Column) -> Column:
    return F.regexp_replace(t, r"[^A-Za-z0-9_-]", "_")


def base_type(t: Column) -> Column:
    """A type name without generics, arrays and qualifiers."""
    return F.element_at(F.split(F.regexp_replace(F.trim(t), r"[<\[].*$", ""), r"::|\."), -1)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def path_penalty(p: Column) -> Column:
    """Product of the penalties of tests, re-export files, legacy code, examples and type declarations."""
    low = F.lower(p)
    test = low.rlike(r"(^|/)(tests?|__tests__|spec|specs|testing)/") | F.lower(basename(p)).rlike(r"^test_|_test\.[a-z]+$|\.(test|spec)\.[a-z]+$|tests?\.(java|kt|cs|swift)$|^conftest\.py$")
    rules = [(test, 0.3), (basename(p).isin("__init__.py", "index.ts", "index.js", "mod.rs", "lib.rs"), 0.5), (low.rlike(r"(^|/)(compat|_compat|legacy|deprecated)(/|\.)"), 0.3), (low.rlike(r"(^|/)(examples?|docs_src)/"), 0.3), (low.endswith(".d.ts"), 0.7)]
    out = F.lit(1.0)
    for c, w in rules:
        out = out * F.when(c, w).otherwise(1.0)
    return out


def size_bucket(lines: Column) -> Column:
    return F.when(lines <= 50, "tiny").when(lines <= 200, "small").when(lines <= 600, "medium").when(lines <= 1500, "large").otherwise("xlarge")
