"""Which source files are not valid in the language of their extension.

A file is split into the tokens of its language and the whole stream is run through the tables of a bundled grammar
(``glr``); the first token no parse can take, or the first character no token fits, is the error. Python gets its
indentation tokens, Go and ECMAScript their automatic semicolons. Undefined names and types do not matter.

Cases: a null text has no verdict; markdown and other extensions are always valid; an empty Python, TypeScript,
JavaScript or Rust file is valid, an empty Go file is not (it lacks its package clause), an empty Java file is; CR, CRLF and LF end lines; a byte order mark
is skipped; several rows of one file: the one with the greatest mtime counts; equal texts are parsed once.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from importlib import resources

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratigraph.llm.bpe import spread
from stratigraph.llm.glr import LONGEST, Tables, fits, recognise

# File extensions and the language they stand for.
EXTENSIONS = {"py": "py", "ts": "ts", "js": "js", "go": "go", "java": "java", "rs": "rs"}

_STR = r'"(?:[^"\\\n]|\\[\s\S])*"'
_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
_NUM = r"(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)"
_END = r"(?!\w)"
_WORD = r"(?!\d)\w++"


def _lexer(*pairs: tuple[str, str]) -> tuple[re.Pattern, re.Pattern]:
    """Tokens by name, and the same as one group; the first pair is what may stand before any token. Words and brackets, the most frequent, come first."""
    word = next(p for n, p in pairs if n == "WORD")
    rest = [x for x in pairs[1:] if x[0] != "WORD"]
    all_ = [("WORD", word), ("P", r"[()\[\]{},;]"), *rest, ("BAD", rf"(?!{pairs[0][1]})[\s\S]")]
    named = re.compile(f"(?:{pairs[0][1]})?(?:" + "|".join(f"(?P<{n}>{p})" for n, p in all_) + ")")
    return named, re.compile(f"(?:{pairs[0][1]})?(" + "|".join(f"(?:{p})" for _, p in all_) + ")")


def _ops(*text: str) -> str:
    return "|".join(re.escape(o) for o in sorted(" ".join(text).split(), key=len, reverse=True))


LEX = {
    "py": _lexer(
        ("WS", r"(?:[ \t\f]|\\\n)+"), ("LF", r"\n(?:[ \t\f]*(?:#[^\n]*)?\n)*[ \t\f]*"), ("SKIP", r"#[^\n]*"),
        ("STR", r"(?:[rRbBuUfFtT]{0,2})(?:'''(?:[^\\]|\\[\s\S])*?'''|\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\")"),
        ("NUM", rf"(?!0[\d_]*[1-9][\d_]*(?![\d_.eEjJ])){_NUM}[jJ]?(?:{_END}|(?=(?:if|else|and|or|in|is|for|not)\b))"), ("WORD", r"(?!\d)\w++(?![\"'])"), ("AUG", _ops("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=")),
        ("OP", _ops("( ) [ ] { } , : . ; @ = -> + - * / // % ** << >> & | ^ ~ < > <= >= == != ... :=")),
    ),
    "go": _lexer(
        ("WS", r"[ \t\r]+"), ("SKIP", r"//[^\n]*"), ("MULTI", r"/\*[\s\S]*?\*/"), ("LF", r"\n"), ("STR", _STR + r"|`[^`]*`"), ("CHR", r"'(?:[^'\\\n]|\\[^\n])+'"),
        ("NUM", f"{_NUM}i?{_END}"), ("WORD", _WORD), ("AUG", _ops("+= -= *= /= %= &= |= ^= <<= >>= &^=")),
        ("OP", _ops("( ) [ ] { } , ; : . ... := = == != < <= > >= <- + - * / % & | ^ &^ << >> && || ! ++ -- ~")),
    ),
    "java": _lexer(
        ("WS", r"[ \t\r\f]+"), ("SKIP", _COMMENT), ("LF", r"\n"), ("STR", r'"""[\s\S]*?"""|' + _STR), ("CHR", r"'(?:[^'\\\n]|\\[^\n]+?)'"),
        ("NUM", f"{_NUM}[lLfFdD]?{_END}"), ("WORD", r"(?!\d)[\w$]+"), ("AUG", _ops("+= -= *= /= %= &= |= ^= <<=")),
        ("OP", _ops("( ) [ ] { } , ; : :: . ... = == != < <= > + - * / % & | ^ << && || ! ++ -- ~ -> ? @")),
    ),
    "rs": _lexer(
        ("WS", r"[ \t\r]+"), ("SKIP", _COMMENT), ("LF", r"\n"), ("STR", r'[bc]?r"[^"]*"|[bc]?r#"[\s\S]*?"#|[bc]?r##"[\s\S]*?"##|[bc]?r###"[\s\S]*?"###|[bc]?"(?:[^"\\]|\\[\s\S])*"'),
        ("CHR", r"b?'(?:[^'\\\n]|\\[^\n]+?)'"), ("LIFE", r"'(?!\d)\w+"),
        ("NUM", r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?" + _END),
        ("WORD", r"r#(?!\d)\w+|(?!\d)\w++(?![\"'#])"), ("AUG", _ops("+= -= *= /= %= &= |= ^= <<=")),
        ("OP", _ops("( ) [ ] { } , ; : :: . .. ... ..= = == != < <= > + - * / % & | ^ << && || ! -> => ? @ # $ ~")),
    ),
    "ts": _lexer(
        ("WS", r"[ \t\r\f ﻿]+"), ("SKIP", r"//[^\n]*|\A#![^\n]*"), ("MULTI", r"/\*[\s\S]*?\*/"), ("LF", r"\n"), ("STR", _STR + r"|'(?:[^'\\\n]|\\[\s\S])*'"),
        ("NUM", f"{_NUM}n?{_END}"), ("PRIV", r"#[A-Za-z_$][\w$]*"), ("WORD", r"(?!\d)[\w$]+"), ("AUG", _ops("+= -= *= /= %= **= &= |= ^= <<= &&= ||= ??=")),
        ("TPL", r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^`{}\"']*\})*`"), ("OP", r"\?\.(?!\d)|" + _ops("( ) [ ] { } , ; : . ... = == != === !== < <= > + - * / % ** & | ^ << && || ?? ! ++ -- ~ ? => @")), ("TICK", "`"),
    ),
}
LEX["js"] = LEX["ts"]
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*")
_OPERAND_END = {"ID", "NUM", "STR", "TPL", "RE", "PRIV", ")", "]", "}", "this", "super", "null", "true", "false"}
_GO_END = {"ID", "NUM", "STR", "CHR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}


_CLASSES = {"ID", "NUM", "STR", "CHR", "TPL", "RE", "LIFE", "PRIV", "AUG", "NL", "INDENT", "DEDENT", "NEVER"}


class BadToken(Exception):
    """No token of the language fits at this line."""

    def __init__(self, line: int):
        super().__init__(line)
        self.line = line


def _template(text: str, at: int) -> tuple[int, list[str]]:
    """Position after the template literal whose back tick is at ``at``, -1 if it is open, and its substitutions."""
    i, n = at + 1, len(text)
    inside: list[str] = []
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1, inside
        elif c == "$" and text.startswith("${", i):
            depth, i = 1, i + 2
            first = i
            while i < n and depth:
                c = text[i]
                if c == "`":
                    i, _ = _template(text, i)  # judged with the expression it stands in
                    if i < 0:
                        return -1, inside
                    continue
                if c in "\"'":
                    j = i + 1
                    while j < n and text[j] not in (c, "\n"):
                        j += 2 if text[j] == "\\" else 1
                    i = j
                depth += (c == "{") - (c == "}")
                i += 1
            inside.append(text[first : i - 1])
        else:
            i += 1
    return -1, inside


class _Careful(Exception):
    """A text that needs the context-dependent lexer."""


def _fields(text: str, at: int) -> tuple[int, list[str]]:
    """Position after the formatted Python string that starts at ``at`` and the expressions in it; -1 if it is open."""
    m = re.compile(r"[rRfFtTbBuU]{0,2}(\"\"\"|'''|\"|')").match(text, at)
    quote, raw, n = m[1], "r" in m[0].lower(), len(text)
    out: list[str] = []

    def field(i: int) -> int:
        """Past the closing brace of the field whose expression starts at ``i``; -1 if there is none."""
        first, depth = i, 0
        while i < n:
            c = text[i]
            if c in "\"'":
                s = re.compile(r"(?<![\w])[rRfFtTbBuU]{0,2}$").search(text, max(first, i - 2), i)
                start = s.start() if s else i
                if "f" in text[start:i].lower() or "t" in text[start:i].lower():
                    i = inner(start)
                else:
                    e = _PY_STR.match(text, start)
                    i = e.end() if e else -1
                if i < 0:
                    return -1
                continue
            if c == "#":
                return -1
            if c in "([{":
                depth += 1
            elif c in ")]" or c == "}" and depth:
                depth -= 1
            elif depth == 0 and (c in "}:" or c == "!" and text[i + 1 : i + 2] != "="):
                break
            i += 1
        if i >= n:
            return -1
        expr = text[first:i].rstrip()
        out.append(expr[:-1] if re.search(r"[^=!<>:]=$", expr) else expr)
        if text[i] == "!":
            conv = re.compile(r"!\s*[rsa]\s*").match(text, i)
            if not conv:
                return -1
            i = conv.end()
        if text[i : i + 1] == ":":
            i += 1
            while i < n and text[i] != "}":
                if text.startswith(quote, i) or text[i] == "\n" and len(quote) == 1:
                    return -1
                i = field(i + 1) if text[i] == "{" else i + 1
                if i < 0:
                    return -1
        return i + 1 if text[i : i + 1] == "}" else -1

    def inner(start: int) -> int:
        end, more = _fields(text, start)
        out.extend(more)
        return end

    i = m.end()
    while i < n:
        c = text[i]
        if text.startswith(quote, i):
            return i + len(quote), out
        if c == "\\" and not raw and text.startswith("\\N{", i):
            i = text.find("}", i) + 1
            if i == 0:
                return -1, out
        elif c == "\\":
            i += 1 if text[i + 1 : i + 2] in ("{", "}") else 2
        elif c == "{" and text[i + 1 : i + 2] != "{":
            i = field(i + 1)
            if i < 0:
                return -1, out
        elif c == "}" and text[i + 1 : i + 2] != "}":
            return -1, out
        elif c in "{}":
            i += 2
        elif c == "\n" and len(quote) == 1:
            return -1, out
        else:
            i += 1
    return -1, out


_PY_STR = re.compile(r"(?:[rRbBuU]{0,2})(?:'''(?:[^\\]|\\[\s\S])*?'''|\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\")")
_FORMATTED = re.compile(r"(?:[rR]?[fFtT]|[fFtT][rR])[\"']")
_JAVA_ESCAPE = re.compile(r"\\(?![btnfrs\"'\\0-7\n]|u+[0-9a-fA-F]{4})")
_NESTED = re.compile(r"/\*(?:(?!\*/)[\s\S])*?/\*")


def _flat_comments(text: str) -> str:
    """A Rust text whose nested block comments are plain ones and whose raw strings with many marks are short ones."""
    import regex

    keep = regex.compile(r"//[^\n]*|[bc]?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[^\n]+?)'|(?P<c>/\*(?:(?:(?!/\*|\*/)[\s\S])+|(?P>c))*\*/)")

    def flat(m: regex.Match) -> str:
        if m["c"]:
            return " " + "\n" * m[0].count("\n")
        return 'r"' + "\n" * m[0].count("\n") + '"' if m["h"] and len(m["h"]) > 3 else m[0]

    return keep.sub(flat, text)


def _scan(text: str, lang: str, parser: Parser) -> list[tuple[str, int, bool]]:
    """(terminal, line, after a line break) of a whole text, with the end as an empty terminal."""
    if lang in ("ts", "js"):
        return _ecma_tokens(text, lang, parser)
    words, lex = parser.words[lang], LEX[lang][0]
    out: list[tuple[str, int, bool]] = []
    add = out.append
    py, go = lang == "py", lang == "go"
    line, broke, depth, indents, pos = 1, False, 0, [0], 0
    if py:  # the first line is indented like any other
        text, line = "\n" + text, 0
    n = len(text)
    while pos < n and (m := lex.match(text, pos)):
        kind, pos = m.lastgroup, m.end()
        if kind == "WORD":
            got = m[kind]
            add((got if got in words else "ID", line, broke))
            broke = False
        elif kind == "P" or kind == "OP":
            got = m[kind]
            if py:
                if got in "([{":
                    depth += 1
                elif got in ")]}":
                    depth = max(0, depth - 1)
            add((got, line, broke))
            broke = False
        elif kind == "LF":
            if py:
                got = m[kind]
                before, line = line, line + got.count("\n")
                if depth or pos >= n or text[pos] == "#":
                    if not depth and out and out[-1][0] not in ("NL", "INDENT", "DEDENT"):
                        add(("NL", before, False))
                    continue
                if out and out[-1][0] not in ("NL", "INDENT", "DEDENT"):
                    add(("NL", before, False))
                width = len(got[got.rindex("\n") + 1 :].expandtabs(8))
                if width != indents[-1] and text[pos] != "\\":
                    if width > indents[-1]:
                        indents.append(width)
                        add(("INDENT", line, True))
                    while width < indents[-1]:
                        indents.pop()
                        add(("DEDENT", line, True))
                    if width != indents[-1]:
                        raise BadToken(line)
                continue
            if go and out and out[-1][0] in _GO_END:
                add((";", line, False))
            line += 1
            broke = True
        elif kind == "SKIP" or kind == "MULTI":
            got = m[kind]
            if "\n" in got:
                if go and out and out[-1][0] in _GO_END:
                    add((";", line, False))
                line += got.count("\n")
                broke = True
        elif kind == "BAD":
            raise BadToken(line)
        else:
            got, start = m[kind], m.start(kind)
            if py and kind == "STR" and _FORMATTED.match(got):
                end, inside = _fields(text, start)
                if end < 0 or not all(parser.expression(x, lang) for x in inside):
                    raise BadToken(line)
                pos, got = end, text[start:end]
            elif not parser.sound(kind, got, lang):
                raise BadToken(line)
            add((kind, line, broke))
            broke = False
            line += got.count("\n")
    if py:
        if depth:
            raise BadToken(line)
        if out and out[-1][0] not in ("NL", "DEDENT"):
            add(("NL", line, False))
        out += [("DEDENT", line, True)] * (len(indents) - 1)
    elif go and out and out[-1][0] in _GO_END:
        add((";", line, False))
    add(("", line, True))
    return out


def _ecma_tokens(text: str, lang: str, parser: Parser) -> list[tuple[str, int, bool]]:
    """The same with regular expressions and nested templates, whose extent depends on what stands before."""
    out: list[tuple[str, int, bool]] = []
    words = parser.words[lang]
    lex, pos, line, broke, n = LEX[lang][0], 0, 1, False, len(text)
    while pos < n and (m := lex.match(text, pos)):
        kind = m.lastgroup
        got, start = m[kind], m.start(kind)
        if got in ("/", "/=") and not (out and out[-1][0] in _OPERAND_END):
            r = _REGEX.match(text, start)
            if not r:
                raise BadToken(line)
            kind, got = "RE", r[0]
        elif kind in ("TICK", "TPL"):
            end, inside = _template(text, start)
            if end < 0 or not all(parser.expression(x, lang) for x in inside):
                raise BadToken(line)
            kind, got = "TPL", text[start:end]
        pos = start + len(got)
        if kind in ("SKIP", "LF", "MULTI"):
            breaks = got.count("\n")
            line += breaks
            broke |= breaks > 0
            continue
        if kind == "BAD":
            raise BadToken(line)
        if kind == "WORD":
            kind = got if got in words else "ID"
        elif kind in ("P", "OP"):
            kind = got
        out.append((kind, line, broke))
        broke = False
        line += got.count("\n")
    out.append(("", line, True))
    return out


_BREAK = "\n"
_PIECE_END = frozenset("()[]{},;")
_DEPTH = {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}


class _Terms(dict):
    """The terminal of each token text: None for what is skipped, ``_BREAK`` or, in Python, the width for line breaks."""

    def __init__(self, parser: Parser, lang: str):
        super().__init__()
        self.parser, self.lang = parser, lang

    def __missing__(self, tok: str):
        m = LEX[self.lang][0].match(tok)
        kind = m.lastgroup if m and m.end() == len(tok) else "BAD"
        if kind == "WORD":
            t = tok if tok in self.parser.words[self.lang] else "ID"
        elif kind in ("P", "OP"):
            t = tok
        elif kind == "LF":
            t = len(tok[tok.rindex("\n") + 1 :].expandtabs(8)) if self.lang == "py" else _BREAK
        elif kind in ("SKIP", "MULTI"):
            t = _BREAK if "\n" in tok else None
        elif kind in ("BAD", "TICK") or tok == "/=" or kind == "STR" and self.lang == "py" and _FORMATTED.match(tok) and _fields(tok, 0)[0] != len(tok) or not self.parser.sound(kind, tok, self.lang):
            raise _Careful
        else:
            t = kind
        if len(tok) <= 64:
            if len(self) > 300_000:
                self.clear()
            self[tok] = t
        return t


def load_tables(lang: str) -> Tables:
    """Tables of a bundled grammar."""
    name = "ts" if lang == "js" else lang
    return Tables(resources.files("stratigraph.llm.grammars").joinpath(f"{name}.txt").read_text(), lang)


class Parser:
    """Parsers of all languages; tables are built on first use."""

    def __init__(self, tables: dict[str, Tables] | None = None):
        self.tables = tables or {}
        self.words: dict[str, frozenset[str]] = {}
        self.terms: dict[str, _Terms] = {}
        self.known: dict[tuple[str, str], bool] = {}

    def sound(self, kind: str, tok: str, lang: str) -> bool:
        """Whether the inside of a literal is valid: substitutions, formatted fields, escapes, bytes."""
        if kind == "TPL":
            return "${" not in tok or all(self.expression(x, lang) for x in _template(tok, 0)[1])
        if kind == "STR" and lang == "py":
            if _FORMATTED.match(tok):
                return "{" not in tok and "}" not in tok or all(self.expression(x, lang) for x in _fields(tok, 0)[1])
            return tok.isascii() or "b" not in re.match(r"\w*", tok)[0].lower()
        if lang == "java" and kind in ("STR", "CHR") and "\\" in tok:
            return not _JAVA_ESCAPE.search(tok.replace("\\\\", ""))
        return True

    def expression(self, text: str, lang: str) -> bool:
        """Whether a text is an expression, as inside templates and formatted strings."""
        key = (lang, text)
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[key] = bool(text.strip()) and self.error_line(f"({text}\n)\n", lang) == 0
        return self.known[key]

    def lines(self, text: str, lang: str) -> list[tuple[bool, tuple[str, ...]]] | None:
        """The terminals of a text in pieces, the last one the end; None if they cannot be right.

        A piece is a line or, of a long one, what ends at a bracket, comma or semicolon; the flag tells lines.
        """
        if lang not in self.terms:
            self.terms[lang] = _Terms(self, lang)
        terms = list(map(self.terms[lang].__getitem__, LEX[lang][1].findall("\n" + text if lang == "py" else text)))
        out: list[tuple[bool, tuple[str, ...]]] = []

        def add(seg: list[str], broke: bool) -> None:
            if len(seg) <= LONGEST:
                out.append((broke, tuple(seg)))
                return
            first = 0
            for i, t in enumerate(seg):
                if i - first >= 24 and t in _PIECE_END or i - first >= LONGEST - 1:
                    out.append((broke and first == 0, tuple(seg[first : i + 1])))
                    first = i + 1
            if first < len(seg):
                out.append((broke and first == 0, tuple(seg[first:])))

        if lang == "py":
            seg: list[str] = []
            depth, indents, width = 0, [0], None
            for t in terms:
                if t is None:
                    continue
                if t.__class__ is int:
                    if not depth:
                        if seg:
                            seg.append("NL")
                            add(seg, True)
                            seg = []
                        width = t
                    continue
                if width is not None:
                    if width > indents[-1]:
                        indents.append(width)
                        seg.append("INDENT")
                    while width < indents[-1]:
                        indents.pop()
                        seg.append("DEDENT")
                    if width != indents[-1]:
                        return None
                    width = None
                if t in _DEPTH:
                    depth += _DEPTH[t]
                    if depth < 0:
                        return None
                seg.append(t)
            if depth:
                return None
            if seg:
                add([*seg, "NL"], True)
            out.append((True, (*["DEDENT"] * (len(indents) - 1), "")))
            return out
        terms = [t for t in terms if t is not None]
        if lang in ("ts", "js") and "/" in terms:
            before = ""
            for t in terms:
                if t == "/" and before not in _OPERAND_END:
                    raise _Careful
                if t != _BREAK:
                    before = t
        go, at = lang == "go", 0
        terms.append(_BREAK)
        while at < len(terms):
            end = terms.index(_BREAK, at)
            if end > at:
                seg = terms[at:end]
                if go and seg[-1] in _GO_END:
                    seg.append(";")
                add(seg, at > 0)
            at = end + 1
        out.append((True, ("",)))
        return out

    def error_line(self, text: str | None, lang: str | None) -> int | None:
        """Line of the first unrecoverable error, 0 if valid; None without a text.

        Lines are judged as wholes; only a text that fails that way is run token by token, which finds the place.
        """
        if text is None:
            return None
        if lang not in LEX:
            return 0
        if lang not in self.tables:
            self.tables[lang] = load_tables(lang)
        t = self.tables[lang]
        text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
        if lang not in self.words:
            self.words[lang] = frozenset(x for x in t.terminals if x.isidentifier() and x not in _CLASSES)
        if lang == "rs" and ("####" in text or "/*" in text and _NESTED.search(text)):
            text = _flat_comments(text)
        insert = ";" if lang in ("ts", "js") else ""
        careful = False
        try:
            lines = self.lines(text, lang)
            if lines is not None and fits(t, lines, insert):
                return 0
        except _Careful:
            careful = True
        try:
            toks = _scan(text, lang, self)
        except BadToken as e:
            return e.line
        if careful and insert:
            cuts = [i for i, x in enumerate(toks) if x[2] or i == 0] + [len(toks)]
            if fits(t, [(toks[a][2], tuple(x[0] for x in toks[a:b])) for a, b in zip(cuts, cuts[1:])], insert):
                return 0
        return recognise(t, toks, insert)


def extension(path: Column) -> Column:
    """Lower-case extension of a path, empty if it has none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def current_files(files: DataFrame, *extra: str) -> DataFrame:
    """repo, path, content and ``extra`` of the current version (greatest mtime) of each file."""
    cols = ["content", *extra]
    old = F.lit("0001-01-01").cast("timestamp")
    cur = files.where("repo is not null and path is not null").groupBy("repo", "path").agg(F.max_by(F.struct(*cols), F.struct(F.coalesce("mtime", old), F.coalesce("ingested_at", old), F.coalesce(F.xxhash64("content"), F.lit(0)))).alias("_c"))
    return cur.select("repo", "path", *[F.col(f"_c.{c}").alias(c) for c in cols])


def parse_files(files: DataFrame) -> DataFrame:
    """repo, path, language, error_line of each current file with a text; error_line is 0 for a valid one.

    Files are parsed where they are read: contents, be they small or huge, are never shuffled, and only verdicts move on
    to the choice of the current version. A worker parses a text that repeats once.
    """
    old = F.lit("0001-01-01").cast("timestamp")
    at = F.struct(F.coalesce("mtime", old).alias("m"), F.coalesce("ingested_at", old).alias("g"), F.coalesce(F.xxhash64("content"), F.lit(0)).alias("k"))
    rows = files.where("repo is not null and path is not null").select("repo", "path", extension(F.col("path")).alias("language"), at.alias("at"), F.xxhash64("content").alias("k1"), F.xxhash64(F.lit(7), "content").alias("k2"), "content")
    tables = files.sparkSession.sparkContext.broadcast({lang: load_tables(lang) for lang in sorted(set(EXTENSIONS.values()))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Parser(tables.value)
        memo: dict[tuple, int | None] = {}
        for b in batches:
            out = []
            for e, k1, k2, t in zip(b["language"], b["k1"], b["k2"], b["content"]):
                if t is None or e not in EXTENSIONS:
                    out.append(None if t is None else 0)
                    continue
                if (e, k1, k2) not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    gc.disable()  # tokens and stacks are many short tuples without cycles
                    try:
                        memo[e, k1, k2] = p.error_line(t, EXTENSIONS[e])
                    finally:
                        gc.enable()
                out.append(memo[e, k1, k2])
            b = b.drop(columns=["content", "k1", "k2"])
            b["error_line"] = pd.array(out, dtype="Int32")
            yield b

    kinds = dict(rows.dtypes)
    verdict = spread(rows).mapInPandas(run, f"repo {kinds['repo']}, path {kinds['path']}, language string, at {kinds['at']}, error_line int")
    cur = verdict.groupBy("repo", "path", "language").agg(F.max_by(F.struct("error_line"), "at").alias("v"))
    return cur.select("repo", "path", "language", F.col("v.error_line").alias("error_line")).where("error_line is not null")


def error_rates(parsed: DataFrame) -> DataFrame:
    """repo, language, files, invalid, rate."""
    g = parsed.groupBy("repo", "language").agg(F.count("*").alias("files"), F.count_if(F.col("error_line") > 0).alias("invalid"))
    return g.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
