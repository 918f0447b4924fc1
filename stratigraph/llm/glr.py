"""Table-driven recognition of token streams: SLR(1) tables made from a grammar text, run as a generalised LR parser.

A grammar has one rule a line, ``name: alternative | alternative``. Quoted words and upper-case names are terminals,
lower-case names are rules; ``?``, ``*``, ``+`` and parentheses mean what they do in regular expressions. ``ANY`` stands
for every terminal but brackets, ``KW`` for every terminal that is a word; a rule may go on in more lines, and lines
that begin with ``name|`` hold only for that variant. Where a table cell holds several actions, the parser follows all of them; stacks
share their tails and are merged when they agree, so local ambiguity stays cheap. Without conflict it is a plain
deterministic LR parser. Only recognition is done: the first token at which no stack survives is the error.
"""

from __future__ import annotations

import re

BRACKETS = {"(", ")", "[", "]", "{", "}"}
_TOK = re.compile(r"'[^']*'|[A-Za-z_]\w*|[()|?*+]")


class Tables:
    """Action and goto tables of a grammar; the first rule is the start."""

    def __init__(self, text: str, variant: str = ""):
        rules: dict[str, str] = {}
        for line in text.splitlines():
            mark = re.match(r"^([a-z]+)\| ", line)
            if mark and mark[1] != variant:
                continue
            name, _, body = line[mark.end() if mark else 0 :].partition(":")
            if body:
                rules[name] = f"{rules[name]} | {body}" if name in rules else body
        terms = {t.strip("'") for b in rules.values() for t in _TOK.findall(b) if t[0] == "'" or t.isupper() and t not in ("ANY", "KW")}
        self.terminals = frozenset(terms)
        prods: dict[str, set[tuple[str, ...]]] = {}
        helpers: dict[str, str] = {}
        heads = list(rules)

        def helper(alts: list[tuple[str, ...]], plus: bool) -> str:
            key = repr((sorted(alts), plus))
            if key not in helpers:
                name = helpers[key] = f"@{len(helpers)}"
                prods[name] = set(alts) | ({(name, *a) for a in alts} if plus else set())
            return helpers[key]

        def parse_alts(toks: list[str]) -> list[tuple[str, ...]]:
            out: list[tuple[str, ...]] = []
            seqs: list[tuple[str, ...]] = [()]
            while toks and toks[0] != ")":
                t = toks.pop(0)
                if t == "|":
                    out += seqs
                    seqs = [()]
                    continue
                if t == "(":
                    opts = parse_alts(toks)
                    toks.pop(0)
                elif t in ("ANY", "KW"):
                    opts = [("'" + x,) for x in sorted(terms - BRACKETS) if t == "ANY" or x.isalpha() and x.islower()]
                else:
                    opts = [("'" + t.strip("'"),)] if t[0] == "'" or t.isupper() else [(t,)]
                mark = toks.pop(0) if toks and toks[0] in "?*+" else ""
                if mark and mark in "*+":
                    opts = [(helper(opts, True),)]
                elif len(opts) > 2:
                    opts = [(helper(opts, False),)]
                if mark and mark in "?*":
                    opts = [(), *opts]
                seqs = [s + o for s in seqs for o in opts]
            return out + seqs

        for name in heads:
            prods.setdefault(name, set()).update(parse_alts(_TOK.findall(rules[name])))
        start = heads[0]
        self.prods: list[tuple[str, tuple[str, ...]]] = [("@start", (start,))]
        by: dict[str, list[int]] = {}
        for name in prods:
            for rhs in sorted(prods[name]):
                if rhs != (name,):
                    by.setdefault(name, []).append(len(self.prods))
                    self.prods.append((name, rhs))
        for _, rhs in self.prods:
            for s in rhs:
                assert s[0] == "'" or s in by, f"undefined rule {s}"
        self._build(by)

    def _build(self, by: dict[str, list[int]]) -> None:
        prods = self.prods
        empty: set[str] = set()
        first: dict[str, set[str]] = {n: set() for n in by}
        follow: dict[str, set[str]] = {n: set() for n in by}
        follow[prods[0][1][0]].add("")
        changed = True
        while changed:
            changed = False
            for name, rhs in prods[1:]:
                before = len(first[name]), name in empty
                for s in rhs:
                    first[name] |= {s[1:]} if s[0] == "'" else first[s]
                    if s[0] == "'" or s not in empty:
                        break
                else:
                    empty.add(name)
                changed |= before != (len(first[name]), name in empty)
        changed = True
        while changed:
            changed = False
            for name, rhs in prods[1:]:
                trail = follow[name]
                for s in reversed(rhs):
                    if s[0] == "'":
                        trail = {s[1:]}
                        continue
                    n = len(follow[s])
                    follow[s] |= trail
                    changed |= n != len(follow[s])
                    trail = trail | first[s] if s in empty else first[s]

        def closure(kernel: frozenset) -> list[tuple[int, int]]:
            out, seen = list(kernel), set()
            for p, d in out:
                rhs = prods[p][1]
                if d < len(rhs) and rhs[d][0] != "'" and rhs[d] not in seen:
                    seen.add(rhs[d])
                    out += [(q, 0) for q in by[rhs[d]] if (q, 0) not in kernel]
            return out

        states = {frozenset([(0, 0)]): 0}
        work = [frozenset([(0, 0)])]
        self.action: list[dict[str, tuple[int, ...]]] = []
        self.goto: list[dict[str, int]] = []
        for kernel in work:
            moves: dict[str, set] = {}
            act: dict[str, set[int]] = {}
            for p, d in closure(kernel):
                name, rhs = prods[p]
                if d < len(rhs):
                    moves.setdefault(rhs[d], set()).add((p, d + 1))
                elif p == 0:
                    act.setdefault("", set()).add(0)
                else:
                    for t in follow[name]:
                        act.setdefault(t, set()).add(-p)
            go: dict[str, int] = {}
            for s, k in moves.items():
                k = frozenset(k)
                if k not in states:
                    states[k] = len(states)
                    work.append(k)
                if s[0] == "'":
                    act.setdefault(s[1:], set()).add(states[k])
                else:
                    go[s] = states[k]
            self.action.append({t: tuple(sorted(a)) for t, a in act.items()})
            self.goto.append(go)
        self.lines: dict[tuple, list[tuple]] = {}  # what ``fits`` has learnt of lines
        self.nets: dict[tuple, list[tuple]] = {}
        self.once: set[tuple] = set()
        self.left = [p[0] for p in prods]
        self.size = [len(p[1]) for p in prods]
        # cells with one action: a shift, or (size, landings by state, rule, terminal) of a reduction
        self.single: list[dict] = [{t: a[0] if a[0] > 0 else (self.size[-a[0]], {}, self.left[-a[0]], t) for t, a in row.items() if len(a) == 1 and a[0] != 0} for row in self.action]

    def land(self, state: int, name: str, term: str) -> int:
        """State after reducing to a rule, past all reductions by one symbol that must follow before ``term``."""
        while True:
            s = self.goto[state][name]
            acts = self.action[s].get(term)
            if acts is None or len(acts) > 1 or acts[0] >= 0 or self.size[-acts[0]] != 1:
                return s
            name = self.left[-acts[0]]


def step(tables: Tables, heads: list[tuple], term: str) -> list[tuple] | None:
    """Heads after a token; None for acceptance at the end; empty if no stack survives."""
    action, left, size, land = tables.action, tables.left, tables.size, tables.land
    made: dict[tuple[int, int], tuple] = {}
    shifted: dict[tuple[int, int], tuple] = {}
    work = list(heads)
    for node in work:
        for a in action[node[0]].get(term, ()):
            if a > 0:
                shifted[a, id(node)] = (a, node)
            elif a == 0:
                return None
            else:
                base = node
                for _ in range(size[-a]):
                    base = base[1]
                s = land(base[0], left[-a], term)
                if (s, id(base)) not in made:
                    made[s, id(base)] = new = (s, base)
                    work.append(new)
    return list(shifted.values())


def advance(tables: Tables, heads: list[tuple], terms: tuple[str, ...], insert: str, broke: bool) -> tuple[list[tuple] | None, int]:
    """Heads after the terminals of one line and how many were taken; None after acceptance, empty heads at an error.

    ``broke``: whether a line break comes before the first of them. ``insert``: a terminal that may be put in before a
    token that follows a line break, or is a closing brace or the end, when it does not fit otherwise.
    """
    single, land = tables.single, tables.land
    for at, term in enumerate(terms):
        before, after = heads, None  # what is put in goes before any reduction made for the token
        if len(heads) == 1:  # deterministic as long as there is one action
            node = heads[0]
            while True:
                cell = single[node[0]].get(term)
                if cell.__class__ is int:
                    after = [(cell, node)]
                    break
                if cell is None:
                    heads = [node]
                    after = step(tables, heads, term)
                    break
                n, landing, name, _ = cell
                while n:
                    node = node[1]
                    n -= 1
                s = landing.get(node[0])
                if s is None:
                    s = landing[node[0]] = land(node[0], name, term)
                node = (s, node)
        else:
            after = step(tables, heads, term)
        if insert and broke and after and term in ("++", "--"):  # a line break may end the statement before these
            more = step(tables, before, insert)
            after = after + (step(tables, more, term) or [] if more else [])
        if not after and after is not None and insert and (broke or term in ("}", "")):
            more = step(tables, before, insert)
            after = step(tables, more, term) if more else []
        if not after:
            return after, at
        heads, broke = after, False
    return heads, len(terms)


class _Watched:
    """A stack node that writes down where a parse looks below the heads it began with."""

    __slots__ = ("state", "real", "book", "index", "up")

    def __init__(self, real: tuple, book: _Book):
        self.state, self.real, self.book, self.index, self.up = real[0], real, book, len(book.nodes), None
        book.nodes.append(self)
        book.by[id(real)] = self

    def __getitem__(self, i: int):
        if i == 0:
            return self.state
        if self.up is None and self.real[1] is not None:
            below = self.book.by.get(id(self.real[1]))
            fresh = below is None
            self.up = _Watched(self.real[1], self.book) if fresh else below
            self.book.log.append((self.index, self.up.index, self.up.state))
        return self.up


class _Book:
    """Nodes by number, and (node, node below it, its state) in the order in which they were looked at."""

    def __init__(self):
        self.nodes: list[_Watched] = []
        self.by: dict[int, _Watched] = {}
        self.log: list[tuple[int, int, int]] = []


LONGEST, LINES_KEPT = 80, 100_000


def _learn(tables: Tables, heads: list[tuple], key: tuple, insert: str) -> list[tuple] | None:
    """``advance`` by one line, remembered as what it looked at, the nodes it makes and the heads it leaves."""
    book = _Book()
    after, _ = advance(tables, [_Watched(h, book) for h in heads], key[0], insert, key[1])
    if not after:
        return after
    made: list[tuple[int, int]] = []
    number: dict[int, int] = {}

    def ref(n) -> int:
        """Number of a new node, or the complement of that of an old one."""
        if n.__class__ is _Watched:
            return ~n.index
        if id(n) not in number:
            below = ref(n[1])
            number[id(n)] = len(made)
            made.append((n[0], below))
        return number[id(n)]

    refs = [ref(h) for h in after]
    if len(tables.lines) + len(tables.nets) > LINES_KEPT:
        tables.lines.clear()
        tables.nets.clear()
    if len(heads) == len(refs) == 1 and all(b == k - 1 for k, (_, b) in enumerate(made) if k) and (not made or made[0][1] < 0):
        # one stack before and after: states below the head, how many nodes go, the states that come
        pops = ~made[0][1] if made else ~refs[0]
        tables.lines.setdefault(key, []).append((tuple(s for _, _, s in book.log), pops, tuple(s for s, _ in made)))
    else:
        tables.nets.setdefault(key, []).append((book.log, made, refs))
    return _replay([w.real for w in book.nodes], made, refs)


def _replay(nodes: list[tuple], made: list[tuple[int, int]], refs: list[int]) -> list[tuple]:
    new: list[tuple] = []
    for state, below in made:
        new.append((state, new[below] if below >= 0 else nodes[~below]))
    return [new[r] if r >= 0 else nodes[~r] for r in refs]


def fits(tables: Tables, lines: list[tuple[bool, tuple[str, ...]]], insert: str = "") -> bool:
    """Whether a stream is valid; ``lines`` are its terminals in pieces, each with whether a line break comes before it.

    What a piece does to the stacks depends on itself and on the few nodes it looks at; code repeats both all the time,
    so that is remembered.
    """
    heads: list[tuple] | None = [(0, None)]
    known, nets, once = tables.lines, tables.nets, tables.once
    for broke, seg in lines:
        if len(heads) == 1:
            head = heads[0]
            key = (seg, broke, head[0])
            for states, pops, push in known.get(key, ()):
                n = head
                for s in states:
                    n = n[1]
                    if n is None or n[0] != s:
                        break
                else:
                    while pops:
                        head = head[1]
                        pops -= 1
                    for s in push:
                        head = (s, head)
                    heads = [head]
                    break
            else:
                heads = _unknown(tables, nets, once, heads, key, insert)
        else:
            heads = _unknown(tables, nets, once, heads, (seg, broke, tuple([h[0] for h in heads])), insert)
        if heads is None:
            return True
        if not heads:
            return False
    return False


def _unknown(tables: Tables, nets: dict, once: set, heads: list[tuple], key: tuple, insert: str) -> list[tuple] | None:
    """Heads after a piece that is no single known step; what is seen once only is not worth remembering."""
    for log, made, refs in nets.get(key, ()):
        nodes = heads[:]
        for node, below, state in log:
            n = nodes[node][1]
            if below < len(nodes):
                if n is not nodes[below]:
                    break
            elif n is None or n[0] != state or len(heads) > 1 and any(n is x for x in nodes):
                break
            else:
                nodes.append(n)
        else:
            return _replay(nodes, made, refs)
    if len(key[0]) <= LONGEST:
        if key in once:
            return _learn(tables, heads, key, insert)
        if len(once) > LINES_KEPT:
            once.clear()
        once.add(key)
    return advance(tables, heads, key[0], insert, key[1])[0]


def recognise(tables: Tables, tokens: list[tuple[str, int, bool]], insert: str = "") -> int:
    """Line of the first token that no parse can take; 0 if the stream is valid.

    ``tokens`` are (terminal, line, line break before); ``insert`` as in ``advance``.
    """
    heads: list[tuple] | None = [(0, None)]
    line = 1
    for term, line, broke in tokens:
        heads, _ = advance(tables, heads, (term,), insert, broke)
        if heads is None:
            return 0
        if not heads:
            break
    return max(1, line)
