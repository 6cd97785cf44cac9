"""Table-driven predictive parser for grammars written as text.

A grammar has one rule a line: ``name = alternative | alternative``; ``x* x+ x?`` repeat, ``( )`` group, ``&x`` and
``!x`` look ahead. Terminals: ``'if'`` is a token of that kind, ``"of"`` a name with that text, ``UPPER`` a kind such as
NAME, ``%nl`` a line break before the token, ``%word`` any word. A line that starts with ``@`` is remembered per place
(each place is tried once), which keeps backtracking linear.

From the FIRST sets of its alternatives every choice gets a table: kind of the next token -> the alternatives
that can begin with it, in order. Parsing looks the token up and tries those only.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

Node = tuple
_SYNTAX = re.compile(r"\s*(?:(?P<lit>'[^']+')|(?P<text>\"[^\"]+\")|(?P<name>%?[A-Za-z_][A-Za-z_0-9]*)|(?P<op>[|()*+?&!]))")
ANY = "\0any"
#: Nested calls that the quick way may take; beyond them :meth:`Parser.run_program` parses with a stack of its own.
MOST_CALLS = 20_000


def _read(text: str) -> Node:
    """The syntax tree of the right side of a rule."""
    tokens: list[tuple[str, str]] = []
    at = 0
    text = text.rstrip()
    while at < len(text):
        m = _SYNTAX.match(text, at)
        if not m:
            raise ValueError(f"bad grammar text: {text[at:at + 40]!r}")
        tokens.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    pos = 0

    def choice() -> Node:
        nonlocal pos
        alts = [sequence()]
        while pos < len(tokens) and tokens[pos] == ("op", "|"):
            pos += 1
            alts.append(sequence())
        return alts[0] if len(alts) == 1 else ("alt", alts)

    def sequence() -> Node:
        nonlocal pos
        parts = []
        while pos < len(tokens) and tokens[pos] not in (("op", "|"), ("op", ")")):
            parts.append(item())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def item() -> Node:
        nonlocal pos
        kind, value = tokens[pos]
        pos += 1
        if kind == "op" and value in "&!":
            return ("ahead" if value == "&" else "not", item())
        if kind == "op" and value == "(":
            node = choice()
            pos += 1
        elif kind == "lit":
            node = ("kind", value[1:-1])
        elif kind == "text":
            node = ("text", value[1:-1])
        elif value == "%nl":
            node = ("nl",)
        elif value == "%word":
            node = ("word",)
        elif value.isupper():
            node = ("kind", value)
        else:
            node = ("rule", value)
        while pos < len(tokens) and tokens[pos][0] == "op" and tokens[pos][1] in "*+?":
            node = ({"*": "star", "+": "plus", "?": "opt"}[tokens[pos][1]], node)
            pos += 1
        return node

    return choice()


class Tokens:
    """kinds, texts, line breaks before, and offsets of a lexed text; ends with EOF."""

    __slots__ = ("kinds", "texts", "breaks", "places")

    def __init__(self) -> None:
        self.kinds: list[str] = []
        self.texts: list[str] = []
        self.breaks: list[bool] = []
        self.places: list[int] = []

    def put(self, kind: str, text: str, broke: bool, place: int) -> None:
        self.kinds.append(kind)
        self.texts.append(text)
        self.breaks.append(broke)
        self.places.append(place)


class LexError(Exception):
    def __init__(self, place: int) -> None:
        super().__init__(place)
        self.place = place


class Parser:
    def __init__(self, grammar: str, start: str) -> None:
        self.rules: dict[str, Node] = {}
        self.remembered: set[str] = set()
        joined = re.sub(r"\n[ \t]+", " ", grammar)
        for line in joined.split("\n"):
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            name, _, body = line.partition(" = ")
            if name.startswith("@"):
                name = name[1:]
                self.remembered.add(name)
            self.rules[name] = _read(body)
        self._first: dict[str, tuple[frozenset, bool]] = {n: (frozenset(), False) for n in self.rules}
        changed = True
        while changed:
            changed = False
            for n, node in self.rules.items():
                got = self.first(node)
                if got != self._first[n]:
                    self._first[n] = got
                    changed = True
        self.kinds: list[str] = []
        self.texts: list[str] = []
        self.breaks: list[bool] = []
        self.far = [0]
        self.memo: dict[tuple[str, int], int] = {}
        self._made: dict[str, Callable[[int], int]] = {}
        self.first_rule = start
        self._code: list[list] = []
        self.start = self._rule(start)

    def first(self, node: Node) -> tuple[frozenset, bool]:
        """(kinds a node can begin with, whether it can be empty)."""
        tag = node[0]
        if tag == "kind":
            return frozenset([node[1]]), False
        if tag == "text":
            return frozenset(["NAME"]), False
        if tag == "word":
            return frozenset([ANY]), False
        if tag in ("nl", "ahead", "not"):
            return frozenset(), True
        if tag == "rule":
            return self._first[node[1]]
        if tag == "seq":
            out: frozenset = frozenset()
            for p in node[1]:
                f, empty = self.first(p)
                out |= f
                if not empty:
                    return out, False
            return out, True
        if tag == "alt":
            firsts = [self.first(p) for p in node[1]]
            return frozenset().union(*(f for f, _ in firsts)), any(e for _, e in firsts)
        f, empty = self.first(node[1])
        return f, empty or tag in ("star", "opt")

    def _rule(self, name: str) -> Callable[[int], int]:
        if name in self._made:
            return self._made[name]
        made: list[Callable[[int], int]] = []
        memo = self.memo
        if name in self.remembered:

            def run(i: int) -> int:
                key = (name, i)
                got = memo.get(key)
                if got is None:
                    got = memo[key] = made[0](i)
                return got

        else:

            def run(i: int) -> int:
                return made[0](i)

        self._made[name] = run
        made.append(self._make(self.rules[name]))
        if name not in self.remembered:
            self._made[name] = made[0]
        return self._made[name]

    def _make(self, node: Node) -> Callable[[int], int]:
        kinds, texts, breaks, far = self.kinds, self.texts, self.breaks, self.far
        tag = node[0]
        if tag == "kind":
            want = node[1]

            def one(i: int) -> int:
                if kinds[i] == want:
                    return i + 1
                if i > far[0]:
                    far[0] = i
                return -1

            return one
        if tag == "text":
            want = node[1]

            def named(i: int) -> int:
                if texts[i] == want and kinds[i] == "NAME":
                    return i + 1
                if i > far[0]:
                    far[0] = i
                return -1

            return named
        if tag == "word":

            def word(i: int) -> int:
                if kinds[i] == "NAME" or kinds[i] != "EOF" and kinds[i].isidentifier() and kinds[i].islower():
                    return i + 1
                if i > far[0]:
                    far[0] = i
                return -1

            return word
        if tag == "nl":
            return lambda i: i if breaks[i] else -1
        if tag == "ahead":
            f = self._make(node[1])
            return lambda i: i if f(i) >= 0 else -1
        if tag == "not":
            f = self._make(node[1])
            return lambda i: -1 if f(i) >= 0 else i
        if tag == "rule":
            if node[1] not in self.rules:
                raise ValueError(f"no rule {node[1]}")
            if node[1] in self._made:
                return self._made[node[1]]
            return self._rule(node[1])
        if tag == "seq":
            parts = [self._make(p) for p in node[1]]
            if not parts:
                return lambda i: i
            if len(parts) == 2:
                a, b = parts

                def two(i: int) -> int:
                    i = a(i)
                    return b(i) if i >= 0 else -1

                return two

            def seq(i: int) -> int:
                for p in parts:
                    i = p(i)
                    if i < 0:
                        return -1
                return i

            return seq
        if tag == "alt":
            made = [self._make(p) for p in node[1]]
            firsts = [self.first(p) for p in node[1]]
            loose = tuple(m for m, (f, e) in zip(made, firsts) if e or ANY in f)
            named = {k for f, _ in firsts for k in f if k != ANY}
            table = {k: tuple(m for m, (f, e) in zip(made, firsts) if e or k in f or ANY in f) for k in named}

            def alt(i: int) -> int:
                for a in table.get(kinds[i], loose):
                    j = a(i)
                    if j >= 0:
                        return j
                if i > far[0]:
                    far[0] = i
                return -1

            return alt
        f = self._make(node[1])
        starts, empty = self.first(node[1])
        guard = None if empty or ANY in starts else starts
        if tag == "opt":

            def opt(i: int) -> int:
                if guard is not None and kinds[i] not in guard:
                    if i > far[0]:
                        far[0] = i
                    return i
                j = f(i)
                return j if j >= 0 else i

            return opt

        def star(i: int) -> int:
            while guard is None or kinds[i] in guard:
                j = f(i)
                if j < 0 or j == i:
                    return i
                i = j
            if i > far[0]:
                far[0] = i
            return i

        if tag == "star":
            return star

        def plus(i: int) -> int:
            i = f(i)
            return star(i) if i >= 0 else -1

        return plus

    def parse(self, tokens: Tokens) -> int | None:
        """None if the grammar takes the whole stream, else the offset of the first token it can't go past.

        What is nested too deeply for calls is parsed by the same grammar as a program with a stack of its own.
        """
        self.kinds[:] = tokens.kinds
        self.texts[:] = tokens.texts
        self.breaks[:] = tokens.breaks
        self.far[0] = 0
        self.memo.clear()
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, MOST_CALLS))
        try:
            end = self.start(0)
        except RecursionError:
            self.far[0] = 0
            self.memo.clear()
            end = self.run_program()
        finally:
            sys.setrecursionlimit(limit)
            self.memo.clear()
        return None if end >= 0 else tokens.places[min(self.far[0], len(tokens.places) - 1)]

    def _program(self) -> list[list]:
        """The grammar as instructions; the rule the parser starts with comes first."""
        if self._code:
            return self._code
        code: list[list] = [["call", self.first_rule], ["end"]]
        at: dict[str, int] = {}

        def put(node: Node) -> None:
            tag = node[0]
            if tag in ("kind", "text", "word", "nl"):
                code.append([tag, *node[1:]])
            elif tag == "rule":
                code.append(["call", node[1]])
            elif tag == "seq":
                for x in node[1]:
                    put(x)
            elif tag == "alt":
                op = ["alt", {}, ()]
                code.append(op)
                starts, ends = [], []
                for x in node[1]:
                    starts.append(len(code))
                    put(x)
                    ends.append(["commit", 0])
                    code.append(ends[-1])
                for e in ends:
                    e[1] = len(code)
                firsts = [self.first(x) for x in node[1]]
                op[2] = tuple(p for p, (f, e) in zip(starts, firsts) if e or ANY in f)
                for k in {k for f, _ in firsts for k in f if k != ANY}:
                    op[1][k] = tuple(p for p, (f, e) in zip(starts, firsts) if e or k in f or ANY in f)
            elif tag in ("opt", "star", "plus"):
                if tag == "plus":
                    put(node[1])
                op = ["choice", 0]
                code.append(op)
                body = len(code)
                put(node[1])
                code.append(["commit", len(code) + 1] if tag == "opt" else ["again", body])
                op[1] = len(code)
            else:  # ahead, not
                op = ["choice", 0]
                code.append(op)
                put(node[1])
                code.append(["seen" if tag == "ahead" else "unwanted", len(code) + 2])
                op[1] = len(code)
                if tag == "ahead":
                    code.append(["fail"])

        for name, node in self.rules.items():
            at[name] = len(code)
            put(node)
            code.append(["return"])
        for op in code:
            if op[0] == "call":
                op.append(at[op[1]])
        self._code = code
        return code

    def run_program(self) -> int:
        """The whole stream by the instructions: the end, or -1. The stack is a list, so depth is bounded by memory only."""
        code, kinds, texts, breaks, far, memo = self._program(), self.kinds, self.texts, self.breaks, self.far, self.memo
        stack: list[list] = []  # ["back", instruction, place], ["alts", alternatives, next, place], ["from", instruction, memo key]
        pc = i = 0
        while True:
            op = code[pc]
            tag = op[0]
            ok = True
            if tag == "kind":
                ok = kinds[i] == op[1]
                i, pc = i + ok, pc + 1
            elif tag == "text":
                ok = texts[i] == op[1] and kinds[i] == "NAME"
                i, pc = i + ok, pc + 1
            elif tag == "word":
                ok = kinds[i] == "NAME" or kinds[i] != "EOF" and kinds[i].isidentifier() and kinds[i].islower()
                i, pc = i + ok, pc + 1
            elif tag == "nl":
                ok, pc = breaks[i], pc + 1
            elif tag == "call":
                key = (op[1], i) if op[1] in self.remembered else None
                got = memo.get(key) if key else None
                if got is None:
                    stack.append(["from", pc + 1, key])
                    pc = op[2]
                elif got >= 0:
                    i, pc = got, pc + 1
                else:
                    ok = False
            elif tag == "return":
                _, pc, key = stack.pop()
                if key:
                    memo[key] = i
            elif tag == "alt":
                alts = op[1].get(kinds[i], op[2])
                ok = bool(alts)
                if ok:
                    stack.append(["alts", alts, 1, i])
                    pc = alts[0]
            elif tag == "choice":
                stack.append(["back", op[1], i])
                pc += 1
            elif tag == "commit":
                stack.pop()
                pc = op[1]
            elif tag == "again":
                if stack[-1][2] == i:
                    stack.pop()
                    pc += 1
                else:
                    stack[-1][2] = i
                    pc = op[1]
            elif tag == "seen":
                i = stack.pop()[2]
                pc = op[1]
            elif tag == "unwanted":
                i = stack.pop()[2]
                ok = False
            elif tag == "fail":
                ok = False
            else:
                return i
            if ok:
                continue
            if i > far[0]:
                far[0] = i
            while stack:
                top = stack[-1]
                if top[0] == "back":
                    stack.pop()
                    pc, i = top[1], top[2]
                    break
                if top[0] == "alts" and top[2] < len(top[1]):
                    pc, i = top[1][top[2]], top[3]
                    top[2] += 1
                    break
                stack.pop()
                if top[0] == "from" and top[2]:
                    memo[top[2]] = -1
            else:
                return -1
