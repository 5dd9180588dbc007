"""Packrat recognisers from parsing-expression grammars.

A grammar is a list of rules ``Name <- expression``; a rule goes on until the next ``<-``. Expressions:

    'x'   a token: a word, or an operator that is no prefix of a longer one of ``operators`` here
    "x"   these characters, whatever follows
    /r/   a regular expression
    a b   sequence      a | b  ordered choice      * + ?  repetition      & !  look-ahead      ( )  group
    @name(a)  within ``a`` the context ``name`` holds;  ?name  succeeds where it does
    ^nl   a line end stands before;  ^!nl  none does
    $Name  a rule that is one token, whose text is held within the rule around it;  =Name  the same token with the held text
    ~Name  the same token with the text that was held where the ``cls`` context around it began

After each token white space and comments are skipped. Each rule becomes a Python function from position to position (-1:
no match), with its results kept by position, so no rule is tried twice at one place. A text is accepted if the first rule
consumes all of it; otherwise the furthest position at which a token was wanted is where it fails.

Contexts: ``fn`` and ``class`` bodies begin without the surrounding ``loop`` and ``switch``. They depend on the position
alone (what encloses it), so results kept by position stay right.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_LEX = re.compile(
    r"""\s+|\#[^\n]*|(?P<arrow><-)|(?P<tok>'(?:[^'\\]|\\.)*')|(?P<raw>"(?:[^"\\]|\\.)*")|(?P<re>/(?:[^/\\]|\\.)+/)"""
    r"""|(?P<nl>\^!?nl)|(?P<ctx>@[a-z]+)|(?P<has>\?[a-z]+)|(?P<hold>[$=~])|(?P<op>[|*+?&!()])|(?P<name>[A-Za-z_]\w*)"""
)


#: Characters of finished items after which the results kept for them are dropped.
KEEP = 20_000


@dataclass(frozen=True)
class Verdict:
    ok: bool
    position: int


class Grammar:
    def __init__(self, text: str, *, trivia: str, operators: str = "", words: str = r"[\w$]"):
        self.trivia, self.operators, self.word = trivia, operators.split(), words
        self.rules: dict[str, list] = {}
        self.terminals: dict[str, int] = {}
        self.bare: dict[int, str] = {}
        self._read(text)
        for name in self._used:
            if name not in self.rules:
                raise ValueError(f"no rule {name}")
        self._simplify()
        self._skip = re.compile(f"(?:{self.trivia})*+").match
        self._uses: dict[str, int] = {}
        self._parsers: dict = {}

    # reading ------------------------------------------------------------------------------------------------------

    def _read(self, text: str) -> None:
        toks, at = [], 0
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at : at + 40]!r}")
            at = m.end()
            if m.lastgroup:
                toks.append((m.lastgroup, m.group()))
        self._used: set[str] = set()
        self._t, self._i = toks, 0
        while self._i < len(toks):
            name = toks[self._i][1]
            if toks[self._i + 1][0] != "arrow":
                raise ValueError(f"grammar: <- after {name}")
            self._i += 2
            if name in self.rules:
                raise ValueError(f"rule {name} twice")
            self.rules[name] = self._choice()
        self.first = next(iter(self.rules))

    def _peek(self):
        if self._i >= len(self._t):
            return None, None
        if self._t[self._i][0] == "name" and self._i + 1 < len(self._t) and self._t[self._i + 1][0] == "arrow":
            return None, None
        return self._t[self._i]

    def _choice(self) -> tuple:
        alts = [self._sequence()]
        while self._peek() == ("op", "|"):
            self._i += 1
            alts.append(self._sequence())
        return alts[0] if len(alts) == 1 else ("alt", alts)

    def _sequence(self) -> tuple:
        items = []
        while True:
            kind, val = self._peek()
            if kind is None or (kind == "op" and val in "|)"):
                break
            items.append(self._repeat())
        return items[0] if len(items) == 1 else ("seq", items)

    def _repeat(self) -> tuple:
        kind, val = self._peek()
        if kind == "op" and val in "&!":
            self._i += 1
            return ("and" if val == "&" else "not", self._repeat())
        item = self._atom()
        while (p := self._peek())[0] == "op" and p[1] in "*+?":
            self._i += 1
            item = ({"*": "star", "+": "plus", "?": "opt"}[p[1]], item)
        return item

    def _atom(self) -> tuple:
        kind, val = self._t[self._i]
        self._i += 1
        if kind == "op" and val == "(":
            item = self._choice()
            if self._t[self._i] != ("op", ")"):
                raise ValueError(f"grammar: ) wanted, {self._t[self._i]}")
            self._i += 1
            return item
        if kind == "name":
            self._used.add(val)
            return ("rule", val)
        if kind == "ctx":
            item = self._atom()
            return ("ctx", val[1:], item)
        if kind == "has":
            return ("has", val[1:])
        if kind == "hold":
            return ({"$": "hold", "=": "same", "~": "own"}[val], self._atom())
        if kind == "nl":
            return ("nl", val == "^nl")
        return ("term", self._terminal(kind, val))

    def _terminal(self, kind: str, val: str) -> int:
        body = val[1:-1]
        if kind == "re":
            rx = body.replace("\\/", "/")
        else:
            body = body.replace("\\'", "'").replace("\\\\", "\\")
            rx = re.escape(body)
            if kind == "tok":
                if re.match(r"\w", body[-1]):
                    rx += f"(?!{self.word})"
                else:
                    longer = [re.escape(o[len(body) :]) for o in self.operators if o.startswith(body) and o != body]
                    if longer:
                        rx += f"(?!{'|'.join(longer)})"
        return self._numbered(rx)

    def _numbered(self, bare: str) -> int:
        # most tokens are followed by one space or none; the general form is for the others
        rx = rf"(?:{bare})(?: ?+(?![\s/\\\ufeff{'#' * ('#' in self.trivia)}])|(?:{self.trivia})*+)"
        i = self.terminals.setdefault(rx, len(self.terminals))
        self.bare[i] = bare
        return i

    def _simplify(self) -> None:
        """Write rules of one token in place of their names, and neighbouring tokens of a choice as one pattern: white space
        behind a token always matches, so a pattern's ordered alternatives choose as the grammar's do."""

        def plain(e: tuple) -> bool:
            return e[0] == "term" and re.compile(self.bare[e[1]]).groups == 0

        seen: set[str] = set()

        def rule(name: str) -> tuple:
            if name not in seen:
                seen.add(name)
                self.rules[name] = simple(self.rules[name])
            return self.rules[name]

        def simple(e: tuple) -> tuple:
            kind = e[0]
            if kind == "rule":
                own = rule(e[1])
                return own if own[0] == "term" and e[1] != self.first else e
            if kind == "seq":
                return ("seq", [simple(x) for x in e[1]])
            if kind == "alt":
                out: list[tuple] = []
                for x in e[1]:
                    x = simple(x)
                    if out and plain(x) and plain(out[-1]):
                        x = ("term", self._numbered(f"(?:{self.bare[out.pop()[1]]})|(?:{self.bare[x[1]]})"))
                    out.append(x)
                return out[0] if len(out) == 1 else ("alt", out)
            if kind in ("star", "plus", "opt", "and", "not"):
                return (kind, simple(e[1]))
            if kind == "ctx":
                return (kind, e[1], simple(e[2]))
            return e

        for name in self.rules:
            rule(name)

    # generating ---------------------------------------------------------------------------------------------------

    def _first(self, e: tuple, busy: frozenset = frozenset()) -> frozenset | None:
        """The ASCII characters a match of ``e`` can begin with; None if that isn't known or ``e`` can be empty."""
        kind = e[0]
        if kind == "term":
            return _first_of_pattern(self._patterns[e[1]])
        if kind == "rule":
            if e[1] in busy:
                return None
            if e[1] not in self._firsts:
                self._firsts[e[1]] = self._first(self.rules[e[1]], busy | {e[1]})
            return self._firsts[e[1]]
        if kind == "seq":
            for item in e[1]:
                if item[0] in ("and", "not", "nl", "has"):
                    continue
                own = self._first(item[1] if item[0] in ("opt", "star") else item, busy)
                if item[0] not in ("opt", "star"):
                    return own
                rest = self._first(("seq", e[1][e[1].index(item) + 1 :]), busy)
                return own | rest if own is not None and rest is not None else None
            return None
        if kind == "alt":
            sets = [self._first(x, busy) for x in e[1]]
            return None if None in sets else frozenset().union(*sets)
        if kind in ("plus", "hold", "same", "own"):
            return self._first(e[1], busy)
        if kind == "ctx":
            return self._first(e[2], busy)
        return None

    def _sites(self, rule: str) -> int:
        """The number of places in the grammar that use ``rule``; many where it is used inside itself."""
        if not self._uses:

            def walk(e: tuple, inside: str) -> None:
                if e[0] == "rule":
                    self._uses[e[1]] = self._uses.get(e[1], 0) + (1 if e[1] != inside else 99)
                elif e[0] in ("seq", "alt"):
                    for x in e[1]:
                        walk(x, inside)
                elif e[0] in ("star", "plus", "opt", "and", "not", "hold", "same", "own"):
                    walk(e[1], inside)
                elif e[0] == "ctx":
                    walk(e[2], inside)

            for name, e in self.rules.items():
                walk(e, name)
        return self._uses.get(rule, 0)

    def _guard(self, e: tuple, c: str) -> str | None:
        """A test of the next character ``c`` that rules ``e`` out, before its terminals are tried; characters beyond ASCII pass."""
        chars = self._first(e)
        if chars is None or len(chars) > 90:
            return None
        if len(chars) == 1 and self._ascii:
            return f"{c} == {next(iter(chars))!r}"
        name = self._sets.setdefault(chars, f"S{len(self._sets)}")
        return f"{c} in {name}" if self._ascii else f"({c} in {name} or {c} > '~')"

    def _parser(self, track: bool, ascii_only: bool):
        """The generated parser; for texts of ASCII alone one with cheaper tests, with ``track`` the one that notes failures."""
        if (track, ascii_only) not in self._parsers:
            self._ascii = ascii_only
            self._parsers[track, ascii_only] = self._compile(track)
        return self._parsers[track, ascii_only]

    def _compile(self, track: bool):
        self._n, out = 0, []
        self._firsts: dict = {}
        self._sets: dict = {}
        self._held: set[int] = set()
        self._patterns = {i: rx for rx, i in self.terminals.items()}
        for rule in self.rules:
            out.append(f"    M_{rule} = {{}}")
        for rule, expr in self.rules.items():
            # a rule with one place of use is tried once for each try of the rule around it, whose results are kept
            simple = expr[0] == "term" or (self._sites(rule) == 1 and rule != self.first)
            out.append(f"    def r_{rule}(p):")
            if not simple:
                out += [f"        q = M_{rule}.get(p)", "        if q is not None: return q", f"        M_{rule}[p] = -1"]
            self._top, self._holds = rule == self.first, False
            self._emit(expr, "p", "q", 2, out, track)
            out += ([] if simple else [f"        M_{rule}[p] = q"]) + ["        return q"]
        source = [
            "def build(T, B, S, nl):",
            *[f"    T{i} = T[{i}]" for i in range(len(self.terminals))],
            *[f"    {name} = S[{name!r}]" for name in self._sets.values()],
            "    s, n, far, kept = '', 0, 0, 0",
            "    fn = loop = switch = cls = 0",
            *out,
            f"    memos = ({', '.join(f'M_{r}' for r in self.rules)},)",
            "    def parse(text, begin):",
            "        nonlocal s, n, far, kept, fn, loop, switch, cls",
            # one more character, so that the next one can always be looked at; patterns end before it
            "        s, n, far, kept = text + '\\0', len(text), begin, begin",
            "        fn = loop = switch = cls = 0",
            "        try:",
            f"            return r_{self.first}(begin), far",
            "        finally:",
            "            s = ''",
            "            for d in memos: d.clear()",
            "    return parse",
        ]
        text = "\n".join(source)
        text = re.sub(r"(    def r_\w+\(p\):\n)", r"\1        nonlocal far, kept, fn, loop, switch, cls\n", text)
        env: dict = {}
        exec(compile(text, "<grammar>", "exec"), env)  # noqa: S102
        every = {name: chars for chars, name in self._sets.items()}
        bare = {i: re.compile(self.bare[i]).match for i in self._held}
        return env["build"]([re.compile(rx).match for rx in self.terminals], bare, every, line_end_before)

    def _var(self) -> str:
        self._n += 1
        return f"v{self._n}"

    def _emit(self, e: tuple, p: str, q: str, d: int, out: list[str], track: bool) -> None:
        pad, kind = "    " * d, e[0]
        if kind == "term":
            out.append(f"{pad}m = T{e[1]}(s, {p}, n)")
            if track:
                out.append(f"{pad}if m: {q} = m.end()\n{pad}else:\n{pad}    {q} = -1\n{pad}    if {p} > far: far = {p}")
            else:
                out.append(f"{pad}{q} = m.end() if m else -1")
        elif kind == "rule":
            out.append(f"{pad}{q} = r_{e[1]}({p})")
        elif kind == "seq":
            at = p
            if not e[1]:
                out.append(f"{pad}{q} = {p}")
            for i, item in enumerate(e[1]):
                to = q if i == len(e[1]) - 1 else self._var()
                if i:
                    out.append(f"{'    ' * d}{q} = -1")
                    out.append(f"{'    ' * d}if {at} >= 0:")
                    d += 1
                self._emit(item, at, to, d, out, track)
                at = to
        elif kind == "alt":
            start, c = self._var(), self._var()
            out.append(f"{pad}{start} = {p}")
            out.append(f"{pad}{q} = -1")
            guards = [None if track else self._guard(item, c) for item in e[1]]
            if any(guards):
                out.append(f"{pad}{c} = s[{start}]")
            for i, item in enumerate(e[1]):
                tests = [f"{q} < 0"] if i else []
                if guards[i]:
                    tests.append(guards[i])
                if tests:
                    out.append(f"{pad}if {' and '.join(tests)}:")
                self._emit(item, start, q, d + bool(tests), out, track)
        elif kind in ("star", "plus", "opt"):
            cur, nxt = self._var(), self._var()
            out.append(f"{pad}{cur} = {p}")
            guard = None if track else self._guard(e[1], f"s[{cur}]")
            if kind == "opt":
                if guard:
                    out += [f"{pad}{nxt} = -1", f"{pad}if {guard}:"]
                self._emit(e[1], cur, nxt, d + bool(guard), out, track)
                out.append(f"{pad}{q} = {nxt} if {nxt} >= 0 else {cur}")
                return
            base = self._var()
            out += [f"{pad}{base} = {cur}", f"{pad}while {guard or 'True'}:"]
            self._emit(e[1], cur, nxt, d + 1, out, track)
            out += [f"{pad}    if {nxt} < 0 or {nxt} == {cur}: break", f"{pad}    {cur} = {nxt}"]
            if self._top:
                # what is behind a finished item of the whole is never looked at again
                out += [f"{pad}    if {cur} - kept > {KEEP}:", f"{pad}        kept = {cur}", f"{pad}        for d in memos: d.clear()"]
            out.append(f"{pad}{q} = {cur}" + (f" if {cur} > {base} else -1" if kind == "plus" else ""))
        elif kind in ("and", "not"):
            start, got = self._var(), self._var()
            out.append(f"{pad}{start} = {p}")
            self._emit(e[1], start, got, d, out, False)
            out.append(f"{pad}{q} = {start} if {got} {'>=' if kind == 'and' else '<'} 0 else -1")
        elif kind == "ctx":
            keep, start = self._var(), self._var()
            out.append(f"{pad}{start} = {p}; {keep} = (fn, loop, switch, cls)")
            out.append(pad + {"fn": "fn = 1; loop = switch = 0", "cls": f"cls = {'held' if self._holds else 1}; fn = loop = switch = 0", "loop": "loop += 1", "switch": "switch += 1"}[e[1]])
            self._emit(e[2], start, q, d, out, track)
            out.append(f"{pad}fn, loop, switch, cls = {keep}")
        elif kind == "has":
            test = {"fn": "fn", "loop": "loop", "brk": "loop or switch"}[e[1]]
            out.append(f"{pad}{q} = {p} if {test} else -1")
        elif kind in ("hold", "same", "own"):
            i = self.rules[e[1][1]][1]
            self._held.add(i)
            self._emit(e[1], p, q, d, out, track)
            if kind == "hold":
                self._holds = True
                out.append(f"{pad}if {q} >= 0: held = B[{i}](s, {p}, n)[0]")
            else:
                out.append(f"{pad}if {q} >= 0 and B[{i}](s, {p}, n)[0] != {'held' if kind == 'same' else 'cls'}:\n{pad}    {q} = -1")
                if track:
                    out.append(f"{pad}    if {p} > far: far = {p}")
        elif kind == "nl":
            out.append(f"{pad}{q} = {p} if {'' if e[1] else 'not '}nl(s, {p}) else -1")
        else:
            raise AssertionError(kind)

    # running ------------------------------------------------------------------------------------------------------

    def check(self, text: str) -> Verdict:
        """Whether all of ``text`` is a sentence of the grammar, and else the furthest position reached."""
        begin = self._skip(text).end()
        end, _ = self._parser(False, text.isascii())(text, begin)
        if end == len(text):
            return Verdict(True, end)
        end, far = self._parser(True, False)(text, begin)
        return Verdict(False, max(end, far))


def _first_of_pattern(pattern: str) -> frozenset | None:
    """The ASCII characters a regular expression can match first; None if it can match the empty string or isn't understood."""
    from re import _parser as sre

    every = frozenset(map(chr, range(128)))

    def of(items) -> tuple[frozenset, bool]:
        got: frozenset = frozenset()
        for op, arg in items:
            name = str(op)
            if name in ("ASSERT", "ASSERT_NOT", "AT"):
                continue
            if name == "LITERAL":
                one, empty = frozenset(chr(arg)), False
            elif name in ("NOT_LITERAL", "ANY", "GROUPREF", "CATEGORY", "GROUPREF_EXISTS"):
                one, empty = every, name == "GROUPREF"
            elif name == "IN":
                rx = re.compile(_class_of(arg))
                one, empty = frozenset(c for c in every if rx.fullmatch(c)), False
            elif name == "BRANCH":
                parts = [of(x) for x in arg[1]]
                one, empty = frozenset().union(*(p[0] for p in parts)), any(p[1] for p in parts)
            elif name == "SUBPATTERN":
                one, empty = of(arg[3])
            elif name == "ATOMIC_GROUP":
                one, empty = of(arg)
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                one, empty = of(arg[2])
                empty = empty or arg[0] == 0
            else:
                return every, True
            got |= one
            if not empty:
                return got, False
        return got, True

    chars, empty = of(sre.parse(pattern))
    return None if empty else chars


def _class_of(items) -> str:
    """A character class as parsed back into a pattern."""
    out = ""
    for op, arg in items:
        name = str(op)
        if name == "NEGATE":
            out += "^"
        elif name == "LITERAL":
            out += re.escape(chr(arg))
        elif name == "RANGE":
            out += f"{re.escape(chr(arg[0]))}-{re.escape(chr(arg[1]))}"
        elif name == "CATEGORY":
            out += {"CATEGORY_DIGIT": r"\d", "CATEGORY_NOT_DIGIT": r"\D", "CATEGORY_SPACE": r"\s", "CATEGORY_NOT_SPACE": r"\S", "CATEGORY_WORD": r"\w", "CATEGORY_NOT_WORD": r"\W"}[str(arg)]
    return f"[{out}]"


def line_end_before(s: str, p: int) -> bool:
    """Whether a line end stands between the token before ``p`` and ``p``."""
    j = p
    while j and s[j - 1] in " \t\f\v﻿\xa0":
        j -= 1
    if j == 0 or s[j - 1] in "\r\n  ":
        return True
    if s.endswith("*/", 0, j):
        k = s.rfind("/*", 0, j - 2)
        return k >= 0 and ("\n" in s[k:j] or line_end_before(s, k))
    return False
