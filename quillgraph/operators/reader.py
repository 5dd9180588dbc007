"""Readers of source texts: what a file declares, imports and calls.

Python is read through its own syntax tree. All other languages go through one scanner: a text becomes tokens once, brackets
are matched once, and a single pass over the tokens keeps a stack of open scopes; a table tells for each language which
words declare types and functions. Languages with ``end`` or indentation have their block ends found first, and then take
the same pass. Time is linear in the text.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import json
import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

SNIPPET_LINES = 60


def _sha(*parts) -> str:
    return hashlib.sha1(("".join(map(str, parts)) + "\0").encode("utf-8", "surrogatepass")).hexdigest()[:20]


class Parsed:
    """The nodes, edges and call sites of one file."""

    def __init__(self, path: str, language: str, text: str):
        self.path, self.language = path, language
        self.lines = re.split(r"\r?\n", text)
        self.nodes: list[tuple] = []
        self.edges: list[tuple] = []
        self.sites: list[tuple] = []
        self.file_id = _sha(path, "file", path, 0)
        self.nodes.append((self.file_id, "file", path, path, language, 1, len(self.lines), None, None, None))

    def symbol(self, kind: str, name: str, start: int, end: int, parent: str | None = None, supers: list[str] | None = None, imported: bool = False) -> str:
        qualified = f"{parent}.{name}" if parent else name
        nid = _sha(self.path, kind, qualified, start)
        body = self.lines[start - 1 : end]
        snippet = None
        if not imported:
            cut = body[:SNIPPET_LINES] + (["// … truncated …"] if len(body) > SNIPPET_LINES else [])
            snippet = "\n".join(cut)
        meta = {k: v for k, v in (("parent", parent), ("supers", supers)) if v}
        self.nodes.append((nid, kind, name, self.path, self.language, start, end, self.lines[start - 1].strip()[:200], snippet, json.dumps(meta) if meta else None))
        rel = "imports" if imported else "contains"
        self.edges.append((_sha(rel, self.file_id, nid), rel, self.file_id, nid, 1.0, self.path))
        return nid

    def call(self, caller: str, callee: str, receiver: str | None, line: int) -> None:
        self.sites.append((self.path, caller, callee, receiver, line))


class Reader(Protocol):
    """Adds to ``out`` what ``text`` declares; False if it can't read the text, which then goes to the scanner."""

    def __call__(self, out: Parsed, text: str) -> bool: ...


# Python --------------------------------------------------------------------------------------------------------------------


def read_python(out: Parsed, text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False

    def dotted(e: ast.expr) -> str | None:
        try:
            return ast.unparse(e)
        except RecursionError:
            return None

    stack: list[tuple[ast.AST, str | None, str | None]] = [(tree, None, None)]
    while stack:
        node, cls, func = stack.pop()
        inner_cls, inner_func = cls, func
        if isinstance(node, ast.ClassDef):
            supers = [s.partition("[")[0].rpartition(".")[2] for b in node.bases if (s := dotted(b))]
            out.symbol("class", node.name, node.lineno, node.end_lineno, cls, supers)
            inner_cls = node.name
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            inner_func = out.symbol("method" if cls else "function", node.name, node.lineno, node.end_lineno, cls)
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Lambda) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            inner_func = out.symbol("function", node.targets[0].id, node.lineno, node.end_lineno, cls)
        elif isinstance(node, ast.Import):
            for a in node.names:
                out.symbol("import", a.name, node.lineno, node.end_lineno, imported=True)
        elif isinstance(node, ast.ImportFrom):
            out.symbol("import", "." * node.level + (node.module or ""), node.lineno, node.end_lineno, imported=True)
        elif isinstance(node, ast.Call) and func:
            f = node.func
            if isinstance(f, ast.Name):
                out.call(func, f.id, None, node.lineno)
            elif isinstance(f, ast.Attribute):
                out.call(func, f.attr, dotted(f.value), node.lineno)
        stack += [(c, inner_cls, inner_func) for c in reversed(list(ast.iter_child_nodes(node)))]
    return True


# the table of languages ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Language:
    """``classes`` and ``interfaces`` are words that declare a type, ``functions`` those that declare a function; ``members``: functions
    may be declared without a word, in the body of a type (and ``free``: outside of one, behind their type)."""

    classes: str = ""
    interfaces: str = ""
    functions: str = ""
    members: bool = False
    free: bool = False
    literals: bool = False
    supers: str = "extends implements with"
    colon: bool = False
    imports: str = ""
    comments: str = r"//[^\n]*|/\*.*?\*/"
    strings: str = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
    blocks: str = "braces"
    words: set = field(default_factory=set)


_SCRIPT = dict(
    functions="function", members=True, literals=True,
    imports=r"^[ \t]*(?:import|export)\b[^'\"\n;=()]*?['\"]([^'\"\n]+)['\"]|\}[ \t]*from[ \t]*['\"]([^'\"\n]+)['\"]|\b(?:require|import)\([ \t]*['\"]([^'\"\n]+)['\"][ \t]*\)",
    strings=r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|(?:(?<=[=(,:;!&|?{\[+\-*%~^])|(?<=\breturn)|(?<=\bcase)|(?<==>))[ \t]*/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*",
)
_DOTTED = r"([\w.:\\*]+)"

LANGUAGES: dict[str, Language] = {
    "javascript": Language(classes="class", **_SCRIPT),
    "typescript": Language(classes="class enum type", interfaces="interface", **_SCRIPT),
    "java": Language(classes="class enum record", interfaces="interface", members=True, imports=rf"^[ \t]*import[ \t]+(?:static[ \t]+)?{_DOTTED}[ \t]*;", strings=r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"),
    "go": Language(functions="func", imports="", strings=r"\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)*'"),
    "rust": Language(classes="struct enum union", interfaces="trait", functions="fn", colon=True, imports=r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use[ \t]+([\w:]+)", strings=r"\br(?P<h>#*)\".*?\"(?P=h)|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\[^'\n]+|\\')'"),
    "c": Language(classes="struct enum union", free=True, imports=r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]"),
    "cpp": Language(classes="class struct enum union", members=True, free=True, colon=True, supers="", imports=r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", strings=r"R\"(?P<h>[^(\s]*)\(.*?\)(?P=h)\"|\"(?:[^\"\\\n]|\\.)*\"|(?<!\d)'(?:[^'\\\n]|\\.)+'"),
    "csharp": Language(classes="class struct enum record", interfaces="interface", members=True, colon=True, supers="", imports=rf"^[ \t]*using[ \t]+(?:static[ \t]+)?{_DOTTED}[ \t]*;"),
    "kotlin": Language(classes="class object", interfaces="interface", functions="fun", colon=True, supers="", imports=rf"^[ \t]*import[ \t]+{_DOTTED}", strings=r"\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"),
    "swift": Language(classes="class struct enum extension actor", interfaces="protocol", functions="func", colon=True, supers="", members=True, imports=rf"^[ \t]*import[ \t]+{_DOTTED}", strings=r"\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\""),
    "scala": Language(classes="class object", interfaces="trait", functions="def", imports=rf"^[ \t]*import[ \t]+{_DOTTED}", strings=r"\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'"),
    "php": Language(classes="class enum trait", interfaces="interface", functions="function", imports=r"^[ \t]*use[ \t]+([\w\\]+)|\b(?:require|include)(?:_once)?[ \t]*\(?[ \t]*['\"]([^'\"\n]+)['\"]", comments=r"//[^\n]*|/\*.*?\*/|#(?!\[)[^\n]*"),
    "dart": Language(classes="class enum mixin extension", members=True, free=True, imports=r"^[ \t]*(?:import|export|part)[ \t]+['\"]([^'\"\n]+)['\"]"),
    "ruby": Language(classes="class module", functions="def", supers="", imports=r"^[ \t]*(?:require|require_relative|load)[ \t(]+['\"]([^'\"\n]+)['\"]", comments=r"#[^\n]*", blocks="end", words=set("class module def if unless case while until for begin do".split())),
    "lua": Language(functions="function", imports=r"\brequire[ \t(]+['\"]([^'\"\n]+)['\"]", comments=r"--\[\[.*?\]\]|--[^\n]*", blocks="end", words=set("function if for while do repeat".split())),
    "r": Language(functions="function", imports=r"\b(?:library|require)\([ \t]*['\"]?([\w.]+)", comments=r"#[^\n]*"),
    "shell": Language(functions="function", free=True, imports=r"^[ \t]*(?:source|\.)[ \t]+([\w./~-]+)", comments=r"(?<![$\w])#[^\n]*", strings=r"\"(?:[^\"\\]|\\.)*\"|'[^']*'"),
    "python": Language(classes="class", functions="def", supers="", imports=r"^[ \t]*import[ \t]+([\w.]+)|^[ \t]*from[ \t]+([\w.]+)[ \t]+import", comments=r"#[^\n]*", strings=r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", blocks="indent"),
}
LANGUAGES["vue"] = LANGUAGES["svelte"] = LANGUAGES["javascript"]
#: What any other text is read as.
ANY = Language(classes="class struct enum module", interfaces="interface trait", functions="function func fn fun def", imports=rf"^[ \t]*(?:import|include|require|using|use)[ \t]+[\"'<]?{_DOTTED}", comments=r"//[^\n]*|/\*.*?\*/|#[^\n]*", blocks="indent")

#: Words before a bracket that call and declare nothing, in all languages and in single ones.
_CONTROL = frozenset(
    "if else for while do switch case default when catch try finally except with return throw raise yield await new delete typeof instanceof sizeof in is as not and or function class interface struct enum "
    "let const var val import from export package namespace where super this self assert async of static goto".split()
)
_CONTROL_IN = {
    k: _CONTROL | set(v.split())
    for k, v in {
        "go": "func go defer select range map chan", "rust": "fn loop match impl trait mod pub use unsafe move", "php": "echo array list isset empty exit match use require include unset fn", "csharp": "lock using fixed checked unchecked nameof foreach operator",
        "java": "synchronized", "ruby": "def unless until elsif begin end then module", "lua": "elseif until repeat then end local", "python": "print exec elif def lambda", "kotlin": "fun constructor", "swift": "func guard repeat", "scala": "def match", "cpp": "operator decltype noexcept alignas",
        "shell": "elif fi done esac until", "r": "repeat",
    }.items()
}

_ACCESS = frozenset("public private protected internal virtual static final override abstract open sealed data inner".split())
_NAME = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")

_TOKENS: dict[int, re.Pattern] = {}


def _token_pattern(lang: Language) -> re.Pattern:
    key = id(lang)
    if key not in _TOKENS:
        _TOKENS[key] = re.compile(
            rf"(?P<skip>{lang.comments})|(?P<text>{lang.strings})|(?P<name>[#@$]?[^\W\d][\w$]*[?!]?(?=[^=]|$)|[^\W\d][\w$]*|\$\w*)|(?P<num>\d[\w.]*)|(?P<op>=>|->|::|\?\.|[()\[\]{{}}.,;:=<>*&|?!+\-/@~^%\\])", re.S
        )
    return _TOKENS[key]


class _Scan:
    """The tokens of a text with their places, and for every opening bracket the number of its closing one."""

    def __init__(self, lang: Language, text: str):
        self.lang, self.text = lang, text
        self.tok: list[str] = []
        self.at: list[int] = []
        named: list[bool] = []
        gone = []
        strict = lang.blocks != "end"
        for m in _token_pattern(lang).finditer(text):
            kind, value = m.lastgroup, m.group()
            if kind == "skip":
                gone.append((m.start(), m.end()))
                continue
            if kind == "name":
                if strict and value[-1] in "?!":
                    value = value[:-1]
                if value[0] in "#@" and len(value) > 1:
                    value = value[1:] if value[0] == "#" or lang.blocks == "end" else value
            self.tok.append('""' if kind in ("text", "h") else value)
            self.at.append(m.start())
            named.append(kind == "name" and value[0] != "@")
        self.named = named
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.comments = gone
        self.close = self._brackets()

    def _brackets(self) -> dict[int, int]:
        close: dict[int, int] = {}
        open_: dict[str, list[int]] = {")": [], "]": [], "}": []}
        pair = {"(": ")", "[": "]", "{": "}"}
        for i, t in enumerate(self.tok):
            if t in pair:
                open_[pair[t]].append(i)
            elif t in open_ and open_[t]:
                close[open_[t].pop()] = i
        return close

    def line(self, i: int) -> int:
        """The line (from 1) of token ``i``."""
        return bisect.bisect_right(self.starts, self.at[min(i, len(self.at) - 1)])

    def in_comment(self, at: int) -> bool:
        k = bisect.bisect_right(self.comments, (at, len(self.text))) - 1
        return k >= 0 and self.comments[k][0] <= at < self.comments[k][1]

    def angle(self, i: int, most: int = 200) -> int:
        """Behind the type arguments that begin at ``i``, or ``i``."""
        depth = 0
        for k in range(i, min(i + most, len(self.tok))):
            t = self.tok[k]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if depth == 0:
                    return k + 1
            elif t in ";{}" or (t == "(" and depth == 0):
                return i
        return i

    def ends_by_word(self) -> dict[int, int]:
        """For languages whose blocks end with ``end``: opening word to closing word."""
        out, stack, line = {}, [], -1
        for i, t in enumerate(self.tok):
            fresh = self.line(i) != line
            line = self.line(i)
            if t in self.lang.words:
                # behind something on its line, these are conditions of a statement; a loop's own do opens nothing more
                if t in ("if", "unless", "while", "until") and not fresh and self.tok[i - 1] not in ("=", "then", "else", "do", "(", "return") and self.lang is LANGUAGES["ruby"]:
                    continue
                if t == "do" and stack and self.tok[stack[-1]] in ("while", "until", "for") and self.line(stack[-1]) == line:
                    continue
                if t in ("for", "while") and self.lang is LANGUAGES["lua"]:
                    continue
                stack.append(i)
            elif t == "end" or (t == "until" and self.lang is LANGUAGES["lua"]):
                if stack:
                    out[stack.pop()] = i
        return out

    def end_by_indent(self, i: int) -> int:
        """The last token of the lines indented more than the one of token ``i``."""
        first = self.line(i)
        width = self._indent(first)
        k = bisect.bisect_left(self.at, self.starts[first]) if first < len(self.starts) else len(self.at)
        while k < len(self.at):
            n = self.line(k)
            if self._indent(n) <= width and self.tok[k] not in ")]}":
                break
            k = bisect.bisect_left(self.at, self.starts[n]) if n < len(self.starts) else len(self.at)
        return k - 1

    def _indent(self, line: int) -> int:
        begin = self.starts[line - 1]
        lead = re.compile(r"[ \t]*").match(self.text, begin).group()
        return len(lead.expandtabs(4))


@dataclass
class _Scope:
    end: int
    kind: str
    name: str | None
    node: str | None


class _Pass:
    """The one pass over the tokens."""

    def __init__(self, out: Parsed, scan: _Scan):
        self.out, self.scan, self.lang = out, scan, scan.lang
        self.control = _CONTROL_IN.get(out.language, _CONTROL)
        self.classes, self.interfaces, self.functions = (set(x.split()) for x in (self.lang.classes, self.lang.interfaces, self.lang.functions))
        self.words = scan.ends_by_word() if self.lang.blocks == "end" else {}
        self.scopes: list[_Scope] = []
        self.declared: set[int] = set()
        #: closing token to what its bracket is: type, literal, other
        self.braces: list[tuple[int, str]] = []

    def parent(self) -> str | None:
        return next((s.name for s in reversed(self.scopes) if s.kind == "type"), None)

    def caller(self) -> str | None:
        return next((s.node for s in reversed(self.scopes) if s.kind == "func"), None)

    def body(self, i: int, most: int = 400) -> int | None:
        """The opening brace of the block whose head goes on at ``i``; None where the head ends without one."""
        tok, close = self.scan.tok, self.scan.close
        stop = min(len(tok), i + most)
        while i < stop:
            t = tok[i]
            if t == "{":
                return i
            if t in ";}" or t == ")" or t == "]":
                return None
            i = close.get(i, i) + 1 if t in "([" else i + 1
        return None

    def span(self, head: int, after: int) -> tuple[int, int | None]:
        """(last token, opening brace) of the declaration that begins at ``head`` and whose head goes on at ``after``."""
        scan = self.scan
        if self.lang.blocks == "end":
            return self.words.get(head, after), None
        if self.lang.blocks == "indent":
            own = scan.line(head)
            brace = next((k for k in range(after, min(after + 60, len(scan.tok))) if scan.tok[k] == "{" and scan.line(k) <= own + 1), None) if self.lang is ANY else None
            return (scan.close.get(brace, len(scan.tok) - 1), brace) if brace is not None else (max(after - 1, scan.end_by_indent(head)), None)
        brace = self.body(after)
        if brace is None:
            return self.line_end(after), None
        return scan.close.get(brace, len(scan.tok) - 1), brace

    def line_end(self, i: int) -> int:
        """The last token of the expression that begins at ``i``: up to a separator, or the line's end between operands."""
        tok, close, n = self.scan.tok, self.scan.close, len(self.scan.tok)
        last = i
        while i < n:
            t = tok[i]
            if t in (",", ";", ")", "]", "}"):
                return max(last, i - 1)
            if i > last and self.scan.line(i) > self.scan.line(last) and t not in (".", "?.", "?", ":", "+", "-", "*", "/", "|", "&", "=") and tok[last] not in ("=>", "=", "+", "-", "*", "/", "(", "|", "&", "?", ":", "."):
                return last
            last = close.get(i, i) if t in "([{" else i
            i = last + 1
        return n - 1

    def names_in(self, a: int, b: int) -> list[str]:
        """The types named between two tokens, the last part of each; type arguments, calls and access words left out."""
        tok, out, i = self.scan.tok, [], a
        while i < b:
            if tok[i] == "<":
                i = max(self.scan.angle(i), i + 1)
                continue
            if tok[i] in "([":
                i = self.scan.close.get(i, i) + 1
                continue
            if self.scan.named[i] and tok[i] not in _ACCESS and tok[i] not in ("where", "for", "dyn", "permits"):
                if out and tok[i - 1] in (".", "::", "\\") and i - 1 > a:
                    out[-1] = tok[i]
                else:
                    out.append(tok[i])
            i += 1
        return out

    def supers(self, name_at: int, brace: int | None, last: int) -> list[str]:
        tok = self.scan.tok
        head = brace if brace is not None else next((k for k in range(name_at + 1, last + 1) if self.scan.line(k) > self.scan.line(name_at) or tok[k] == ":" and self.lang.blocks == "indent"), last)
        i = name_at + 1
        if i < head and tok[i] == "<" and self.lang.blocks != "end":
            i = self.scan.angle(i)
        if self.lang.blocks == "end":
            return self.names_in(i + 1, head)[:1] if i < head and tok[i] == "<" else []
        if self.lang.blocks == "indent":
            return self.names_in(i + 1, self.scan.close.get(i, i)) if i < len(tok) and tok[i] == "(" else []
        if i < head and tok[i] == "(":
            i = self.scan.close.get(i, i) + 1
        out: list[str] = []
        words = set(self.lang.supers.split())
        k = i
        while k < head:
            if tok[k] == "<":
                k = max(self.scan.angle(k), k + 1)
                continue
            if tok[k] in words or (self.lang.colon and tok[k] == ":"):
                end = next((j for j in range(k + 1, head) if tok[j] in words or tok[j] in ("where", "permits")), head)
                out += self.names_in(k + 1, end)
                k = end
            else:
                k += 1
        return list(dict.fromkeys(out))

    def declare_type(self, i: int) -> bool:
        scan, tok = self.scan, self.scan.tok
        n = len(tok)
        if i and tok[i - 1] in (".", "::", "?.", ":") and self.lang.blocks == "braces":
            return False
        kind = "interface" if tok[i] in self.interfaces else "class"
        at = i + 1
        if tok[i] == "enum" and at < n and tok[at] in ("class", "struct"):
            at += 1
        if tok[i] == "object" and at < n and not scan.named[at]:
            return False
        if at >= n or not scan.named[at] or tok[at] in ("extends", "implements", "in", "of"):
            return False
        name = tok[at]
        while at + 2 < n and tok[at + 1] in ("::", ".") and scan.named[at + 2]:
            at += 2
            name = tok[at]
        if tok[i] == "type":
            # an alias: the name, its arguments, an equals sign
            k = scan.angle(at + 1) if at + 1 < n and tok[at + 1] == "<" else at + 1
            if k >= n or tok[k] != "=":
                return False
            last = self.line_end(k + 1)
            self.type(kind, name, i, last, None, [])
            self.braces.append((last, "alias"))
            return True
        last, brace = self.span(i, at + 1)
        if brace is None and self.lang.blocks == "braces" and self.out.language in ("c", "cpp", "typescript", "javascript", "java", "php"):
            return False
        if brace is not None and self.out.language in ("c", "cpp") and any(tok[k] in ("(", "=") for k in range(at + 1, brace)):
            return False
        self.type(kind, name, i, last, brace, self.supers(at, brace, last))
        self.declared.add(at + 1)
        return True

    def type(self, kind: str, name: str, i: int, last: int, brace: int | None, supers: list[str]) -> None:
        self.out.symbol(kind, name, self.scan.line(i), self.scan.line(last), self.parent(), supers)
        self.scopes.append(_Scope(last, "type", name, None))
        if brace is not None:
            self.braces.append((last, "alias" if kind == "interface" and self.lang.literals else "type"))
            self.declared.add(brace)

    def declare_go_type(self, i: int) -> bool:
        scan, tok = self.scan, self.scan.tok
        at = i + 1
        if at >= len(tok) or not scan.named[at]:
            return False
        k = scan.close.get(at + 1, at) + 1 if at + 1 < len(tok) and tok[at + 1] == "[" else at + 1
        if k >= len(tok) or tok[k] not in ("struct", "interface") or k + 1 >= len(tok) or tok[k + 1] != "{":
            return False
        last = scan.close.get(k + 1, len(tok) - 1)
        self.type("interface" if tok[k] == "interface" else "class", tok[at], i, last, k + 1, [])
        return True

    def declare_impl(self, i: int) -> bool:
        """Rust: ``impl Type`` or ``impl Trait for Type``."""
        scan, tok = self.scan, self.scan.tok
        at = scan.angle(i + 1) if i + 1 < len(tok) and tok[i + 1] == "<" else i + 1
        brace = self.body(at)
        if brace is None:
            return False
        split = next((k for k in range(at, brace) if tok[k] == "for" and tok[k + 1] != "<"), None)
        end = next((k for k in range(split or at, brace) if tok[k] == "where"), brace)
        names = self.names_in(split + 1 if split is not None else at, end)
        if not names:
            return False
        self.type("class", names[0], i, scan.close.get(brace, len(tok) - 1), brace, self.names_in(at, split)[:1] if split is not None else [])
        return True

    def function(self, name: str, head: int, after: int, owner: str | None = None, plain: bool = False, last: int | None = None, brace: int | None = None) -> None:
        """A function that begins at ``head``; ``plain`` ones, named by what holds them, are never methods."""
        if last is None:
            last, brace = self.span(head, after)
        parent = owner or self.parent()
        nid = self.out.symbol("function" if plain or not parent else "method", name, self.scan.line(head), self.scan.line(last), parent)
        self.scopes.append(_Scope(last, "func", name, nid))
        if brace is not None:
            self.declared.add(brace)
            self.braces.append((last, "code"))

    def declare_function(self, i: int) -> bool:
        scan, tok, n = self.scan, self.scan.tok, len(self.scan.tok)
        at, owner = i + 1, None
        if i and tok[i - 1] in (".", "::", "?."):
            return False
        if at < n and tok[at] in ("*", "&"):
            at += 1
        if self.out.language == "go" and at < n and tok[at] == "(" and at in scan.close:
            held = self.names_in(at + 1, scan.close[at])
            at, owner = scan.close[at] + 1, held[-1] if held else None
        if at < n and tok[at] == "<":
            at = scan.angle(at)
        if at >= n or not scan.named[at] or (tok[at] in ("if", "for", "while", "return") and self.lang.blocks == "braces"):
            return False
        name = tok[at]
        while at + 2 < n and tok[at + 1] in (".", ":", "::") and scan.named[at + 2] and scan.line(at + 2) == scan.line(at):
            if self.lang.blocks == "end" or self.out.language == "kotlin":
                owner = name if name != "self" else None
                at += 2
                name = tok[at]
            else:
                break
        self.declared.add(at + 1)
        after = at + 1
        if after < n and tok[after] == "<":
            after = scan.angle(after)
            self.declared.add(after)
        if after < n and tok[after] in ("[", "("):
            after = scan.close.get(after, after) + 1
            if after < n and tok[after] == "(":
                self.declared.add(after)
                after = scan.close.get(after, after) + 1
        elif self.lang.blocks == "braces" and self.out.language not in ("scala", "shell"):
            return False
        if self.out.language in ("kotlin", "scala"):
            eq = next((k for k in range(after, min(after + 40, n)) if tok[k] in ("=", "{") or (scan.line(k) > scan.line(after - 1) and tok[k] != ":")), n)
            if eq < n and tok[eq] == "=" and not (eq + 1 < n and tok[eq + 1] == "{"):
                self.function(name, i, after, owner, last=self.line_end(eq + 1))
                return True
        brace = self.body(after) if self.lang.blocks == "braces" else None
        if self.lang.blocks == "braces" and brace is None and self.out.language in ("typescript", "javascript", "c", "cpp", "r"):
            return False
        self.function(name, i, after, owner)
        return True

    def declare_member(self, i: int) -> bool:
        """A name with parameters and a block, without a word before it."""
        scan, tok, n = self.scan, self.scan.tok, len(self.scan.tok)
        at = i + 1
        if at < n and tok[at] == "<":
            at = scan.angle(at)
        if at >= n or tok[at] != "(" or at not in scan.close or at in self.declared or tok[i] in self.control and tok[i - 1] not in ("get", "set", "async", "static"):
            return False
        where = self.braces[-1][1] if self.braces else "top"
        before = tok[i - 1] if i else ";"
        if where == "type":
            if not self.lang.members or before in (".", "?.", "=", "new", "return", "(", ",", "->"):
                return False
        elif where == "literal":
            if not self.lang.literals or before not in ("{", ",", "async", "get", "set", "*"):
                return False
        elif not (self.lang.free and where in ("top", "space") and (scan.named[i - 1] and before not in self.control or before in ("*", "&", ">", "::", "~") or self.out.language == "shell")):
            return False
        close = scan.close[at]
        k, owner = close + 1, None
        if before == "::" and i > 1 and scan.named[i - 2]:
            owner = tok[i - 2]
        stop = min(n, k + 80)
        while k < stop and tok[k] not in ("{", ";", "=", "=>", ")", "}", ","):
            if tok[k] == ":" and self.out.language in ("cpp", "csharp"):
                # what a constructor initialises stands before its block
                while k < stop and tok[k] not in ("{", ";"):
                    self.declared |= {k} if tok[k] == "(" else set()
                    k = scan.close.get(k, k) + 1 if tok[k] in "([" else k + 1
                break
            k = scan.close.get(k, k) + 1 if tok[k] in "([" else self.type_end(k) if tok[k] == ":" else k + 1
        if k < n and tok[k] == "{":
            first = self.head_of(i)
            self.declared.add(at)
            self.function(tok[i], first, k, owner, last=scan.close.get(k, n - 1), brace=k)
            return True
        if k < n and tok[k] == ";" and where == "type" and self.out.language in ("java", "csharp") and (scan.named[i - 1] or before in (">", "]")) and before not in self.control:
            self.declared.add(at)
            self.function(tok[i], self.head_of(i), k, owner, last=k)
            return True
        if k < n and tok[k] == "=>" and where == "type" and self.out.language in ("csharp", "dart") and before not in self.control:
            self.declared.add(at)
            self.function(tok[i], self.head_of(i), k, owner, last=self.line_end(k + 1))
            return True
        return False

    def type_end(self, k: int) -> int:
        """Behind a type note that begins at the colon ``k``: an object type is part of it."""
        k += 1
        if k < len(self.scan.tok) and self.scan.tok[k] == "{":
            return self.scan.close.get(k, k) + 1
        return k

    def head_of(self, i: int) -> int:
        """The first token of the line of ``i`` that belongs to its declaration."""
        k = i
        while k and self.scan.line(k - 1) == self.scan.line(i) and self.scan.tok[k - 1] not in ";{},":
            k -= 1
        return k

    def declare_held(self, i: int) -> bool:
        """A function without name of its own that a variable, a property or an assignment holds."""
        scan, tok, n = self.scan, self.scan.tok, len(self.scan.tok)
        k, sign = i + 1, tok[i + 1] if i + 1 < n else ""
        if self.out.language == "r":
            if not (sign == "=" or sign == "<" and k + 1 < n and tok[k + 1] == "-"):
                return False
            k += 1 if sign == "=" else 2
            if k < n and tok[k] == "function":
                self.function(tok[i], i, scan.close.get(k + 1, k) + 1, plain=True)
                return True
            return False
        before = tok[i - 1] if i else ";"
        if before in (":", ".", "?.", "|", "&", "<"):
            # part of a type note; of what a member is assigned to, only the place counts
            if before not in (".", "?.") or sign != "=":
                return False
        if sign in ("?", "!") and k + 1 < n and tok[k + 1] == ":":
            k, sign = k + 1, ":"
        if sign == ":" and (before in ("const", "let", "var", "readonly", "private", "public", "protected", "static") or (self.braces and self.braces[-1][1] == "type")):
            # a type note: look for the equals sign behind it
            while k < min(i + 60, n) and tok[k] not in ("=", ";", ")", "}", ","):
                k = scan.close.get(k, k) + 1 if tok[k] in "([{" else k + 1
            if k >= n or tok[k] != "=":
                return False
        elif sign == ":":
            if not self.braces or self.braces[-1][1] != "literal" or before not in ("{", ","):
                return False
        elif sign != "=" or (k + 1 < n and tok[k + 1] in ("=", ">")):
            return False
        k += 1
        if k < n and tok[k] == "async":
            k += 1
        if k >= n:
            return False
        head = self.head_of(i)
        if tok[k] == "function":
            at = k + 2 if k + 1 < n and tok[k + 1] == "*" else k + 1
            at = at + 1 if at < n and scan.named[at] else at
            if at < n and tok[at] == "(" and (brace := self.body(scan.close.get(at, at) + 1)) is not None:
                self.declared |= {at, k}
                self.function(tok[i], head, brace, plain=True)
                return True
            return False
        if tok[k] == "<":
            k = scan.angle(k)
        if k < n and scan.named[k] and k + 1 < n and tok[k + 1] == "=>":
            arrow = k + 1
        elif k < n and tok[k] == "(" and k in scan.close:
            arrow = scan.close[k] + 1
            if arrow < n and tok[arrow] == ":":
                stop = min(arrow + 60, n)
                while arrow < stop and tok[arrow] not in ("=>", ";", ",", ")", "="):
                    arrow = scan.close.get(arrow, arrow) + 1 if tok[arrow] in "([{" else arrow + 1
            if arrow >= n or tok[arrow] != "=>":
                return False
        else:
            return False
        brace = arrow + 1 if arrow + 1 < n and tok[arrow + 1] == "{" else None
        last = scan.close.get(brace, n - 1) if brace is not None else self.line_end(arrow + 1)
        self.function(tok[i], head, arrow, plain=True, last=last, brace=brace)
        return True

    def call(self, i: int) -> None:
        scan, tok = self.scan, self.scan.tok
        caller = self.caller()
        if caller is None:
            return
        k, first = i, i
        while k >= 2 and tok[k - 1] in (".", "?.", "::", "->"):
            k -= 2
            if tok[k] in (")", "]") and tok[k + 1] in (".", "?.", "->"):
                opening = self.opens.get(k)
                if opening is None or opening < 1 or not scan.named[opening - 1]:
                    break
                k = opening - 1
            elif not scan.named[k]:
                break
            first = k
        receiver = re.sub(r"\s+", "", scan.text[scan.at[first] : scan.at[i]]).rstrip(".:?->") if first < i else ""
        self.out.call(caller, tok[i], receiver[-200:] or None, scan.line(i))

    def kind_of_brace(self, i: int) -> str:
        """literal, alias (a type written out), space (a namespace) or code."""
        tok = self.scan.tok
        before = tok[i - 1] if i else ";"
        around = self.braces[-1][1] if self.braces else "top"
        if self.lang.literals:
            if around == "alias" or before == "<":
                return "alias"
            if before == ":":
                # behind the key of a literal it is one too, elsewhere it belongs to a type note
                return "literal" if around == "literal" and i > 2 and tok[i - 3] in ("{", ",") else "alias"
            if before in ("=", "(", ",", "[", "return", "?", "|", "&", "default"):
                return "literal"
        if before == '""' or any(t in ("namespace", "extern") for t in tok[max(0, i - 6) : i]):
            return "space"
        return "code"

    def run(self) -> None:
        scan, tok, n = self.scan, self.scan.tok, len(self.scan.tok)
        self.opens = {b: a for a, b in scan.close.items()}
        go, rust = self.out.language == "go", self.out.language == "rust"
        i = 0
        while i < n:
            while self.scopes and self.scopes[-1].end < i:
                self.scopes.pop()
            while self.braces and self.braces[-1][0] <= i:
                self.braces.pop()
            t = tok[i]
            if t == "{" and i not in self.declared:
                self.braces.append((scan.close.get(i, n), self.kind_of_brace(i)))
            elif scan.named[i]:
                done = False
                if t in self.classes or t in self.interfaces:
                    done = self.declare_type(i)
                elif go and t == "type":
                    done = self.declare_go_type(i)
                elif rust and t == "impl":
                    done = self.declare_impl(i)
                if not done and t in self.functions and i not in self.declared:
                    done = self.declare_function(i)
                if not done and i + 1 < n:
                    follow = tok[i + 1]
                    if follow in ("(", "<") and (self.lang.members or self.lang.free or self.lang.literals):
                        done = self.declare_member(i)
                    if not done and (self.lang.literals or self.out.language == "r") and follow in ("=", ":", "?", "!", "<"):
                        done = self.declare_held(i)
                    if not done and (t not in self.control or (i and tok[i - 1] in (".", "?.", "::", "->"))):
                        at = scan.angle(i + 1, 30) if follow == "<" else i + 1
                        if follow == "!" and rust:
                            at = i + 2
                        if at < n and tok[at] == "(" and at not in self.declared and (tok[i - 1] if i else "") not in self.functions:
                            self.call(i)
            i += 1


def _imports(out: Parsed, scan: _Scan) -> None:
    if out.language == "go":
        for i, t in enumerate(scan.tok):
            if t == "import" and i + 1 < len(scan.tok):
                stop = scan.close.get(i + 1, i + 1) if scan.tok[i + 1] == "(" else i + 2
                for k in range(i + 1, min(stop + 1, len(scan.tok))):
                    if scan.tok[k] == '""':
                        m = re.compile(r"[\"`]([^\"`\n]+)[\"`]").match(scan.text, scan.at[k])
                        if m:
                            out.symbol("import", m.group(1), scan.line(k), scan.line(k), imported=True)
        return
    if not scan.lang.imports:
        return
    for m in re.finditer(scan.lang.imports, scan.text, re.M):
        group = next((g for g in range(1, len(m.groups()) + 1) if m.group(g)), None)
        if group is not None and not scan.in_comment(m.start(group)):
            line = bisect.bisect_right(scan.starts, m.start(group))
            out.symbol("import", m.group(group).rstrip(":\\"), line, line, imported=True)


def read_tokens(out: Parsed, text: str) -> bool:
    """The scanner, by the table's row of the language."""
    scan = _Scan(LANGUAGES.get(out.language, ANY), text)
    _imports(out, scan)
    if scan.tok:
        _Pass(out, scan).run()
    return True


#: Readers by language; other languages go to the scanner.
READERS: dict[str, Callable[[Parsed, str], bool]] = {"python": read_python}


def register(language: str, reader: Reader) -> None:
    """Have the texts of ``language`` read by ``reader``; it must be importable where the tasks run."""
    READERS[language] = reader


def parse_text(path: str, language: str, text: str) -> Parsed:
    """By the language's reader, else by the scanner. A text at which both fail has its file node alone, with the error in its meta."""
    try:
        out = Parsed(path, language, text)
        reader = READERS.get(language)
        if reader is None or not reader(out, text):
            out = Parsed(path, language, text)
            read_tokens(out, text)
        return out
    except Exception as e:  # noqa: BLE001 - one bad file must not end the run
        out = Parsed(path, language, text)
        out.nodes[0] = (*out.nodes[0][:-1], json.dumps({"error": f"{type(e).__name__}: {e}"[:200]}))
        return out
