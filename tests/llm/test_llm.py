"""The training-data operators against brute force and on awkward inputs."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import abuse, fusion, leaks, mixing, provenance, spans, syntax, vectors
from quillgraph.llm.grammars import grammar, python_grammar, python_lines


def long_text(rng, n):
    return "".join(rng.choice("abc \n(){};=xyz") for _ in range(n))


# 1 shared spans


def brute_pairs(rows, span):
    at = {}
    for i, t in rows:
        for k in range(len(t) - span + 1):
            at.setdefault(t[k : k + span], set()).add(i)
    return {p for ids in at.values() for p in itertools.combinations(sorted(ids), 2)}


def test_spans_against_brute_force(spark):
    rng = random.Random(3)
    base = [long_text(rng, 400) for _ in range(12)] + ["-" * 300, "ab" * 150, "é😀" * 100]
    rows = []
    for i in range(60):
        t = long_text(rng, rng.randint(0, 300))
        if i % 2:
            b = rng.choice(base)
            k, n = rng.randint(0, len(b) - 100), rng.choice([39, 40, 41, 60, 100])
            t = t[: len(t) // 2] + b[k : k + n] + t[len(t) // 2 :]
        rows.append((f"n{i:02}", t))
    rows += [("n07", rows[7][1]), ("copy1", "same " * 20), ("copy2", "same " * 20), ("e", ""), ("nul", None), (None, "same " * 20)]
    df = spark.createDataFrame(rows, "id string, snippet string").withColumn("cls", F.lit("clash")).withColumn("key", F.lit(1))
    s = spans.SharedSpans(df, span=40)
    got = {(r["node_id_a"], r["node_id_b"]) for r in s.pairs().collect()}
    assert got == brute_pairs([(i, t) for i, t in rows if i and t], 40)
    part = {r["id"]: r for r in s.per_record().collect()}
    assert part["copy1"]["shared_part"] == 1.0 and part["e"]["shared_part"] is None and part["copy1"]["class_id"] == part["copy2"]["class_id"]
    texts = {i: t for i, t in rows if i and t}
    for i, t in texts.items():
        elsewhere = {u[k : k + 40] for j, u in texts.items() if j != i for k in range(len(u) - 39)}
        covered = set()
        for k in range(len(t) - 39):
            if t[k : k + 40] in elsewhere:
                covered |= set(range(k, k + 40))
        if not i.startswith("copy"):
            assert part[i]["shared_chars"] == len(covered), i
    assert spans.SharedSpans(df.limit(0), span=40).pairs().count() == 0


def test_window_keys_depend_on_the_window_alone():
    rng = random.Random(5)
    core = long_text(rng, 120)
    keys = set()
    for _ in range(40):
        left, right = long_text(rng, rng.randint(0, 90)), long_text(rng, rng.randint(0, 90))
        doc, key, w0, w1 = spans.window_keys([left + core + right, "x"], 120)
        hit = [k for d, k, a, b in zip(doc, key, w0, w1) if d == 0 and a <= len(left) <= b]
        assert len(hit) == 1
        keys.add(int(hit[0]))
    assert len(keys) == 1


# 2 provenance


@pytest.mark.parametrize(
    "text,want",
    [
        ("// Code generated by tool 1.2. DO NOT EDIT.\npackage x\n", "generated"), ("#!/bin/sh\n#  This file was automatically\tgenerated by x.\n", "generated"), ("/*\n * @generated by x from y\n */\n", "generated"),
        ("// see the code generator notes\n", None), ("// @generated tags are stripped here\n", None), ("// the ids are generated by the x service, do not edit them by hand\n", None),
        ('s = "// Code generated by tool. DO NOT EDIT."\n', None), ("# Vendored copy of x 1.0\n", "vendored"), ("# license: internal, x team\n", None), ("", None),
        ("// imported from release tarball of x-lite 3.2.3 (c) the y authors, used under the BSD-like license\n", "vendored"), ("// imported from the parser, used under the hood\n", None), ("# adapted the idea, not the code, from a x library\n", None),
    ],
)
def test_notices(text, want):
    assert provenance.notice(text) == want


def test_notices_anywhere():
    own = "".join(f"const a{i} = f({i});\n" for i in range(200))
    end = "// Code generated by tool 1.2. DO NOT EDIT.\n"
    assert provenance.notice(own + end) == provenance.notice(own + end + own) == "generated"
    assert provenance.notice(own + "/*\n  This file was generated by x.\n*/\n", "ts") == "generated"
    assert provenance.notice("x = 1\n" * 300 + "# Vendored copy of x 1.0\n", "py") == "vendored"
    assert provenance.notice(own + "// @generated tags are stripped here\n// the ids are generated by the x service\n", "ts") is None


@pytest.mark.parametrize("ext,opening,closing", [("ts", "const h = `", "`;"), ("go", "const h = `", "`"), ("py", 'H = """', '"""'), ("java", 'String h = """', '""";'), ("rs", 'const H: &str = r#"', '"#;'), ("rs", 'const H: &str = "', '";')])
def test_notices_in_strings_are_text(ext, opening, closing):
    mark = "#" if ext == "py" else "//"
    line = f"{mark} Code generated by tool 1.2. DO NOT EDIT.\n"
    own = f"{opening}\n{line}{closing}\n"
    assert provenance.notice(own, ext) is None
    assert provenance.notice(own + line, ext) == "generated"


def test_shapes():
    assert provenance.shape("x = [" + ", ".join(map(str, range(200))) + "]\n", "py") == "data"
    assert provenance.shape("const s = '" + "A" * 500 + "';\n", "js") == "data"
    assert provenance.shape("package t\nconst (\n" + "".join(f"\tA{i} = {i * 7}\n" for i in range(60)) + ")\n", "go") == "table"
    assert provenance.shape("var a=b.c||d,e=function(f){return g(f,1)};" * 20, "js") == "minified"
    assert provenance.shape('"use strict";\nvar __r = (this && this.__r) || function (o) { return o; };\n' * 3, "js") == "compiled"
    own = "".join(f"const part{i} = load(name{i}, {i});\nuse(part{i});\n" for i in range(30))
    assert provenance.shape(own + 'const head = "__webpack_require__ exports.x = void 0;";\n// System.register([\n', "js") is None
    assert provenance.shape(own + "//# sourceMappingURL=a.js.map\n", "js") == "compiled" and provenance.shape('Object.defineProperty(exports, "__esModule", { value: true });\n' + own, "js") == "compiled"
    assert provenance.shape("def f(x):\n    return x + 1\n" * 30, "py") is None and provenance.shape("", "ts") is None


def test_classify(spark):
    lib = "function known(a, b) {\n  const total = a * b + compute(a);\n  if (total > limit) {\n    return shrink(total, b);\n  }\n  return total + offset(b);\n}\n" * 2
    files = [("r/vendor/lib/a.ts", "typescript", 1), ("r/api/vendor.ts", "typescript", 1), ("r/api/vendor/own.ts", "typescript", 1), ("r/x.pb.go", "go", 1), ("r/c.ts", None, -1), ("r/c.ts", "typescript", 2), ("r/node_modules/l/x.md", "markdown", 1), (None, "go", 1), ("r/no.ts", None, None)]
    f = spark.createDataFrame([(*x, None) for x in files], "path string, language string, size bigint, indexed_at timestamp").withColumn("reason", F.lit("clash"))
    t = spark.createDataFrame([("r/api/vendor.ts", "export const a = 1;"), ("r/c.ts", "// mine\n" + lib.replace("offset", "shift")), ("r/api/vendor/own.ts", None), (None, "x")], "path string, content string")
    k = spark.createDataFrame([(1, lib), (2, None), (3, "")], "lib_id bigint, content string")
    got = {r["path"]: r["reason"] for r in provenance.classify_files(f, t, k).collect()}
    assert got == {"r/vendor/lib/a.ts": "vendored", "r/x.pb.go": "generated", "r/c.ts": "copied"}
    deep = spark.createDataFrame([("vendor/lib/x.js", None, None, None), ("/".join(["d"] * 1200) + "/vendor/lib/x.js", None, None, None), ("gen/x.js", None, None, None), ("vendor/x.js", None, None, None), ("a/kind_string.go", None, None, None), ("a/string.go", None, None, None)], f.drop("reason").schema)
    assert {r["reason"] for r in provenance.noticed_files(deep, t).collect()} == {"vendored", "generated"} and provenance.noticed_files(deep, t).count() == 4
    assert {r["path"]: r["reason"] for r in provenance.noticed_files(f, t).collect()} == {k: v for k, v in got.items() if v != "copied"}
    assert provenance.classify_files(f.limit(0), t, k).count() == 0 and provenance.classify_files(f, t.limit(0), k.limit(0)).count() == 2


# 3 syntax

GOOD = {
    "ts": ["", "let a = x < y && z > w; f<number>(1); const g = <T,>(v: T): T => v;", "type A = { readonly [k: string]: B | C[] }; enum E { X = 1 }\nabstract class Q<T> extends R implements S { private x?: number = 1; get y() { return 1 } abstract z(): void; }",
           "a\n++b\nconst re = /[/]x/g.test(s) ? `a${`b${c}`}` : d as unknown as string", "for (const [k, v] of m) { if (k) continue; else break }", "export default async function () { for await (const x of y) yield_(x) }"],
    "tsx": ["const a = <div className=\"x\" {...p}>it's {n > 1 ? <b>{n}</b> : null}<br/></div>;"],
    "js": ["import a, { b as c } from 'x' with { type: 'json' };\nexport { c };", "x = a ? b : c\n;[1, 2].map((v) => v ** 2)", "class A { #p = 1; static { f() } get [k]() { return this.#p } }", "label: for (;;) { break label }", "({a = 1, ...r} = o)"],
    "go": ["package p\nimport (\n\"a\"\n. \"b\"\n)\nfunc (r *T[K]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok { return v, nil }\n\tfor i := range xs { switch y := x.(type) { case int, T: go f(y)\n default: } }\n\tz := []T{{1}, {2}}\n\treturn\n}\n",
           "package p\ntype S struct {\n\tA, B int `x`\n\t*T\n}\ntype I interface { ~int | string; M(int) error }\nvar c = make(chan<- int, 3)\n"],
    "java": ["package a.b;\nimport java.util.*;\n@A(x = 1) public sealed class C<T extends B & D> permits E { int[] f = {1, 2}; <R> R m(final int... a) throws X { var l = (Fn<T>) x -> x + 1; return switch (a) { case 1, 2 -> null; default -> { yield this.<R>g(); } }; } }",
             "record P(int x, String y) { P { if (x < 0) throw new E(); } }\nenum K { A(1) { void f() {} }, B; }"],
    "rs": ["#![allow(x)]\nuse a::{b, c::*};\nimpl<'a, T: Clone + 'a> X<T> for Y<'a> where T: Z { fn f(&mut self, x: &'a [u8; 4]) -> Option<Vec<Vec<u8>>> { let v = vec![1, 2]; match x { [a, .., b] if a > b => Some(vec![]), _ => { return None; } } } }",
           "fn main() { let s = S { a: 1, ..d }; for i in 0..n { if let Some(x) = f(i)? { println!(\"{}\", x as u64); } } let c = |a: i32| -> i32 { a << 2 }; loop { break 'a' as u8; } }"],
    "py": ["", "def f(a, /, b=1, *c, d, **e) -> int:\n    return [x for x in y if z] if a else {**b}\n", "match p:\n    case [1, *_] | {'k': 2} if v:\n        pass\nx: int = 1\na = b = yield_\n", "@d\nasync def g():\n\tasync with a as b, c:\n\t\tawait b\n", "if x:\n  y = (1 +\n# c\n 2)\nelse: pass"],
}
BAD = {
    "ts": ["function f( {", "let x: = 1;", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n", "const const = 1", "if (a { }", "return 1", "from x import y"],
    "js": ["let x: number = 1;", "f() = ;", "class A { x( }", "a b", "`abc", "let package = 1", "break;"],
    "go": ["package p\nfunc f() { x := }\n", "func f() {}\n", "package p\nfunc f() int {\n\treturn 1\n", "package p\nlet x = 1\n"],
    "java": ["class A { int f( { } }", "class A { void f() { int x = ; } }", "import a.b\nclass A {}", "class A { void f() { return 1 } }"],
    "rs": ["fn f( { }", "fn f() { let x 1; }", "fn f() -> i32 { 1", "class A {}"],
    "py": ["def f(:\n  pass\n", "if x\n  y\n", "  x = 1\ny = 2\n", "print 'a'\n", "x = (1\n", "class A:\n", "a = 'x\n", "return 1\n", "if x:\n    a\n  b\n"],
}


@pytest.mark.parametrize("lang", list(GOOD))
def test_valid_and_invalid(lang):
    for t in GOOD[lang]:
        assert syntax.fault_of(t, lang) == -1, (lang, t, syntax.fault_of(t, lang))
    for t in BAD.get(lang, []):
        assert syntax.fault_of(t, lang) >= 0, (lang, t)


def test_cut_texts_fail_and_causes():
    for lang in ("ts", "go", "java", "rs"):
        t = GOOD[lang][-1]
        v = grammar(lang).check(t[: t.rindex("}")])
        assert not v.ok
    t = "let a = 1;\n<<<<<<< HEAD\nlet b = 2;\n=======\nlet b = 3;\n>>>>>>> x\n"
    assert syntax.cause(t, syntax.fault_of(t, "ts")) == "conflict"
    assert syntax.fault_of("/*\n<<<<<<< HEAD\n*/ let a = `\n=======\n`;", "ts") == -1
    assert syntax.cause("function f() {\n  g(", syntax.fault_of("function f() {\n  g(", "js")) == "truncated"
    assert syntax.fault_of("(" * 3000 + ")" * 3000, "js") in (-1, 3000, 3001)


@pytest.mark.parametrize("lang", ["tsx", "jsx"])
def test_end_tags_have_the_name_of_their_opening(lang):
    for t in ("<a><b></b></a>", "<a.b c={<d></d>} ><a.b></a.b></a.b >", "<x:y>{f(<a></a>)}</ x:y>", "<><a></a></>", "<a /* c */><a/></a>", "<ab><a></a></ab>"):
        assert syntax.fault_of(f"const x = {t};", lang) == -1, t
    for t in ("<div></span>", "<a><b></a></b>", "<a.b></a.c>", "<a></ab>", "<ab></a>", "<a></></a>", "<></a>", "<a></A>", "<a b={<c></d>}></a>"):
        assert syntax.fault_of(f"const x = {t};", lang) >= 0, t
    t = "const x = <div>\n  <b></b>\n</span>;"
    assert syntax.fault_of(t, lang) == t.index("span")


def test_python_grammar_agrees_with_the_compiler():
    import ast
    import inspect

    for module in (ast, inspect, itertools.__class__ and random, argparse_like()):
        src = inspect.getsource(module)
        lined, _, fault = python_lines(src)
        assert fault == -1 and python_grammar().check(lined).ok, module


@pytest.mark.parametrize("lang,before,level,after", [("js", "x = ", "[", "]"), ("ts", "x = ", "[", "]"), ("go", "package p\nvar x = ", "f(", ")"), ("java", "class A { int x = ", "f(", ")"), ("rs", "fn f() { g", "(", ")"), ("jsx", "x = ", "<a>", "</a>")])
def test_deep_nesting_is_decided(lang, before, level, after):
    n = 6000
    end = {"java": ";}", "rs": "; }"}.get(lang, "\n")
    inner = "" if lang in ("js", "ts", "jsx", "rs") else "1"
    assert syntax.fault_of(before + level * n + inner + after * n + end, lang) == -1
    assert syntax.fault_of(before + level * n, lang) >= 0
    assert syntax.fault_of(before + level * n + inner + after * (n - 1) + end, lang) >= 0


def test_undecided_texts_stand_apart(spark, monkeypatch):
    monkeypatch.setattr(syntax, "MOST_FRAMES", 1000)
    assert syntax.fault_of("[" * 6000, "js") == syntax.UNDECIDED and syntax.fault_of("let a = 1;", "js") == -1
    assert syntax.fault_of("x = " + "(" * 6000, "py") >= 0 and syntax.fault_of("x = " + "(" * 6000 + "1" + ")" * 6000 + "\n", "py") == syntax.UNDECIDED
    [row] = next(syntax._check(iter([pa.RecordBatch.from_arrays([pa.array(["a/x.js"]), pa.array(["[" * 6000])], names=["path", "content"])]))).to_pylist()
    assert row["valid"] is None and row["cause"] == "undecided"
    rows = [("r", "go", None, "undecided"), ("r", "go", True, None), ("r", "go", False, "invalid"), ("s", "go", None, "undecided")]
    got = {r["repo"]: r for r in syntax.rates(spark.createDataFrame(rows, "repo string, language string, valid boolean, cause string")).collect()}
    assert (got["r"]["files"], got["r"]["invalid"], got["r"]["undecided"], got["r"]["rate"]) == (3, 1, 1, 0.5)
    assert (got["s"]["invalid"], got["s"]["undecided"], got["s"]["rate"]) == (0, 1, None)


def test_the_grammar_decides_python():
    """What the grammar accepts is valid, static rules about names aside; what it rejects the compiler may clear."""
    for t in ("def f(a, a):\n    pass\n", "def f():\n    x = 1\n    global x\n", "x = f'{y['a']}'\n"):
        assert syntax.fault_of(t, "py") == -1, t
    for t in ("f(a=1, b)\n", "yield 1\n", "await x\n", "x = \x02 1\n", "a == not b\n", "x = 1 +\n", "if x:\n\tpass\n  y\n"):
        assert syntax.fault_of(t, "py") >= 0, t
    for t in ("f(*a, b, c=1, *d, **e)\n", "x = not a or b and not c is not d\n", "y = (a not\\\n in b)\n", "x = [ # c\n 1, # d ]\n 2]\n", "def f():\n  \\\n  return 1\n", "if (n := f(x)) > 1: print(n)\n", "lambda *a, k=1: (yield)\n"):
        assert syntax.fault_of(t, "py") == -1, t


VERDICTS = [
    ("go", "package p\nfunc f() {\n\tif a {\n\t}\n\telse {\n\t}\n}\n", False), ("go", "package p\nfunc f() {\n\tif a {\n\t} else if b {\n\t} else {\n\t}\n\tx := []int{\n\t\t1,\n\t}\n\tg(a,\n\t\tb,\n\t)\n\ty := a +\n\t\tb\n\tz.\n\t\tm()\n}\n", True),
    ("go", "package p\nvar x = []int{\n\t1\n}\n", False), ("go", "package p\nvar x = f(1,\n\t2\n)\n", False), ("go", "package p\nvar x = (a\n+ b)\n", False), ("go", "package p\nfunc f() {\n\ta()\n\t.b()\n}\n", False),
    ("js", "const a;", False), ("js", "let a, b;", True), ("js", "let {a};", False), ("js", "for (const a of b) c();", True), ("js", "x = {get b(c) {}};", False), ("js", "x = {get b() {}, set b(c) {}, get: 1, set() {}};", True), ("js", "class A { set b() {} }", False),
    ("js", "if (x) let y = 1;", False), ("js", "while (x) const y = 1;", False), ("js", "if (x) { let y = 1; } else z();", True), ("js", "if (x) function f() {}", False), ("js", "delete x;", False), ("js", "delete x.y; delete x[0]; delete f().z;", True),
    ("ts", "const a: number;\ndeclare const b: string;\n", True), ("ts", "const a;", False), ("ts", "class A { get b(): number { return 1 } set b(v: number) {} }", True), ("ts", "if (x) let = 1;", True),
    ("java", "class A { f(int a) { return a; } }", False), ("java", "class A { A(int a) { } class B { B() { } } A() { } }", True), ("java", "class A { class B { A() { } } }", False), ("java", "interface I { I() { } }", False), ("java", "enum K { X; K() { } }", True),
    ("java", "record R(int x) { R { } R(int a, int b) { this(a); } }", True), ("java", "class A { int f(Object o) { return switch (o) { case P(int a, int b) when a > 1 -> a; case Q q when q.x() -> 2; default -> 3; }; } }", True),
    ("java", "class A { void f() { x.y; } }", False), ("java", "class A { void f() { x.y(); new T().z(); a[1].b(c).d(); i++; ++j; x = y; } }", True), ("java", "package a.switch.b;\nclass A { }", False),
]


@pytest.mark.parametrize("lang,text,valid", VERDICTS)
def test_verdicts(lang, text, valid):
    assert (syntax.fault_of(text, lang) == -1) == valid


def test_choices_of_tokens_are_one_pattern():
    from quillgraph.llm.peg import Grammar

    g = Grammar("Top <- (Kind | '+' | Word)* \nKind <- 'a' | 'ab'\nWord <- /[a-z]+/", trivia=r"\s+", operators="+ ++")
    assert g.check("a ab abc + a").ok and not g.check("a ++").ok and g.check("a ++").position == 2
    assert g.rules["Top"][1][0] == "term"


def argparse_like():
    import argparse

    return argparse


def test_check_files(spark):
    f = spark.createDataFrame([("a/x.ts", "r", None), ("a/x.ts", "r", None), ("a/y.py", None, None), ("a/z.md", "r", None), (None, "r", None), ("noext", "r", None), ("a/n.go", "r", None)], "path string, repo string, indexed_at timestamp").withColumn("valid", F.lit(0))
    t = spark.createDataFrame([("a/x.ts", "const = 1\nlet"), ("a/y.py", None), ("a/z.md", "("), ("a/n.go", "package p\r\n\r\nfunc f() {\r\n\tx(\r\n"), ("other.ts", "(")], "path string, content string")
    got = {r["path"]: r for r in syntax.check_files(f, t).collect()}
    assert set(got) == {"a/x.ts", "a/y.py", "a/n.go"} and got["a/y.py"]["valid"] and not got["a/x.ts"]["valid"]
    assert got["a/n.go"]["cause"] == "truncated"
    r = {(x["repo"], x["language"]): x["rate"] for x in syntax.rates(syntax.check_files(f, t)).collect()}
    assert r["r", "typescript"] == 1.0 and r[None, "python"] == 0.0
    assert syntax.check_files(f.limit(0), t).count() == 0


# 5 vectors


def _clusters(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    return (centres[rng.integers(0, len(centres), n)] + 0.25 * rng.standard_normal((n, dim))).astype(np.float32) * rng.uniform(0.1, 9, (n, 1)).astype(np.float32)


def test_vectors_recall(spark):
    x = _clusters(1500, 32, 1)
    rows = [(f"v{i:04}", 32, v.tolist()) for i, v in enumerate(x)]
    rows += [("twin1", 32, x[0].tolist()), ("twin2", 32, x[0].tolist()), ("nul", 32, None), ("zero", 32, [0.0] * 32), ("nan", 32, [float("nan")] * 32), ("short", 32, [1.0]), ("inf", 2, [float("inf"), 1.0]), ("p", 2, [1.0, 0.0]), ("q", 2, [2.0, 0.1]), (None, 2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "node_id string, dim int, vec array<float>").withColumn("cell", F.lit("clash"))
    index = vectors.VectorIndex(df)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T
    a, b = np.nonzero(np.triu(cos >= 0.9001, 1))
    want = {(f"v{i:04}", f"v{j:04}") for i, j in zip(a, b)}
    got = {(r["node_id_a"], r["node_id_b"]): r["cosine"] for r in index.pairs(0.9).collect()}
    assert len(want & set(got)) >= 0.99 * len(want) and all(c >= 0.9 for c in got.values())
    assert ("twin1", "twin2") in got and ("p", "q") in got and not {"nul", "zero", "nan", "short", "inf"} & {i for p in got for i in p}
    asked = index.coded.where("dim = 32 AND node_id LIKE 'v%' AND substr(node_id, 5, 1) = '0'")
    near = {}
    for r in index.neighbours(asked, k=5).collect():
        near.setdefault(r["node_id"], set()).add(r["neighbour_id"])
    hits = sum(len({f"v{j:04}" for j in np.argsort(-cos[int(i[1:])])[1:6]} & s) for i, s in near.items() if i != "v0000")
    assert hits >= 0.9 * 5 * (len(near) - 1)
    assert vectors.VectorIndex(df.limit(0)).pairs(0.9).count() == 0


def test_cells_follow_the_rows():
    cfg = vectors.AqConfig()
    for total in (1, 500, 10_000, 10**6, 10**7, 10**9, 10**12):
        sizes, depth = vectors.book_sizes(total, cfg.train_rows, cfg)
        cells = np.prod(sizes[:depth], dtype=float)
        assert len(sizes) >= cfg.books and total / cfg.cell_rows <= cells <= max(1, 2.1 * total / cfg.cell_rows)
    assert vectors.book_sizes(0, 1, cfg) == ([1, 1, 1, 1], 1)


def test_vectors_recall_in_divided_cells(spark):
    """Two codebooks divide the cells, as they do in large collections."""
    x = _clusters(3000, 32, 5)
    df = spark.createDataFrame([(f"v{i:04}", 32, v.tolist()) for i, v in enumerate(x)], "node_id string, dim int, vec array<float>")
    index = vectors.VectorIndex(df, vectors.AqConfig(cell_rows=10, cells_max=20))
    assert index.books[32][1] == 2
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T
    a, b = np.nonzero(np.triu(cos >= 0.9001, 1))
    want = {(f"v{i:04}", f"v{j:04}") for i, j in zip(a, b)}
    got = {(r["node_id_a"], r["node_id_b"]) for r in index.pairs(0.9).collect()}
    assert len(want & got) >= 0.99 * len(want)


def test_encoding_shrinks_the_error():
    x = vectors._unit(_clusters(600, 16, 2)).astype(np.float32)
    books, depth = vectors.fit_books(x, 600, vectors.AqConfig())
    assert depth == 1
    errors = [np.linalg.norm(x - vectors._decode(vectors.encode(x, books[:m], 4), books[:m]), axis=1).mean() for m in (1, 2, 4)]
    assert errors[0] > errors[1] > errors[2]


# 7 fusion


def test_borda(spark):
    rows = [("a", 1e9, 1.0), ("b", 1.0, 5.0), ("c", 1.0, None), ("d", float("nan"), 7.0), ("e", None, None)]
    df = spark.createDataFrame(rows, "node_id string, x double, y double").withColumn("part", F.lit(3)).withColumn("value", F.lit(1))
    got = {r["node_id"]: (round(r["points"], 6), r["place"]) for r in fusion.borda(df, {"x": 1.0, "y": 1.0}).collect()}
    x = {"a": 2.5 / 3, "b": 1 / 3, "c": 1 / 3, "d": 0.5, "e": 0.5}
    y = {"a": 0.5 / 3, "b": 0.5, "c": 0.5, "d": 2.5 / 3, "e": 0.5}
    want = {k: round((x[k] + y[k]) / 2, 6) for k in x}
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want)
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1][1])] == ["d", "a", "e", "b", "c"]
    assert fusion.borda(df.limit(0), {"x": 1.0}).count() == 0


# 8 leaks


def test_verbatim(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, "X ONE, two-three four\nfive six seven eight nine ten eleven; twelve y"), (2, item[4:40]), (3, None), (4, ""), (5, item), (5, item), (6, "é " + item.replace(" ", " é ", 1))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("h", F.lit(1)).withColumn("w", F.lit(1))
    i = spark.createDataFrame([(7, item), (8, "short"), (9, None)], "item_id bigint, text string")
    assert {tuple(r) for r in leaks.verbatim_leaks(d, i).collect()} == {(1, 7), (5, 7), (6, 7)}
    assert leaks.verbatim_leaks(d.limit(0), i).count() == 0 and leaks.verbatim_leaks(d, i.limit(0)).count() == 0


def test_latent(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefghijk") for _ in range(6)) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(30)) for i in range(5)]
    docs = [(i, say(120)) for i in range(150)]
    para = items[2][1].split()
    para[3], para[11] = "other", "words"
    docs += [(900, say(40) + " " + " ".join(para) + " " + say(40)), (901, items[4][1]), (902, None), (903, "")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items + [(99, None)], "item_id bigint, text string")
    model = leaks.LatentLeaks(d, i, leaks.LatentConfig(rank=48, features=1 << 10))
    assert leaks.LatentLeaks(d, i, leaks.LatentConfig(rank=48, features=1 << 10), item_block=2).leaks().select("doc_id", "item_id").exceptAll(model.leaks().select("doc_id", "item_id")).count() == 0
    got = {(r["doc_id"], r["item_id"]) for r in model.leaks().collect()}
    assert {(900, 2), (901, 4)} <= got and len(got) <= 6
    assert list(model.singular) == sorted(model.singular, reverse=True)
    assert leaks.LatentLeaks(d.limit(0), i, leaks.LatentConfig(rank=8, features=64)).leaks().count() == 0
    assert leaks.LatentLeaks(d, i.limit(0), leaks.LatentConfig(rank=8, features=64)).leaks().count() == 0


def test_latent_recall(spark):
    """Of verbatim runs, and of items with one word in eight replaced, at least nine in ten are found."""
    root, rng = "/root/testdata/sf0.01", random.Random(5)
    docs, items = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{root}/eval_items.parquet")
    host = [r["text"].split() for r in docs.where("length(text) > 400").limit(150).collect()]
    altered = []
    for n, r in enumerate(items.collect()):
        words = r["text"].split()
        if len(words) >= 30:
            at = rng.randint(0, len(words) - 30)
            part = [rng.choice(["thing", "other", "often", "made"]) if rng.random() < 1 / 8 else w for w in words[at : at + 30]]
            h = host[n % len(host)]
            altered.append((10**9 + n, r["item_id"], " ".join(h[:20] + part + h[20:])))
    more = spark.createDataFrame(altered, "doc_id bigint, item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.LatentLeaks(docs.unionByName(more.select("doc_id", "text")), items).leaks().collect()}
    verbatim = {tuple(r) for r in leaks.verbatim_leaks(docs, items).collect()}
    changed = {(d, i) for d, i, _ in altered}
    assert len(got & verbatim) >= 0.9 * len(verbatim) and len(got & changed) >= 0.9 * len(changed) and len(changed) > 30
    assert len(got - verbatim - changed) <= len(verbatim | changed)


def test_items_by_direction_lose_nothing():
    rng = np.random.default_rng(2)
    items, y = leaks._unit_rows(rng.standard_normal((200, 8))), leaks._unit_rows(rng.standard_normal((500, 8)))
    got = set(zip(*(x.tolist() for x in leaks._Items(items, 0.6).near(y)[:2])))
    assert got == set(zip(*(x.tolist() for x in np.nonzero(y @ items.T >= 0.6))))
    assert len(leaks._Items(np.zeros((0, 8)), 0.6).near(y)[0]) == 0


def test_lcs():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 15))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            prev = row[:]
            for j, y in enumerate(b):
                row[j + 1] = prev[j] + 1 if x == y else max(prev[j + 1], row[j])
        assert leaks.lcs_length(a, b) == row[-1]


# 9 mixing


def test_mixture(spark):
    rows = [(i, " Issue" if i % 3 else "ISSUE ", "word " * (5 + i % 7)) for i in range(400)] + [(1000 + i, "read-me", "text here " * 3) for i in range(20)] + [(2000, None, "x"), (2001, "none", "x"), (2002, "issue", None), (2003, "issue", "")]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("tokens", F.lit("clash")).withColumn("h", F.lit(0))
    t = spark.createDataFrame([("issue", 0.5, 1), ("read_me", 0.4, 3), ("gone", 0.1, 2), ("nil", None, None)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(d, t, total_tokens=1500)
    report = {r["source"]: r for r in m.report().collect()}
    copies = m.copies().collect()
    assert report["issue"]["quota"] == 750 and 700 < report["issue"]["tokens"] <= 750 and not report["issue"]["short"]
    assert report["read_me"]["tokens"] == 3 * report["read_me"]["available"] and report["read_me"]["short"]
    assert report["gone"]["tokens"] == 0 and report["nil"]["quota"] == 0 and report["gone"]["short"]
    assert max(r["copies"] for r in copies) == 3 and {r["source"] for r in copies} == {"issue", "read_me"}
    assert sum(r["tokens"] * r["copies"] for r in copies) == sum(r["tokens"] for r in report.values())
    assert mixing.Mixture(d.limit(0), t).copies().count() == 0 and mixing.Mixture(d, t.limit(0)).copies().count() == 0


def test_mixture_on_the_tables(spark):
    """Shares against a count in plain Python: no source takes more than its quota, nor less than it by more than its largest document."""
    root = "/root/testdata/sf0.01"
    d, t = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/mix_targets.parquet")
    m = mixing.Mixture(d, t)
    report, copies = m.report().collect(), m.copies().collect()
    enc = mixing._encoding(mixing.TOKENIZERS + "/byte_bpe_50k.tiktoken")
    name = lambda s: "_".join((s or "").strip().lower().replace("-", " ").split()) or None
    sizes = {r["doc_id"]: (name(r["source"]), len(enc.encode_ordinary(r["text"])) if r["text"] else 0) for r in d.collect()}
    targets = {}
    for r in t.collect():
        if name(r["source"]):
            share, cap = targets.get(name(r["source"]), (0.0, 1))
            targets[name(r["source"])] = (share + (r["target_share"] if r["target_share"] and r["target_share"] > 0 else 0.0), max(cap, r["max_repeats"] or 1))
    total = sum(n for s, n in sizes.values() if s in targets)
    taken = {}
    for c in copies:
        source, n = sizes[c["doc_id"]]
        assert (c["source"], c["tokens"]) == (source, n) and 1 <= c["copies"] <= targets[source][1]
        taken[source] = taken.get(source, 0) + n * c["copies"]
    assert {r["source"] for r in report} == set(targets)
    for r in report:
        share, cap = targets[r["source"]]
        own = [n for s, n in sizes.values() if s == r["source"]]
        quota = int(share / sum(x for x, _ in targets.values()) * total)
        goal = min(quota, sum(own) * cap)
        assert abs(r["quota"] - quota) <= 1 and r["tokens"] == taken.get(r["source"], 0)
        assert goal - max(own, default=0) - 1 <= r["tokens"] <= goal + 1, r["source"]


# 10 abuse

ABUSIVE = ["You are a complete idiot.", "you are too s t u p i d to breathe", "What kind of m0r0n reviews like this?", "Y.o.u are a f**l", "I will break your fingers", "Send me nud35 and I approve", "Du bist ein Vollidiot!", "Ferme ta gueule",
           "Foreigners are vermin.", "Shut up, you wоrthlеss clown", "Listen halfwit: leave", "eres un imbéééécil", "hope you die soon"]
CLEAN = ["What a stupid bug.", "I am an idiot, I forgot to push", 'A comment reading "you are a pathetic loser" was removed by the moderators', "Kill the process and reap its children", "`const blocked = [\"moron\", \"nudes\"]` is the list",
         "Do not call anyone a moron or an imbecile", "Naked pointers are banned", "You are not an idiot", "The slave was shot in the head by the watchdog", "", None, "Thank you, nice work"]


def test_abuse_sentences():
    g = abuse.grammar()
    for t in ABUSIVE:
        assert g.score("See the notes. " + t + "\nThanks.")[0] >= abuse.MARK, t
    for t in CLEAN:
        assert g.score(t)[0] < abuse.MARK, t


#: Sentences of other making than the tables', for what the grammar's parts are meant to reach.
HELD_OUT_ABUSIVE = ["She is a worthless bitch.", "he is an idiot", "All the Jews should be gassed.", "You are a total waste of oxygen.", "You’re such a moron", "are you retarded?", "fuck you", "go kill yourself", "I'm going to kill you",
                    "this reviewer is a moron", "whoever wrote this is a complete imbecile", "people like you are the problem", "Kill all Muslims", "a potato has more sense than you", "send me a naked picture", "I want to squeeze your ass", "immigrants are parasites",
                    "women are too stupid to code", "nobody loves you", "you piece of trash", "Du bist ein Idiot", "eres una puta", "tu es un connard", "we will break your legs", "I know where you sleep", "hope you rot", "Black people are inferior", "deport all the Mexicans home",
                    "you f*****g idiot, you are an id1ot", "keep thinking of her naked", "everybody hates you", "with a mind like yours you should not code", "hey moron, fix it", "what an absolute imbecile"]
HELD_OUT_CLEAN = ["your old rat died", "your pig is healthy", "those are animals", "I will hit you up later", "I will end your subscription today.", "We will crush you at chess", "show me the nude color palette", "can you trash the folder", "this piece of garbage compiler",
                  "they only multiply the matrices", "threads never wake up", "any idiot could do this", "you are not stupid", "I will shoot you an email", "what a stupid bug", "what a stupid deep bug", "Comments such as you are an idiot are not allowed here.", "kill the child process",
                  "you are dead right", "the patch is trash", "send the women's team report back to me", "I know where you are coming from", "blind people cannot read this table", "You can beat the cache", "the old man page is useless", "I will cut you a branch", "black boxes are useless",
                  "they should be eliminated in the next pass", "you should kick off the job", "the dog is in the picture", "your face recognition works", "I hate this API", "we will break your build if you skip this"]


def test_abuse_held_out():
    g = abuse.grammar()
    assert [t for t in HELD_OUT_ABUSIVE if g.score(t)[0] < abuse.MARK] == []
    assert [t for t in HELD_OUT_CLEAN if g.score(t)[0] >= abuse.MARK] == []


def test_abuse_after_a_match_that_does_not_count():
    g = abuse.grammar()
    for t in ("I will not hurt you, I will kill you.", "You are not stupid, you are worthless.", 'The filter removed "you are worthless" but you are worthless.', "you are not dumb " * 500 + "you are dumb"):
        assert g.score(t)[0] >= abuse.MARK, t
    for t in ("You are not stupid, you are not worthless.", 'The filter removed "you are worthless" and "you are stupid".', "you are not dumb " * 500):
        assert g.score(t)[0] == 0, t
    assert g.score("You are dumb, you are dumb")[0] == g.score("You are dumb")[0]


def test_abuse_table(spark):
    rows = [(i, t, "Issue ") for i, t in enumerate(ABUSIVE)] + [(100 + i, t, None) for i, t in enumerate(CLEAN)] + [(0, ABUSIVE[0], "issue"), (500, "fine text. " * 20_000 + ABUSIVE[0], " ")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("score", F.lit("clash"))
    got = abuse.score_documents(d)
    assert {r["doc_id"] for r in got.where(F.col("score") >= 1).collect()} == {*range(len(ABUSIVE)), 500}
    r = {x["source"]: (x["documents"], x["abusive"]) for x in abuse.rates(got).collect()}
    assert r == {"issue": (len(ABUSIVE) + 1, len(ABUSIVE) + 1), None: (len(CLEAN) + 1, 1)}
    assert abuse.score_documents(d.limit(0)).count() == 0


def test_abuse_against_labels(spark):
    """Labels are noisy; of documents that all labellers agree on, nine in ten must agree with the score."""
    root = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{root}/abuse_labels.parquet").groupBy("doc_id").agg(F.min("abusive").alias("lo"), F.max("abusive").alias("hi")).where("lo = hi")
    scored = abuse.score_documents(spark.read.parquet(f"{root}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi"))
    rows = scored.join(labels, "doc_id").select((F.col("score") >= 1).cast("int").alias("got"), "lo").collect()
    assert sum(r["got"] == r["lo"] for r in rows) >= 0.95 * len(rows)
    assert sum(r["got"] and r["lo"] for r in rows) >= 0.85 * sum(r["lo"] for r in rows)
