"""Source trees through the whole engine: golden call edges, a generated repository, incremental runs, the stream."""

import io
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quillgraph import cli, config, server
from quillgraph.engine import Engine
from quillgraph.operators import extract, reader
from quillgraph.streaming import changelog

SOURCES = {
    "ts/people.ts": "export class PersonStore {\n  readName(): string {\n    return 'p';\n  }\n  show(): string {\n    return this.readName();\n  }\n}\n\nexport class GoodsStore {\n  readName(): string {\n    return 'g';\n  }\n  tag(): string {\n    return this.readName();\n  }\n}\n",
    "ts/web.ts": "import { PersonStore } from './people';\n\nconst people = new PersonStore();\n\nexport function whoAmI(): string {\n  return people.show();\n}\n",
    "ts/picks.ts": "import { PersonStore, GoodsStore } from './people';\n\nexport function choosePerson(): string {\n  const it = new PersonStore();\n  return it.readName();\n}\n\nexport function chooseGoods(): string {\n  const it = new GoodsStore();\n  return it.readName();\n}\n",
    "py/sums.py": "def plus(a, b):\n    return a + b\n\n\ndef total(a, b):\n    return plus(a, b)\n",
    "go/main.go": "package main\n\nimport \"fmt\"\n\nfunc assist() int {\n\treturn 1\n}\n\nfunc launch() int {\n\treturn assist()\n}\n\nfunc main() {\n\tfmt.Println(launch())\n}\n",
    "java/Sums.java": "class Sums {\n    int plus(int a, int b) {\n        return a + b;\n    }\n\n    int total(int a, int b) {\n        return plus(a, b);\n    }\n}\n",
    "rust/main.rs": "fn assist() -> i32 {\n    1\n}\n\nfn launch() -> i32 {\n    assist()\n}\n\nfn main() {\n    launch();\n}\n",
    "docs/notes.md": "Notes on PersonStore and the TOTAL of sums.\n",
    "app/routes.ts": "app.get('/people', listPeople);\n\nexport function listPeople() {\n  return 1;\n}\n",
    "node_modules/skip.js": "function skipped() {}\n",
}

#: (caller, callee, callee's parent, confidence); the file of both ends follows from the names.
GOLDEN = {
    ("show", "readName", "PersonStore", 1.0), ("tag", "readName", "GoodsStore", 1.0), ("whoAmI", "show", "PersonStore", 0.9), ("choosePerson", "readName", "PersonStore", 0.95),
    ("chooseGoods", "readName", "GoodsStore", 0.95), ("total", "plus", None, 0.95), ("total", "plus", "Sums", 0.95), ("launch", "assist", None, 0.95), ("main", "launch", None, 0.95),
}


def _write(root, files):
    for name, body in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body, encoding="utf-8")


def _calls(engine):
    n = engine.nodes()
    a, b = n.select(F.col("id").alias("from_id"), F.col("name").alias("caller"), F.col("file_path").alias("fa")), n.select(F.col("id").alias("to_id"), F.col("name").alias("callee"), "parent", F.col("file_path").alias("fb"))
    return engine.edges().where("kind = 'calls'").join(a, "from_id").join(b, "to_id").select("caller", "callee", "parent", "confidence", "fa", "fb").collect()


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    _write(root, SOURCES)
    e = Engine(spark, str(root))
    return e, e.index(), root


def test_golden_edges(indexed):
    e, stats, _ = indexed
    assert (stats["scanned"], stats["added"], stats["changed"], stats["removed"]) == (9, 9, 0, 0)
    rows = _calls(e)
    got = {(r["caller"], r["callee"], r["parent"], r["confidence"]) for r in rows}
    assert got == GOLDEN
    assert len(rows) == 11 and all(r["fa"].split("/")[0] == r["fb"].split("/")[0] for r in rows)
    assert sum(r["confidence"] for r in rows) / 11 == pytest.approx(10.5 / 11)


def test_questions(indexed):
    e, _, _ = indexed
    assert [r["handler"] for r in e.routes().collect()] == ["listPeople"]
    linked = e.edges().where("kind = 'documents'").count()
    assert linked == 4  # PersonStore, Sums, and both symbols called total
    assert e.find("readName person", 5).count() == 5
    assert "readName" in e.context("readName").head()["formatted"]
    assert {r["name"] for r in e.impact("readName").collect()} >= {"show", "tag", "whoAmI", "choosePerson"}
    assert e.important_symbols(3).count() == 3
    assert "tag" in {r["name"] for r in e.dead_code().collect()}
    assert e.neighborhood("PersonStore")[0].count() >= 2
    assert [s["to"] for s in e.trace_flow("whoAmI")] == ["show", "readName"]
    m = e.metrics()
    assert m["total"] == 11 and m["files"] == 9 and m["merkleRoot"]
    assert e.render_graph("dot").startswith("digraph") and "<html>" in e.render_graph()


def test_cli(indexed, spark):
    e, _, root = indexed
    out = io.StringIO()
    for args in (["stats"], ["routes"], ["search", "total"], ["trace", "whoAmI"], ["impact", "plus"], ["repomap"], ["deadcode"], ["context", "plus"], ["export", "--format", "json"], ["init"], ["metrics"]):
        assert cli.run(["--root", str(root), *args], spark, out) == 0
    assert "listPeople" in out.getvalue()
    (root / config.CONFIG_NAME).unlink()


def test_server(indexed):
    e, _, _ = indexed
    ask = lambda method, **params: {"jsonrpc": "2.0", "id": 1, "method": method, "params": params}
    lines = [ask("initialize"), {"jsonrpc": "2.0", "method": "notifications/initialized"}, ask("tools/list"), ask("tools/call", name="routes"), ask("tools/call", name="search", arguments={}), ask("tools/call", name="none"), ask("none")]
    out = io.StringIO()
    server.serve(e, io.StringIO("\n".join(map(json.dumps, lines)) + "\n{\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(got) == 7 and got[0]["result"]["serverInfo"]["name"] == "quillgraph" and len(got[1]["result"]["tools"]) == 10
    assert "listPeople" in got[2]["result"]["content"][0]["text"] and got[3]["result"]["isError"] and got[4]["error"]["code"] == -32602 and got[5]["error"]["code"] == -32601 and got[6]["error"]["code"] == -32700


def test_modes():
    cfg = config.Config(root=".")
    assert config.effective_modes(cfg, 10) == {"mode": "single", "parsing": "inline"} and config.effective_modes(cfg, 3000) == {"mode": "monorepo", "parsing": "workers"}
    assert config.effective_modes(config.Config(root=".", mode="monorepo", parsing="inline"), 9999) == {"mode": "monorepo", "parsing": "inline"}


def test_incremental_equals_full(spark, tmp_path):
    def tree(n):
        return {f"m{i}.ts": f"import {{ Unit{(i + 1) % n} }} from './m{(i + 1) % n}';\nexport class Unit{i} {{\n  compute{i}() {{\n    return this.helper{i}() + this.dep.value{(i + 1) % n}();\n  }}\n  helper{i}() {{\n    return 1;\n  }}\n  value{i}() {{\n    return 2;\n  }}\n}}\nexport function run{i}() {{\n  const it = new Unit{i}();\n  return it.compute{i}();\n}}\n" for i in range(n)}

    n = 5
    _write(tmp_path / "a", tree(n))
    e = Engine(spark, str(tmp_path / "a"))
    e.index()
    kinds = {r["kind"]: r["count"] for r in e.store.read("nodes").groupBy("kind").count().collect()}
    assert kinds == {"file": n, "import": n, "class": n, "method": 3 * n, "function": n}
    edges = {r["kind"]: r["count"] for r in e.edges().groupBy("kind").count().collect()}
    assert edges == {"contains": 5 * n, "imports": n, "calls": 3 * n}
    assert sorted(r["confidence"] for r in e.edges().where("kind = 'calls'").collect()) == [0.9] * n + [0.95] * n + [1.0] * n
    before = {tuple(r) for r in e.edges().where("kind = 'calls'").collect()}
    (tmp_path / "a/m0.ts").write_text(tree(n)["m0.ts"] + "// more\n")
    folders = e.store.meta()["tables"]["nodes"]
    again = e.index()
    now = e.store.meta()["tables"]["nodes"]
    assert set(now) == set(folders) and [b for b in now if now[b] != folders[b]] == [str(b) for b in e.store.buckets(spark.createDataFrame([("m0.ts",)], "path string"))]
    assert (again["added"], again["changed"], again["removed"]) == (0, 1, 0)
    # the file, those that call what it has, and those that import it; not all of them
    assert 1 <= e.affected < n
    assert {tuple(r) for r in e.edges().where("kind = 'calls'").collect()} == before
    (tmp_path / "a/m1.ts").unlink()
    assert e.index()["removed"] == 1
    _write(tmp_path / "b", {k: (tmp_path / "a" / k).read_text() for k in tree(n) if k != "m1.ts"})
    full = Engine(spark, str(tmp_path / "b"))
    full.index()
    pick = lambda x: sorted(map(repr, x.edges().collect()))
    assert pick(e) == pick(full)
    assert e.index()["changed"] == 0


def test_stream_equals_index(spark, tmp_path):
    _write(tmp_path / "src", {k: v for k, v in SOURCES.items() if k.startswith("ts/")})
    whole = Engine(spark, str(tmp_path / "src"))
    whole.index()
    log = tmp_path / "log"
    live = Engine(spark, str(tmp_path / "empty"))
    told = []
    rows = [(k, "upsert", "stale" if i == 0 else v, i, None) for i, (k, v) in enumerate(SOURCES.items()) if k.startswith("ts/")]
    rows += [("ts/people.ts", "upsert", SOURCES["ts/people.ts"], 90, None), ("ts/gone.ts", "upsert", "x", 91, None), ("ts/gone.ts", "remove", None, 92, None)]
    spark.createDataFrame(rows, changelog.LOG_SCHEMA).coalesce(1).write.parquet(str(log))
    q = live.follow(str(log), on_batch=told.append)
    q.awaitTermination(120)
    assert told and told[0]["upserts"] == 3 and told[0]["removes"] == 1
    pick = lambda x: sorted(map(repr, x.edges().collect()))
    assert pick(live) == pick(whole)


def test_stateful_change_detection(spark, tmp_path):
    rows = [("a", "upsert", "1", 1, None), ("a", "upsert", "1", 2, None), ("a", "upsert", "2", 3, None), ("b", "remove", None, 4, None), ("a", "remove", None, 5, None), (None, "upsert", "x", 6, None)]
    spark.createDataFrame(rows, changelog.LOG_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "log"))
    q = changelog.real_changes(changelog.read_log(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["path"], r["op"]) for r in spark.table("changes").collect()] == [("a", "upsert"), ("a", "upsert"), ("a", "remove")]


def _read(path, language, text):
    p = reader.parse_text(path, language, text)
    names = {n[0]: n[2] for n in p.nodes}
    return {(n[1], n[2]): json.loads(n[9] or "{}") for n in p.nodes[1:]}, {(names[s[1]], s[3], s[2]) for s in p.sites}


TS = """import type {
  B } from "b";
export class Foo<T> extends Bar.Baz<T> implements Qux, Quux<string> {
  q = /["{]/;
  private handler = (e: Event): void => { this.run(e); };
  async m<T>(a: { b: (x: number) => void }): Promise<T> { return helper(a)!; }
  abstract n(): void;
}
interface I extends J { f(x: number): void; cb: (e: number) => void }
type X = { a: (b: number) => void };
const h: Fn = (a) => a.b().c(2);
const obj = { k: function () { one(); }, l: (z) => two(z), mm() { three(); }, n: 3 };
exports.w = function () { four(); };
function after() { map.delete(five()); }
"""


def test_reading_typescript():
    got, calls = _read("a.ts", "typescript", TS)
    assert got["class", "Foo"]["supers"] == ["Baz", "Qux", "Quux"] and got["interface", "I"]["supers"] == ["J"]
    assert {k for k in got if k[0] == "method"} == {("method", "m")} and got["method", "m"]["parent"] == "Foo"
    assert {k[1] for k in got if k[0] == "function"} == {"handler", "h", "k", "l", "mm", "w", "after"} and got["function", "handler"]["parent"] == "Foo" and ("import", "b") in got
    assert calls == {("handler", "this", "run"), ("m", None, "helper"), ("h", "a", "b"), ("h", "a.b()", "c"), ("k", None, "one"), ("l", None, "two"), ("mm", None, "three"), ("w", None, "four"), ("after", "map", "delete"), ("after", None, "five")}


@pytest.mark.parametrize(
    "ext,language,text,names,supers,calls",
    [
        ("java", "java", "import a.B;\npublic class C<T> extends D<T> implements E, F<G> {\n  C() { super(); }\n  public <R> R map(Fn<T, R> f) { return f.apply(this.get()); }\n}\nrecord P(int x) implements Q { int two() { return x; } }\n", {"C", "map", "P", "two"}, {"C": ["D", "E", "F"], "P": ["Q"]}, {("map", "f", "apply"), ("map", "this", "get")}),
        ("cpp", "cpp", "#include <v>\nclass A : public B, private C<D> { public: A(int x) : x_(x) { init(); } int get() const { return x_; } };\nint A::go(int a) { return help(a); }\nvoid top(void) { s->m(1); }\n", {"A", "get", "go", "top"}, {"A": ["B", "C"]}, {("A", None, "init"), ("go", None, "help"), ("top", "s", "m")}),
        ("cs", "csharp", "using S.T;\nclass A : B, IC<D> { public int G() => H(1); async Task<int> J<T>(T x) where T : new() { return await K(x); } }\n", {"A", "G", "J"}, {"A": ["B", "IC"]}, {("G", None, "H"), ("J", None, "K")}),
        ("rb", "ruby", "require 'x'\nclass A < B::C\n  def f(x)\n    g(x) if x\n    if y\n      h(1)\n    end\n  end\n  def self.k?\n    l()\n  end\nend\ndef top; m(2); end\n", {"A", "f", "k?", "top"}, {"A": ["C"]}, {("f", None, "g"), ("f", None, "h"), ("k?", None, "l"), ("top", None, "m")}),
        ("kt", "kotlin", "import a.b\nclass K(val x: Int) : L(x), M {\n  fun roll(): Int {\n    return stop(x)\n  }\n  fun one() = two()\n}\n", {"K", "roll", "one"}, {"K": ["L", "M"]}, {("roll", None, "stop"), ("one", None, "two")}),
        ("rs", "rust", "use a::b;\npub trait T: U { fn d(&self) -> i32 { self.e() } }\nimpl<'a> T for S<'a> { fn f(&self) { let c = 'x'; S::new(); } }\n", {"T", "d", "S", "f"}, {"T": ["U"], "S": ["T"]}, {("d", "self", "e"), ("f", "S", "new")}),
        ("php", "php", "<?php\nuse A\\B;\nclass C extends D implements E { public function f($x) { return $this->g($x); } }\n", {"C", "f"}, {"C": ["D", "E"]}, {("f", "$this", "g")}),
        ("swift", "swift", "import U\nclass A: B, C {\n  func f(_ x: Int) -> Int { return g(x) }\n}\n", {"A", "f"}, {"A": ["B", "C"]}, {("f", None, "g")}),
        ("scala", "scala", "import a.b\nclass A(x: Int) extends B(x) with C {\n  def f(y: Int): Int = g(y)\n}\n", {"A", "f"}, {"A": ["B", "C"]}, {("f", None, "g")}),
        ("py", "python", "class A(Base):\n    def f(self):\n        self.g()\n    def g(self:\n        h(1)\n", {"A", "f", "g"}, {"A": ["Base"]}, {("f", "self", "g"), ("g", None, "h")}),
    ],
)
def test_reading_languages(ext, language, text, names, supers, calls):
    got, found = _read(f"a.{ext}", language, text)
    assert {k[1] for k in got if k[0] != "import"} == names and {k[1]: v["supers"] for k, v in got.items() if "supers" in v} == supers
    assert found == calls and (language == "python" or [k for k in got if k[0] == "import"])


def test_reading_is_linear_and_never_fails():
    times = []
    for n in (2000, 16000):
        text = "\n".join(f"function f{i}() {{ return g{i}(); }}" for i in range(n))
        began = time.process_time()
        assert len(reader.parse_text("a.ts", "typescript", text).nodes) == n + 1
        times.append(time.process_time() - began)
    assert times[1] < 20 * times[0]
    rng = random.Random(1)
    for language in [*reader.LANGUAGES, "unknown"]:
        for _ in range(40):
            text = "".join(rng.choice(["class ", "def ", "function ", "(", ")", "{", "}", "a", " b", "\n", "'", '"', "/*", "=>", "=", ":", "<", ">", ",", ";", "impl ", "type ", "end ", "if "]) for _ in range(60))
            assert "error" not in json.loads(reader.parse_text("x", language, text).nodes[0][9] or "{}"), (language, text)

    def broken(out, text):
        raise RuntimeError("no")

    reader.register("toy", broken)
    assert "RuntimeError" in reader.parse_text("x", "toy", "text").nodes[0][9]
    reader.register("toy", lambda out, text: bool(out.symbol("function", "t", 1, 1)))
    assert [n[2] for n in reader.parse_text("x", "toy", "text").nodes] == ["x", "t"]
    del reader.READERS["toy"]


def test_extraction_details(spark):
    texts = {
        "r.py": "@app.get('/x')\ndef handler():\n    return run()\n", "Api.java": "class Api {\n  @GetMapping(\"/y\")\n  String show() { return build(); }\n}\n",
        "broken.py": "class A(Base):\n    def f(self):\n        self.g()\n    def g(self:\n", "k.kt": "class K {\n  fun roll() {\n    stop()\n  }\n}\n", "long.ts": "function big() {\n" + "  step();\n" * 80 + "}\n", "e.ts": "",
        "pic.png": "", "u.xyz": "plain text\n",
    }
    df = spark.createDataFrame([(k, v) for k, v in texts.items()] + [(None, "x")], "path string, text string").withColumn("id", F.lit(1))
    got = extract.parse_files(df)
    rows = {(r["kind"], r["name"]): r for r in got["nodes"].collect()}
    assert json.loads(rows["route", "GET /x"]["meta"])["handlerName"] == "handler" and ("route", "GET /y") in rows
    assert json.loads(rows["class", "A"]["meta"])["supers"] == ["Base"] and ("method", "f") in rows and ("method", "roll") in rows
    assert rows["function", "big"]["snippet"].count("\n") == 60 and rows["asset", "pic.png"]["snippet"] is None
    assert {(r["callee_name"], r["receiver"]) for r in got["call_sites"].collect()} >= {("run", None), ("build", None), ("g", "self"), ("stop", None), ("step", None)}
