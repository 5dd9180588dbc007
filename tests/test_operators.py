"""Units and small fixtures of the core operators."""

import datetime as dt
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import ids, text
from quillgraph.operators import changes, graph, orphans, render, resolve, search, skew, tables
from quillgraph.sources import scan

T = dt.datetime(2025, 1, 1)
DAY = dt.timedelta(days=1)
NODE = "id string, kind string, name string, file_path string, language string, start_line int, end_line int, signature string, snippet string, meta string, parent string"
EDGE = "id string, kind string, from_id string, to_id string, confidence double, file_path string"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).head()["x"]


def nodes(spark, rows):
    full = [(i, k, n, p, "typescript", line, line + 1, sig, snip, json.dumps(meta) if meta else None, (meta or {}).get("parent")) for i, k, n, p, line, sig, snip, meta in rows]
    return spark.createDataFrame(full, NODE)


def test_literal_values(spark):
    assert one(spark, ids.content_hash(F.lit("a"), F.lit("b"))) == "97d6f5d51e5815cdf64cc9935b8d73c50bd906a2"
    assert one(spark, text.fnv1a(F.lit("abc"))) == 440920331
    assert [one(spark, text.token_estimate(F.lit(t))) for t in ("", "a b")] == [0, 2]
    assert one(spark, text.token_estimate(F.lit(None).cast("string"))) == 0
    assert text.query_terms("a_b the x!") == [["a", "b"], ["the"]]
    assert [text.porter_stem(w) for w in ("caresses", "ponies", "hopping", "relational", "happy", "callers", "agreed", "adjustment")] == [
        "caress", "poni", "hop", "relat", "happi", "caller", "agre", "adjust"
    ]


def test_language_and_excludes(spark):
    rows = [("a/B.TS", "typescript"), ("x.md", "markdown"), ("Makefile", "unknown"), (".py", "unknown"), ("q/r.tar.gz", "unknown"), ("s.r", "r")]
    got = spark.createDataFrame(rows, "path string, want string").select("want", scan.detect_language(F.col("path")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)
    import re

    rx = re.compile(scan.exclusion_pattern(scan.DEFAULT_EXCLUDES))
    assert [bool(rx.search(p)) for p in ("a/node_modules/x.js", "dist/x", "src/distance.ts", "a/b.min.js", "x.map", "map/x")] == [True, True, False, True, True, False]


def test_scan(spark, tmp_path):
    for name, body in (("a/x.py", "def f():\n  pass\n"), ("node_modules/y.js", "1"), ("big.txt", "x" * 50), ("doc.md", "hi é+ö")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body, encoding="utf-8")
    got = scan.scan_files(spark, str(tmp_path), max_bytes=40)
    assert sorted(r["path"] for r in got.select("path").collect()) == ["a/x.py", "doc.md"]
    assert {r["path"]: r["text"] for r in scan.readable(got).collect()}["doc.md"] == "hi é+ö"


def test_snapshots_and_merkle(spark):
    a = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "3")], "path string, hash string")
    b = spark.createDataFrame([("p", "1"), ("q", "9"), ("s", "4")], "path string, hash string")
    assert {tuple(r) for r in changes.snapshot_diff(a, b).collect()} == {("q", "changed"), ("r", "removed"), ("s", "added")}
    assert changes.snapshot_diff(a, a).count() == 0
    import hashlib

    h = lambda *x: hashlib.sha1(("".join(x) + "\0").encode()).hexdigest()
    leaves = [h("p", "1"), h("q", "2"), h("r", "3")]
    assert changes.merkle_root(a) == h(h(leaves[0], leaves[1]), h(leaves[2], leaves[2]))
    assert changes.merkle_root(a.limit(0)) == h("empty")
    assert {r["path"]: r["changed"] for r in changes.set_leaves(a, b.unionByName(spark.createDataFrame([("r", None)], "path string, hash string"))).collect()} == {"p": False, "q": True, "s": True, "r": True}


@pytest.mark.parametrize("n", [1, 2, 5, 8, 9, 31, 33, 64, 65, 100])
def test_merkle_in_blocks(spark, monkeypatch, n):
    import hashlib

    monkeypatch.setattr(changes, "LEVELS", 3)
    files = [(f"f{i:03}", str(i)) for i in range(n)]
    h = lambda *x: hashlib.sha1(("".join(x) + "\0").encode()).hexdigest()
    level = [h(*f) for f in files]
    while len(level) > 1:
        level = [h(level[i], level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
    assert changes.merkle_root(spark.createDataFrame(files, "path string, hash string").repartition(3)) == level[0]


def test_orphans(spark):
    parents = spark.createDataFrame(
        [("a", T, None), ("a", T, None), ("b", T, T + 2 * DAY), ("c", T + 5 * DAY, None), ("d", None, None), (None, T, None), ("e", T + 3 * DAY, T + DAY)],
        "id string, indexed_at timestamp, deleted_at timestamp",
    )
    refs = spark.createDataFrame(
        [("1", " A\t", T), ("2", "b", T + DAY), ("3", "b", T + 2 * DAY), ("4", "c", T), ("5", "zz", T), ("6", " \n", T), ("7", None, T), ("8", "d", T), ("9", "a", None), ("10", "e", T + 4 * DAY), ("1", "a", T)],
        "id string, ref string, indexed_at timestamp",
    ).withColumn("_salt", F.lit("clash"))
    field = orphans.RefField("t", "ref", "id")
    got = orphans.orphan_references(orphans.references({"t": refs}, [field]), parents, share=0.01).collect()
    assert {r["record_key"]: r["status"] for r in got} == {"3": "deleted", "4": "late", "5": "missing", "8": "late", "9": "late", "10": "deleted"}
    assert orphans.orphan_references(orphans.references({"t": refs.limit(0)}, [field]), parents).count() == 0
    assert {r["status"] for r in orphans.orphan_references(orphans.references({"t": refs}, [field]), parents.limit(0)).collect()} == {"missing"}


def test_key_profile(spark):
    rows = [("k", f"c{i % 7}", 0.5 if i % 2 else 0.9, "2025-01") for i in range(300)] + [("k", None, float("nan"), None), (" ", "c", 1.0, "2025-02"), (None, "c", 1.0, "2025-02"), ("m", "c", 7.0, "2025-03")]
    df = spark.createDataFrame(rows, "key string, value string, n double, what string")
    got = {r["key_value"]: r for r in skew.key_profile(df, "key", callers=F.col("value"), confidence=F.col("n"), months=F.col("what"), share=0.02).collect()}
    assert set(got) == {"k", "m"}
    k = got["k"]
    assert (k["n_rows"], k["n_callers"], k["n_months"], k["busiest_month"], k["heavy"]) == (301, 7, 1, "2025-01", True)
    assert abs(k["mean_confidence"] - 0.7) < 1e-9 and abs(k["median_confidence"] - 0.7) < 1e-9
    assert got["m"]["mean_confidence"] is None and not got["m"]["heavy"]
    assert skew.key_profile(df.limit(0), "key", callers=F.col("value"), confidence=F.col("n"), months=F.col("what")).count() == 0


def test_medians_by_ranges(spark):
    rng = random.Random(4)
    rows = [(f"k{i % 5}", rng.choice([0.0, 1.0, 0.5, 0.5000001, rng.random(), rng.random() / 5000, rng.random() ** 9]), rng.randint(1, 4)) for i in range(400)]
    rows += [("one", 1.0, 1), ("two", 0.0, 1), ("two", 1.0, 1), ("even", 0.25, 7), ("even", 0.75, 7), ("near", 0.3, 1), ("near", 0.3 + 1e-12, 1)]
    df = spark.createDataFrame(rows, "key string, v double, n bigint")
    want = {}
    for k, v, n in rows:
        want.setdefault(k, []).extend([v] * n)
    got = {r["key"]: r["median"] for r in skew.weighted_medians(df).collect()}
    assert got == {k: pytest.approx((sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2, abs=0) for k, v in want.items()}
    assert skew.weighted_medians(df.limit(0)).count() == 0


def test_hot_references_are_spread(spark):
    refs = spark.createDataFrame([(str(i), "hot" if i % 3 else None if i % 2 else f"r{i}", T + i * DAY) for i in range(600)], "record_key string, ref string, at timestamp")
    parents = spark.createDataFrame([("hot", T, T + 100 * DAY), ("hot", T + 200 * DAY, None), ("r6", T + 9 * DAY, None)], "id string, indexed_at timestamp, deleted_at timestamp")
    heavy = {r["ref"]: r["parts"] for r in skew.heavy_keys(refs, "ref", 0.01).collect()}
    assert heavy == {"hot": 67}
    got = {int(r["record_key"]): r["status"] for r in orphans.classify_references(refs, parents).collect()}
    assert len(got) == 600 and all(got[i] == ("deleted" if 100 <= i < 200 else "live") for i in range(600) if i % 3)
    assert got[6] == "late" and got[12] == "missing"


def _graph(spark):
    n = nodes(spark, [(i, "function", i, f"{i}.ts", 1, None, None, None) for i in "abcdef"] + [("r", "route", "GET /x", "a.ts", 5, None, None, {"handlerName": "a"})])
    e = spark.createDataFrame([(f"{k}{a}{b}", k, a, b, c, f"{a}.ts") for k, a, b, c in [("calls", "a", "b", 0.9), ("calls", "b", "c", 0.8), ("calls", "c", "a", 0.5), ("calls", "a", "d", 0.95), ("handles", "r", "a", 0.95), ("calls", "d", "zz", 1.0)]], EDGE)
    return n, e


def test_graph(spark):
    n, e = _graph(spark)
    assert {r["id"]: r["depth"] for r in graph.impact(n, e, "c").collect()} == {"b": 1, "a": 2, "c": 3}
    near, used = graph.neighborhood(n, e, n.where("id = 'a'"), 1)
    assert sorted(r["id"] for r in near.collect()) == ["a", "b", "c", "d", "r"]
    assert used.count() == 4
    assert graph.neighborhood(n, e, n.where("id = 'nope'"), 2)[0].count() == 0
    assert [(s["from"], s["to"], s["depth"]) for s in graph.trace_flow(n, e, "a")] == [("a", "d", 1), ("a", "b", 1), ("b", "c", 2), ("c", "a", 3)]
    assert graph.trace_flow(n, e, "none") == []
    assert sorted(r["id"] for r in graph.dead_code(n, e).collect()) == ["e", "f"]
    ranks = {r["node_id"]: r["rank"] for r in graph.pagerank(n, e).collect()}
    assert max(ranks.values()) == pytest.approx(1.0) and ranks["e"] < ranks["a"]
    assert graph.pagerank(n.limit(0), e).count() == 0
    assert graph.repo_map(n, spark.createDataFrame([], "node_id string, rank double"), 3).count() == 3
    [route] = graph.routes(n, e).collect()
    assert (route["handler"], route["confidence"]) == ("a", 0.95)
    shown, between = graph.export_graph(n, e, spark.createDataFrame([("a", 1.0)], "node_id string, rank double"), limit=3)
    assert shown.count() == 3
    assert '"a" -> "b"' in render.to_dot(shown, between) and json.loads(render.to_json(shown, between))["nodes"][0]["id"] == "a"
    assert "</script>" in render.to_html(shown, between) and render.layout(0, []).shape == (0, 2)


def test_tables(spark):
    _, e = _graph(spark)
    q = tables.edge_quality(e).head()
    assert (q["total"], q["precise"], q["probable"], q["ambiguous"], q["precise_pct"]) == (5, 4, 1, 0, 80.0)
    assert tables.edge_quality(e.limit(0)).head()["precise_pct"] == 0.0
    twice = e.unionByName(e.withColumn("confidence", F.lit(0.1)))
    assert tables.strongest(twice).count() == e.count() and tables.strongest(twice).agg(F.min("confidence")).head()[0] == 0.5
    files = spark.createDataFrame([("a.ts",)], "path string")
    assert tables.replace_files(e, e.limit(0), files).where("file_path = 'a.ts'").count() == 0
    up = tables.upsert(e, e.where("from_id = 'a'").withColumn("confidence", F.lit(0.2)), "id")
    assert up.count() == e.count() and up.where("confidence = 0.2").count() == 2
    assert tables.delete_edges(e, ["calls"]).count() == 1


def test_imports_and_cascade(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/lib/index.ts",), ("pkg/b.py",), ("util.ts",)], "path string")
    n = nodes(spark, [(str(i), "import", s, f, 1, None, None, None) for i, (f, s) in enumerate([("src/x/m.ts", "../a"), ("src/m.ts", "./lib"), ("z.py", "pkg.b"), ("m.ts", "util"), ("m.ts", "./gone"), ("a.ts", "pkg/b")])])
    got = {(r["file_path"], r["spec"]): r["target"] for r in resolve.resolve_imports(n, files).collect()}
    assert got == {("src/x/m.ts", "../a"): "src/a.ts", ("src/m.ts", "./lib"): "src/lib/index.ts", ("z.py", "pkg.b"): "pkg/b.py", ("m.ts", "util"): "util.ts", ("a.ts", "pkg/b"): "pkg/b.py"}


def test_search_and_budget(spark):
    docs = spark.createDataFrame([(1, "red fish_one"), (2, "blue fish"), (3, "fish one red red"), (4, None), (5, "")], "id int, t string")
    assert [r["id"] for r in search.bm25(docs, "id", F.col("t"), "red", 5).collect()] == [3, 1]
    assert [r["id"] for r in search.bm25(docs, "id", F.col("t"), "fish_one", 5).collect()] == [1, 3]
    assert search.bm25(docs, "id", F.col("t"), "!", 5).count() == 0
    a = spark.createDataFrame([("x", 2.0), ("y", 1.0)], "id string, score double")
    assert {r["id"]: round(r["fused"], 6) for r in search.rrf(a, a).collect()} == {"x": round(2 / 60, 6), "y": round(2 / 61, 6)}
    n = nodes(spark, [("x", "function", "x", "f.ts", 1, "fn x()", "line one two three\n" * 40, None), ("y", "function", "y", "f.ts", 9, "fn y()", None, None)])
    hits = n.join(a, "id")
    [p] = search.pack_context(hits, "q", budget=200).collect()
    assert p["ids"] == ["x", "y"] and "trimmed" in p["formatted"] and p["tokens_used"] <= 200
    [lean] = search.pack_context(hits, "q", budget=64, cap=1000).collect()
    assert lean["ids"] and "line one" not in lean["formatted"]
    assert search.pack_context(hits.limit(0), "q").head()["n_hits"] == 0
    xml = search.pack_context(hits, 'say "q"', xml=True).head()["formatted"]
    assert xml.startswith('<context query="say &quot;q&quot;"') and "<![CDATA[" in xml


def fold_by_hand(hits, query, budget, xml):
    """(ids, tokens, text) of the packing with the default cap, hit by hit."""
    cost = lambda t: math.ceil((len(re.findall(r"\S+", t)) * 1.3 + len(t) / 4) / 2) if t else 0

    def block(h, snippet):
        where = f"{h['start_line']}-{h['end_line']}"
        if xml:
            head = f'<symbol kind="{h["kind"]}" name="{h["name"]}" file="{h["file_path"]}" lines="{where}" lang="{h["language"]}" score="{h["score"]:.3f}">\n  <signature>{h["signature"]}</signature>'
            return head + (f"\n  <code><![CDATA[{snippet}]]></code>" if snippet else "") + "\n</symbol>"
        head = f"### {h['kind']} `{h['name']}`  \n`{h['file_path']}:{where}` · lang: {h['language']} · score: {h['score']:.3f}\n\n`{h['signature']}`"
        return head + (f"\n\n```{h['language']}\n{snippet}\n```" if snippet else "")

    used, ids, blocks = cost(query) + 24, [], []
    for h in sorted(hits, key=lambda h: (-h["score"], h["id"])):
        b = block(h, h["snippet"])
        if cost(b) > budget // 3 and h["snippet"]:
            out, held = [], 0
            for line in h["snippet"].split("\n"):
                if held + cost(line) + 1 > budget // 3:
                    out.append("// … trimmed for token budget …")
                    break
                out.append(line)
                held += cost(line) + 1
            b = block(h, "\n".join(out))
        if used + cost(b) > budget:
            b = block(h, None)
            if used + cost(b) > budget:
                break
        used, ids, blocks = used + cost(b), [*ids, h["id"]], [*blocks, b]
    if xml:
        return ids, used, f'<context query="{query}" tokens="{used}">\n' + "\n".join(blocks) + "\n</context>"
    return ids, used, f"# Context for: {query}\n\n_{len(ids)} symbols · ~{used}/{budget} tokens_\n\n" + "\n\n---\n\n".join(blocks)


@pytest.mark.parametrize("xml", [False, True])
def test_packing_with_the_default_cap(spark, xml):
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(["a", "call", "return_value", "(x)", "=>"]) for _ in range(n))
    rows = [(f"n{i:02}", f"f{i}", "\n".join(say(rng.randint(0, 9)) for _ in range(rng.choice([0, 3, 12, 60, 200]))), rng.randint(1, 9) / 8) for i in range(14)]
    rows[3] = (*rows[3][:2], None, rows[3][3])
    rows[5] = (*rows[5][:2], say(900), rows[5][3])
    hits = spark.createDataFrame(rows, "id string, name string, snippet string, score double").selectExpr(
        "*", "'function' AS kind", "'a/f.ts' AS file_path", "'ts' AS language", "1 AS start_line", "9 AS end_line", "concat('fn ', name) AS signature"
    )
    by_hand = [r.asDict() for r in hits.collect()]
    trimmed = 0
    for budget in (60, 150, 400, 900, 3000):
        [p] = search.pack_context(hits, "load users", budget=budget, xml=xml).collect()
        assert (p["ids"], p["tokens_used"], p["formatted"]) == fold_by_hand(by_hand, "load users", budget, xml), budget
        [uncut] = search.pack_context(hits, "load users", budget=budget, xml=xml, cap=budget).collect()
        trimmed += p["tokens_used"] != uncut["tokens_used"]
    assert trimmed >= 2


def test_hashed_embedding_agrees(spark):
    t = spark.createDataFrame([("parse_file the Token",), ("",), (None,)], "t string")
    rows = t.select(text.local_embedding(F.col("t"), 64).alias("v"), text.hashed_features(F.coalesce("t", F.lit("")), 64).alias("f")).collect()
    want = [0.0] * 64
    for x in rows[0]["f"]:
        want[x["i"]] += x["w"]
    norm = sum(v * v for v in want) ** 0.5
    assert all(abs(a - b / norm) < 1e-6 for a, b in zip(rows[0]["v"], want))
    assert not any(rows[1]["v"]) and not any(rows[2]["v"])
