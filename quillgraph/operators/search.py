"""Retrieval: BM25 over an inverted index, vectors, reciprocal-rank fusion with graph boosts, and packing into a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, query_terms, search_terms, stem, stem_all, token_estimate
from .tables import degrees

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str, text: Column, stemmed: bool = False) -> DataFrame:
    """(id, term, positions, tf, dl): the inverted index; repeated ids are indexed once."""
    once = docs.select(F.col(id_col).alias("id"), text.alias("text")).dropDuplicates(["id"])
    terms = once.select("id", search_terms(F.col("text")).alias("terms"))
    flat = terms.select("id", F.size("terms").alias("dl"), F.posexplode("terms").alias("pos", "term"))
    if stemmed:
        stems = flat.select("term").distinct().withColumn("stem", stem(F.col("term")))
        flat = flat.join(stems, "term").drop("term").withColumnRenamed("stem", "term")
    return flat.groupBy("id", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"), F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def bm25(docs: DataFrame, id_col: str, text: Column, query: str, limit: int, stemmed: bool = False) -> DataFrame:
    """(id, score, ref_score): the ``limit`` best documents for any phrase of ``query``, ties by id.

    A word of several terms (``a_b``) is a phrase of them in sequence. ``ref_score`` is the constant that a score of
    1 / (1 + max(0, -score)) comes to. An empty query or no match gives nothing. Texts are counted where they lie and never
    shuffled: repeated ids are dropped afterwards, by (id, length, counts). The second pass, for the scores, tokenises only texts
    that contain a queried term at all.
    """
    phrases = query_terms(query)
    base = docs.select(F.col(id_col).alias("id"), text.alias("_t")).select("id", "_t", search_terms(F.col("_t")).alias("terms"))
    if not phrases:
        return base.select("id", F.lit(0.0).alias("score"), F.lit(1.0).alias("ref_score")).limit(0)
    if stemmed:
        from ..functions.text import porter_stem

        phrases = [[porter_stem(t) for t in p] for p in phrases]
        base = base.withColumn("terms", stem_all(F.col("terms")))

    def count(p: list[str]) -> Column:
        if len(p) == 1:
            return F.size(F.filter("terms", lambda t: t == p[0]))
        words = F.array(*map(F.lit, p))
        starts = F.sequence(F.lit(1), F.size("terms") - (len(p) - 1))
        return F.when(F.size("terms") >= len(p), F.size(F.filter(starts, lambda i: F.slice("terms", i, len(p)) == words))).otherwise(0)

    counts = [F.size("terms").alias("dl"), *[count(p).alias(f"tf{i}") for i, p in enumerate(phrases)]]
    low = F.lower(F.coalesce("_t", F.lit("")))
    # a stem differs from its words in the last letters only
    held = reduce(lambda a, b: a | b, [low.contains(w if not stemmed else w[: max(1, len(w) - 2)]) for p in phrases for w in p[:1]])
    counted = base.select("id", *counts).dropDuplicates(["id"])
    likely = base.where(held).select("id", *counts).dropDuplicates(["id"])
    whole = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))]).collect()[0]
    score: Column = F.lit(0.0)
    for i in range(len(phrases)):
        n, df = whole["n"], whole[f"df{i}"]
        idf = F.greatest(F.log(F.lit((n - df + 0.5) / (df + 0.5))), F.lit(1e-6))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(whole["avg"] or 1.0)))
    some = reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(phrases))])
    return likely.where(some).select("id", F.round(score, 6).alias("score"), F.lit(1.0).alias("ref_score")).orderBy(F.desc("score"), "id").limit(limit)


def vector_topk(vectors: DataFrame, id_col: str, vec_col: str, query: list[float], limit: int) -> DataFrame:
    """(id, score): the ``limit`` rows whose vectors have the highest dot product with ``query``, ties by id; one scan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col).alias("id"), F.round(cosine(F.col(vec_col), q), 6).alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(limit)


def ranked(hits: DataFrame, alias: str) -> DataFrame:
    """Hits of a bounded list with their position from 0."""
    return hits.withColumn(alias, F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)


def rrf(left: DataFrame, right: DataFrame, k: int = 60) -> DataFrame:
    """(id, bm25, vector, fused): reciprocal-rank fusion of two ranked lists (id, score)."""
    a = ranked(left, "ra").select("id", F.col("score").alias("bm25"), "ra")
    b = ranked(right, "rb").select("id", F.col("score").alias("vector"), "rb")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return a.join(b, "id", "full_outer").select("id", "bm25", "vector", (part("ra") + part("rb")).alias("fused"))


def hybrid(lexical: DataFrame, vector: DataFrame, nodes: DataFrame, edges: DataFrame, ranks: DataFrame, limit: int = 12) -> DataFrame:
    """(id, score, bm25, vector, graph): both lists fused, the top ``2 * limit`` hydrated (imports and unknown ids dropped), raised by
    0.02 * log2(2 + degree) + 0.05 * rank and cut to ``limit``, ties by id."""
    pool = rrf(lexical, vector).orderBy(F.round("fused", 9).desc(), "id").limit(2 * limit)
    kept = pool.join(nodes.where("kind <> 'import'").select("id"), "id", "left_semi")
    few = F.broadcast(kept.select("id"))  # at most 2 * limit rows
    deg = degrees(edges.join(few.withColumnRenamed("id", "from_id"), "from_id", "left_semi").unionByName(edges.join(few.withColumnRenamed("id", "to_id"), "to_id", "left_semi")).dropDuplicates(["id"]))
    rank = ranks.select(F.col("node_id").alias("id"), "rank")
    boost = F.lit(0.02) * F.log2(F.lit(2.0) + F.coalesce("degree", F.lit(0))) + F.lit(0.05) * F.coalesce("rank", F.lit(0.0))
    scored = kept.join(deg, "id", "left").join(rank, "id", "left").withColumn("graph", F.round(boost, 6))
    return scored.select("id", F.round(F.col("fused") + boost, 6).alias("score"), "bm25", "vector", "graph").orderBy(F.desc("score"), "id").limit(limit)


def trim_snippet(snippet: Column, most: Column | int) -> Column:
    """The leading lines whose estimates, one added for each, stay within ``most``; a marker line where some were cut."""
    most = F.lit(most) if isinstance(most, int) else most
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def step(acc: Column, line: Column) -> Column:
        cost = token_estimate(line) + 1
        over = acc["used"] + cost > most
        more = F.struct(F.concat(acc["out"], F.array(line)).alias("out"), (acc["used"] + cost).alias("used"), F.lit(False).alias("done"))
        cut = F.struct(F.concat(acc["out"], F.array(F.lit("// … trimmed for token budget …"))).alias("out"), acc["used"].alias("used"), F.lit(True).alias("done"))
        return F.when(acc["done"], acc).when(over, cut).otherwise(more)

    return F.array_join(F.aggregate(F.split(snippet, "\n"), start, step)["out"], "\n")


def escape_xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attr(c: Column) -> Column:
    return F.replace(escape_xml(c), F.lit('"'), F.lit("&quot;"))


def hit_block(h: Column, snippet: Column, xml: bool = False) -> Column:
    """A search hit (struct of a node's columns and score) as a Markdown or XML block."""
    score = F.format_string("%.3f", h["score"].cast("double"))
    lines = F.concat(h["start_line"].cast("string"), F.lit("-"), h["end_line"].cast("string"))
    sig = h["signature"]
    some = lambda c: c.isNotNull() & (c != "")
    if xml:
        head = F.concat(
            F.lit('<symbol kind="'), h["kind"], F.lit('" name="'), escape_attr(h["name"]), F.lit('" file="'), escape_attr(h["file_path"]), F.lit('" lines="'), lines,
            F.lit('" lang="'), F.coalesce(h["language"], F.lit("")), F.lit('" score="'), score, F.lit('">'),
        )
        s = F.when(some(sig), F.concat(F.lit("\n  <signature>"), escape_xml(sig), F.lit("</signature>"))).otherwise("")
        code = F.when(some(snippet), F.concat(F.lit("\n  <code><![CDATA["), snippet, F.lit("]]></code>"))).otherwise("")
        return F.concat(head, s, code, F.lit("\n</symbol>"))
    lang = F.coalesce(h["language"], F.lit(""))
    head = F.concat(F.lit("### "), h["kind"], F.lit(" `"), h["name"], F.lit("`  \n`"), h["file_path"], F.lit(":"), lines, F.lit("` · lang: "), lang, F.lit(" · score: "), score)
    s = F.when(some(sig), F.concat(F.lit("\n\n`"), sig, F.lit("`"))).otherwise("")
    code = F.when(some(snippet), F.concat(F.lit("\n\n```"), lang, F.lit("\n"), snippet, F.lit("\n```"))).otherwise("")
    return F.concat(head, s, code)


def pack_context(hits: DataFrame, query: str, budget: int = 8000, xml: bool = False, cap: int | None = None) -> DataFrame:
    """One row (query, tokens_used, token_budget, n_hits, ids, formatted): hits by falling score put into the budget.

    A block costlier than ``cap`` (a third of the budget) has its snippet trimmed; one that doesn't fit is taken without snippet if
    that fits, else packing ends. The fold runs inside the JVM over the bounded, sorted list of hits.
    """
    most = cap if cap is not None else budget // 3
    node = F.struct(*[F.col(c) for c in "id kind name file_path language start_line end_line signature snippet score".split()])
    items = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("id").alias("i"), node.alias("h")))), lambda s: s["h"])
    header = token_estimate(F.lit(query)) + 24
    empty = F.array().cast("array<string>")
    start = F.struct(header.alias("used"), F.lit(False).alias("done"), empty.alias("ids"), empty.alias("blocks"))

    def step(acc: Column, h: Column) -> Column:
        full = hit_block(h, h["snippet"], xml)
        long = (token_estimate(full) > most) & h["snippet"].isNotNull() & (h["snippet"] != "")
        block = F.when(long, hit_block(h, trim_snippet(h["snippet"], most), xml)).otherwise(full)
        lean = hit_block(h, F.lit(None).cast("string"), xml)
        left = F.lit(budget) - acc["used"]

        def take(b: Column) -> Column:
            return F.struct(
                (acc["used"] + token_estimate(b)).alias("used"), F.lit(False).alias("done"), F.concat(acc["ids"], F.array(h["id"])).alias("ids"),
                F.concat(acc["blocks"], F.array(b)).alias("blocks"),
            )

        stop = F.struct(acc["used"].alias("used"), F.lit(True).alias("done"), acc["ids"].alias("ids"), acc["blocks"].alias("blocks"))
        return F.when(acc["done"], acc).when(token_estimate(block) <= left, take(block)).when(token_estimate(lean) <= left, take(lean)).otherwise(stop)

    packed = hits.agg(items.alias("hits")).select(F.aggregate("hits", start, step).alias("p"))
    used, n = F.col("p.used"), F.size("p.ids")
    if xml:
        shown = F.concat(F.lit('<context query="' + query.replace('"', "&quot;") + '" tokens="'), used.cast("string"), F.lit('">\n'), F.array_join("p.blocks", "\n"), F.lit("\n</context>"))
    else:
        shown = F.concat(
            F.lit(f"# Context for: {query}\n\n_"), n.cast("string"), F.lit(" symbols · ~"), used.cast("string"), F.lit(f"/{budget} tokens_\n\n"), F.array_join("p.blocks", "\n\n---\n\n")
        )
    return packed.select(F.lit(query).alias("query"), used.alias("tokens_used"), F.lit(budget).alias("token_budget"), n.alias("n_hits"), F.col("p.ids").alias("ids"), shown.alias("formatted"))
