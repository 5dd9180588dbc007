"""Retrieval, text and budget queries on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import search
from ..session import table
from .graph_queries import _LIVE, links, live
from .registry import Registry

registry = Registry()

QUERY = "watcher rename cache parent"
_EST = "CASE WHEN {0} IS NULL OR {0} = '' THEN 0 ELSE CAST(ceil((1.3 * len(regexp_extract_all({0}, '\\S+')) + length({0}) / 4.0) / 2) AS INT) END"


@registry.add("token_estimate", "SELECT doc_id, " + _EST.format("text") + " AS tokens FROM documents")
def token_estimate(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


def _bm25_sql(source: str, query: str, limit: int) -> str:
    terms = [p[0] for p in text.query_terms(query)]
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""d AS (SELECT id, regexp_extract_all(lower(coalesce(t, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM ({source})),
    whole AS (SELECT count(*) AS cnt, avg(len(w)) AS av FROM d),
    tf AS (SELECT id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM d, (VALUES {values}) q(term)),
    df AS (SELECT term, greatest(ln((any_value(cnt) - count(*) FILTER (tf > 0) + 0.5) / (count(*) FILTER (tf > 0) + 0.5)), 1e-6) AS idf FROM tf, whole GROUP BY term),
    bm AS (SELECT id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM tf JOIN df USING (term), whole GROUP BY id HAVING sum(tf) > 0),
    lex AS (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT {limit})"""


@registry.add(
    "bm25_topk", f"WITH {_bm25_sql('SELECT doc_id AS id, text AS t FROM documents', QUERY, 40)} SELECT id, score, 1.0::DOUBLE AS ref_score FROM lex"
)
def bm25_topk(spark: SparkSession, root: str) -> DataFrame:
    return search.bm25(table(spark, root, "documents"), "doc_id", F.col("text"), QUERY, 40)


_FORMS = {"renam": ["rename", "renames", "renamed", "renaming"], "caller": ["caller", "callers"]}


def _stemmed_sql(source: str, limit: int) -> str:
    """BM25 of stems whose word forms are few enough to be listed."""
    values = ", ".join(f"('{stem}', {forms})" for stem, forms in _FORMS.items())
    return f"""d AS (SELECT id, regexp_extract_all(lower(coalesce(t, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM ({source})),
    whole AS (SELECT count(*) AS cnt, avg(len(w)) AS av FROM d),
    tf AS (SELECT id, len(w) AS dl, term, len(list_filter(w, lambda x: list_contains(forms, x))) AS tf FROM d, (VALUES {values}) q(term, forms)),
    df AS (SELECT term, greatest(ln((any_value(cnt) - count(*) FILTER (tf > 0) + 0.5) / (count(*) FILTER (tf > 0) + 0.5)), 1e-6) AS idf FROM tf, whole GROUP BY term),
    bm AS (SELECT id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM tf JOIN df USING (term), whole GROUP BY id HAVING sum(tf) > 0)
    SELECT id, score, 1.0::DOUBLE AS ref_score FROM bm ORDER BY score DESC, id LIMIT {limit}"""


@registry.add("bm25_stemmed", f"WITH {_stemmed_sql('SELECT doc_id AS id, text AS t FROM documents', 40)}")
def bm25_stemmed(spark: SparkSession, root: str) -> DataFrame:
    return search.bm25(table(spark, root, "documents"), "doc_id", F.col("text"), "renaming callers", 40, stemmed=True)


@registry.add(
    "vector_topk",
    """WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1)
    SELECT vec_id AS id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS score FROM embeddings, q ORDER BY score DESC, id LIMIT 40""",
)
def vector_topk(spark: SparkSession, root: str) -> DataFrame:
    vectors = table(spark, root, "embeddings")
    return search.vector_topk(vectors, "vec_id", "embedding", vectors.orderBy("vec_id").head()["embedding"], 40)


_NODE_TEXT = "SELECT id, concat_ws(' ', name, signature, snippet) AS t FROM n"
_NODE_QUERY = "return load ticket"
_LATEST = "latest AS (SELECT node_id, arg_max(rank, computed_at) AS rank FROM ranks WHERE rank IS NOT NULL AND NOT isnan(rank) GROUP BY node_id)"


def _node_lists(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = live(spark, root)
    lexical = search.bm25(nodes, "id", F.concat_ws(" ", "name", "signature", "snippet"), _NODE_QUERY, 40)
    ok = table(spark, root, "node_vectors").where("dim = 64 AND size(vec) = 64 AND NOT exists(vec, x -> isnan(x)) AND abs(vec[0]) < 1e30")
    probe = ok.orderBy("node_id").head()["vec"]
    return nodes, lexical, search.vector_topk(ok, "node_id", "vec", probe, 40)


_HYBRID_SQL = f"""{_bm25_sql(_NODE_TEXT, _NODE_QUERY, 40)},
    vs AS (SELECT node_id AS id, CAST(vec AS DOUBLE[]) AS v FROM node_vectors WHERE dim = 64 AND len(vec) = 64 AND len(list_filter(vec, lambda x: isnan(x))) = 0 AND abs(vec[1]) < 1e30),
    p AS (SELECT v AS pv FROM vs ORDER BY id LIMIT 1),
    vec AS (SELECT id, round(list_inner_product(v, pv), 6) AS score FROM vs, p ORDER BY score DESC, id LIMIT 40),
    ra AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM lex), rb AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM vec),
    fused AS (SELECT coalesce(ra.id, rb.id) AS id, ra.score AS bm25, rb.score AS vector, coalesce(1.0 / (60 + ra.r), 0) + coalesce(1.0 / (60 + rb.r), 0) AS fused FROM ra FULL JOIN rb ON ra.id = rb.id),
    pool AS (SELECT * FROM fused ORDER BY round(fused, 9) DESC, id LIMIT 24),
    deg AS (SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM e UNION ALL SELECT to_id FROM e) GROUP BY id), {_LATEST},
    hyb AS (SELECT p.id, p.bm25, p.vector, 0.02 * log2(2 + coalesce(d.degree, 0)) + 0.05 * coalesce(l.rank, 0) AS boost, p.fused FROM pool p JOIN n ON n.id = p.id AND n.kind <> 'import'
      LEFT JOIN deg d ON d.id = p.id LEFT JOIN latest l ON l.node_id = p.id),
    hits AS (SELECT id, round(fused + boost, 6) AS score, bm25, vector, round(boost, 6) AS graph FROM hyb ORDER BY score DESC, id LIMIT 12)"""


@registry.add("hybrid_topk", f"WITH {_LIVE}, {_HYBRID_SQL} SELECT * FROM hits")
def hybrid_topk(spark: SparkSession, root: str) -> DataFrame:
    nodes, lexical, vector = _node_lists(spark, root)
    ranks = table(spark, root, "ranks").where("rank IS NOT NULL AND NOT isnan(rank)").groupBy("node_id").agg(F.max_by("rank", "computed_at").alias("rank"))
    return search.hybrid(lexical, vector, nodes, links(spark, root), ranks, limit=12)


@registry.add(
    "rrf",
    f"WITH {_LIVE}, {_HYBRID_SQL} SELECT id, bm25, vector, round(fused, 9) AS fused FROM fused",
)
def rrf(spark: SparkSession, root: str) -> DataFrame:
    _, lexical, vector = _node_lists(spark, root)
    return search.rrf(lexical, vector).withColumn("fused", F.round("fused", 9))


def _hits(spark: SparkSession, root: str) -> DataFrame:
    nodes = live(spark, root)
    return nodes.join(search.bm25(nodes, "id", F.concat_ws(" ", "name", "signature", "snippet"), _NODE_QUERY, 16), "id")


_MARK = "// … trimmed for token budget …"


def _trimmed_sql(source: str, most: int) -> str:
    """trim(id, trimmed): the snippets of ``source`` (id, snippet) cut to ``most``."""
    return f"""tl AS (SELECT id, line, nr, sum({_EST.format("line")} + 1) OVER (PARTITION BY id ORDER BY nr) AS upto FROM (
      SELECT id, unnest(string_split(snippet, chr(10))) AS line, unnest(range(1, len(string_split(snippet, chr(10))) + 1)) AS nr FROM ({source}))),
    tcut AS (SELECT id, min(nr) AS cut FROM tl WHERE upto > {most} GROUP BY id),
    trim AS (SELECT id, coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (cut IS NULL OR nr < cut), '') || CASE WHEN any_value(cut) IS NULL THEN '' WHEN any_value(cut) = 1 THEN '{_MARK}' ELSE chr(10) || '{_MARK}' END AS trimmed
      FROM tl LEFT JOIN tcut USING (id) GROUP BY id)"""


def _esc(c: str, attribute: bool = False) -> str:
    out = f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"replace({out}, chr(34), '&quot;')" if attribute else out


def _pack_sql(budget: int, xml: bool) -> str:
    """The whole packing with the default cap, block by block."""
    most, nl = budget // 3, "chr(10)"
    if xml:
        head = f"""('<symbol kind="' || kind || '" name="' || {_esc('name', True)} || '" file="' || {_esc('file_path', True)} || '" lines="' || start_line || '-' || end_line || '" lang="' || coalesce(language, '') || '" score="' || printf('%.3f', score) || '">'
          || CASE WHEN signature <> '' THEN {nl} || '  <signature>' || {_esc('signature')} || '</signature>' ELSE '' END)"""
        block = lambda c: f"({head} || CASE WHEN {c} <> '' THEN {nl} || '  <code><![CDATA[' || {c} || ']]></code>' ELSE '' END || {nl} || '</symbol>')"
        shown = f"""'<context query="{_NODE_QUERY}" tokens="' || used || '">' || {nl} || body || {nl} || '</context>'"""
        between = nl
    else:
        head = f"""('### ' || kind || ' `' || name || '`  ' || {nl} || '`' || file_path || ':' || start_line || '-' || end_line || '` · lang: ' || coalesce(language, '') || ' · score: ' || printf('%.3f', score)
          || CASE WHEN signature <> '' THEN {nl} || {nl} || '`' || signature || '`' ELSE '' END)"""
        block = lambda c: f"({head} || CASE WHEN {c} <> '' THEN {nl} || {nl} || '```' || coalesce(language, '') || {nl} || {c} || {nl} || '```' ELSE '' END)"
        shown = f"""'# Context for: {_NODE_QUERY}' || {nl} || {nl} || '_' || taken || ' symbols · ~' || used || '/{budget} tokens_' || {nl} || {nl} || body"""
        between = f"{nl} || {nl} || '---' || {nl} || {nl}"
    lean = block("CAST(NULL AS VARCHAR)")
    return f"""WITH RECURSIVE {_LIVE}, {_bm25_sql(_NODE_TEXT, _NODE_QUERY, 16)}, top AS (SELECT n.*, lex.score FROM n JOIN lex USING (id)), {_trimmed_sql("SELECT id, snippet FROM top WHERE snippet <> ''", most)},
    b AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS i, {block('snippet')} AS full_block, {block('trimmed')} AS cut_block, {lean} AS lean_block, snippet FROM top LEFT JOIN trim USING (id)),
    h AS (SELECT i, blk, lean_block, {_EST.format('blk')} AS cost, {_EST.format('lean_block')} AS lean FROM (SELECT i, lean_block, CASE WHEN {_EST.format('full_block')} > {most} AND snippet <> '' THEN cut_block ELSE full_block END AS blk FROM b)),
    fold AS (SELECT 0 AS i, {_EST.format("'" + _NODE_QUERY + "'")} + 24 AS used, false AS done, 0 AS taken, '' AS body
      UNION ALL SELECT h.i, CASE WHEN f.done THEN f.used WHEN f.used + cost <= {budget} THEN f.used + cost WHEN f.used + lean <= {budget} THEN f.used + lean ELSE f.used END,
        f.done OR (f.used + cost > {budget} AND f.used + lean > {budget}), f.taken + CASE WHEN f.done OR (f.used + cost > {budget} AND f.used + lean > {budget}) THEN 0 ELSE 1 END,
        f.body || CASE WHEN f.done OR (f.used + cost > {budget} AND f.used + lean > {budget}) THEN '' ELSE CASE WHEN f.taken > 0 THEN {between} ELSE '' END || CASE WHEN f.used + cost <= {budget} THEN blk ELSE lean_block END END
      FROM fold f JOIN h ON h.i = f.i + 1)
    SELECT used AS tokens_used, taken AS n_hits, {shown} AS formatted FROM fold ORDER BY i DESC LIMIT 1"""


@registry.add("context_pack", _pack_sql(900, False))
def context_pack(spark: SparkSession, root: str) -> DataFrame:
    return search.pack_context(_hits(spark, root), _NODE_QUERY, budget=900).select("tokens_used", "n_hits", "formatted")


@registry.add("context_bundle", _pack_sql(900, True))
def context_bundle(spark: SparkSession, root: str) -> DataFrame:
    return search.pack_context(_hits(spark, root), _NODE_QUERY, budget=900, xml=True).select("tokens_used", "n_hits", "formatted")


@registry.add("snippet_trim", f"WITH {_LIVE}, {_trimmed_sql('SELECT id, snippet FROM n WHERE snippet IS NOT NULL', 60)} SELECT id, trimmed FROM trim")
def snippet_trim(spark: SparkSession, root: str) -> DataFrame:
    return live(spark, root).where("snippet IS NOT NULL").select("id", search.trim_snippet(F.col("snippet"), 60).alias("trimmed"))


_FNV = """list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, length(f) + 1), lambda i: ascii(f[i])::HUGEINT)),
  lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296)"""


@registry.add(
    "fnv_features",
    f"""WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '[_\\-.]', ' ', 'g'), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1) AS w FROM eval_items),
    g AS (SELECT item_id, unnest(w) AS tok FROM t), x AS (SELECT item_id, tok AS f, 1.0 AS w FROM g UNION ALL SELECT item_id, unnest(list_transform(range(1, length(tok) - 1), lambda i: tok[i:i+2])), 0.5 FROM g WHERE length(tok) > 2),
    h AS (SELECT item_id, w, {_FNV}::BIGINT AS h FROM x)
    SELECT item_id, CAST((CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END) % 256 AS INT) AS i, CAST(sum(CASE WHEN h % 2 = 0 THEN w ELSE -w END) AS DOUBLE) AS w FROM h GROUP BY 1, 2""",
)
def fnv_features(spark: SparkSession, root: str) -> DataFrame:
    items = table(spark, root, "eval_items")
    return items.select("item_id", F.inline(text.hashed_features(F.col("text"), 256))).groupBy("item_id", "i").agg(F.sum("w").alias("w"))


@registry.add("local_embedding")
def local_embedding(spark: SparkSession, root: str) -> DataFrame:
    nodes = live(spark, root).where("kind <> 'import'")
    return nodes.select("id", text.local_embedding(text.embedding_text(F.col("name"), F.col("signature"), F.col("snippet"))).alias("vec"))
