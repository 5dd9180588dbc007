"""Queries of the resolved graph on whole tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import graph, resolve, tables
from ..session import table
from .registry import Registry

registry = Registry()

#: The seeds of point queries: a name that many edges lead to, and the symbol most called.
HUB = "93d385b6050d567f40e9"

_LIVE = r"""
n AS (SELECT id, kind, name, file_path, language, start_line, end_line, signature, snippet, meta, json_extract_string(meta, '$.parent') AS parent
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrived_at DESC, indexed_at DESC) AS rn FROM nodes WHERE id IS NOT NULL)
  WHERE rn = 1 AND deleted_at IS NULL),
e AS (SELECT * FROM (SELECT id, kind, lower(regexp_replace(from_id, '^\s+|\s+$', '', 'g')) AS from_id, lower(regexp_replace(to_id, '^\s+|\s+$', '', 'g')) AS to_id,
    CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence ELSE 0 END AS confidence, file_path,
    row_number() OVER (PARTITION BY id ORDER BY arrived_at DESC, indexed_at DESC) AS rn FROM edges WHERE id IS NOT NULL)
  WHERE rn = 1 AND from_id <> '' AND to_id <> '')
"""


def live(spark: SparkSession, root: str) -> DataFrame:
    return tables.live_nodes(table(spark, root, "nodes"))


def links(spark: SparkSession, root: str) -> DataFrame:
    return tables.clean_edges(table(spark, root, "edges"))


@registry.add(
    "node_ids",
    f"""WITH {_LIVE} SELECT id, substr(sha1(file_path || kind || CASE WHEN parent IS NULL THEN name ELSE parent || '.' || name END || start_line || chr(0)), 1, 20) AS computed
    FROM n""",
)
def node_ids(spark: SparkSession, root: str) -> DataFrame:
    q = ids.qualified_name(F.col("name"), F.col("parent"))
    return live(spark, root).select("id", ids.node_id(F.col("file_path"), F.col("kind"), q, F.col("start_line")).alias("computed"))


@registry.add("edge_ids", f"WITH {_LIVE} SELECT id, substr(sha1(kind || from_id || to_id || chr(0)), 1, 20) AS computed FROM e")
def edge_ids(spark: SparkSession, root: str) -> DataFrame:
    return links(spark, root).select("id", ids.edge_id(F.col("kind"), F.col("from_id"), F.col("to_id")).alias("computed"))


@registry.add(
    "table_counts",
    f"""WITH {_LIVE} SELECT 'files' AS table_name, count(DISTINCT path) AS n_rows FROM files UNION ALL SELECT 'nodes', count(*) FROM n
    UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'embeddings', count(*) FROM node_vectors""",
)
def table_counts(spark: SparkSession, root: str) -> DataFrame:
    files = table(spark, root, "files").select("path").where("path IS NOT NULL").distinct()
    return tables.table_counts(files, live(spark, root), links(spark, root), table(spark, root, "node_vectors"))


@registry.add(
    "edge_quality",
    f"""WITH {_LIVE} SELECT count(*) AS total, count(*) FILTER (confidence >= 0.8) AS precise, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS probable,
    count(*) FILTER (confidence < 0.5) AS ambiguous, coalesce(floor(count(*) FILTER (confidence >= 0.8) * 1000.0 / nullif(count(*), 0) + 0.5) / 10, 0.0) AS precise_pct
    FROM e WHERE kind = 'calls'""",
)
def edge_quality(spark: SparkSession, root: str) -> DataFrame:
    return tables.edge_quality(links(spark, root))


@registry.add("degree", f"WITH {_LIVE} SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM e UNION ALL SELECT to_id FROM e) GROUP BY id")
def degree(spark: SparkSession, root: str) -> DataFrame:
    return tables.degrees(links(spark, root))


@registry.add("symbol_names", f"WITH {_LIVE} SELECT DISTINCT name FROM n WHERE kind IN ('function', 'method', 'class', 'interface')")
def symbol_names(spark: SparkSession, root: str) -> DataFrame:
    return tables.of_kinds(live(spark, root), tables.SYMBOLS).select("name").distinct()


@registry.add("nodes_by_name", f"WITH {_LIVE} SELECT id, kind, name, file_path FROM n WHERE name = 'get'")
def nodes_by_name(spark: SparkSession, root: str) -> DataFrame:
    return tables.with_name(live(spark, root), "get").select("id", "kind", "name", "file_path")


@registry.add("node_by_id", f"WITH {_LIVE} SELECT id, kind, name, file_path FROM n WHERE id = '{HUB}'")
def node_by_id(spark: SparkSession, root: str) -> DataFrame:
    return tables.with_id(live(spark, root), HUB).select("id", "kind", "name", "file_path")


@registry.add("incoming_edges", f"WITH {_LIVE} SELECT id, kind, from_id, to_id, confidence FROM e WHERE to_id = '{HUB}'")
def incoming_edges(spark: SparkSession, root: str) -> DataFrame:
    return tables.incoming(links(spark, root), HUB).select("id", "kind", "from_id", "to_id", "confidence")


@registry.add("outgoing_edges", f"WITH {_LIVE} SELECT id, kind, from_id, to_id, confidence FROM e WHERE from_id = '{HUB}'")
def outgoing_edges(spark: SparkSession, root: str) -> DataFrame:
    return tables.outgoing(links(spark, root), HUB).select("id", "kind", "from_id", "to_id", "confidence")


@registry.add("edges_of_kinds", f"WITH {_LIVE} SELECT id, kind, confidence FROM e WHERE kind IN ('handles', 'implements')")
def edges_of_kinds(spark: SparkSession, root: str) -> DataFrame:
    return tables.of_kinds(links(spark, root), ["handles", "implements"]).select("id", "kind", "confidence")


@registry.add(
    "missing_vectors", f"WITH {_LIVE} SELECT id, kind, name FROM n WHERE kind <> 'import' AND id NOT IN (SELECT node_id FROM node_vectors WHERE node_id IS NOT NULL)"
)
def missing_vectors(spark: SparkSession, root: str) -> DataFrame:
    return tables.missing_vectors(live(spark, root), table(spark, root, "node_vectors")).select("id", "kind", "name")


@registry.add("without_dangling", f"WITH {_LIVE} SELECT id, kind, to_id FROM e WHERE to_id IN (SELECT id FROM n)")
def without_dangling(spark: SparkSession, root: str) -> DataFrame:
    return tables.without_dangling(links(spark, root), live(spark, root)).select("id", "kind", "to_id")


def _rank_sql(rounds: int = 25) -> str:
    """25 unrolled rounds; independent of the operator's stored stages."""
    steps = ["r0 AS MATERIALIZED (SELECT id, 1.0 / cnt AS rank FROM v, c)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"""r{i} AS MATERIALIZED (SELECT v.id, (0.15 + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE id NOT IN (SELECT from_id FROM l))) / c.cnt
            + 0.85 * coalesce(g.got, 0) AS rank FROM v CROSS JOIN c LEFT JOIN (SELECT l.to_id, sum(r.rank * l.part) AS got FROM l JOIN r{i - 1} r ON r.id = l.from_id GROUP BY l.to_id) g
            ON g.to_id = v.id)"""
        )
    return f"""
    v AS MATERIALIZED (SELECT id FROM n WHERE kind IN ('function', 'method', 'class', 'interface', 'route')), c AS MATERIALIZED (SELECT count(*) AS cnt FROM v),
    w AS (SELECT from_id, to_id, sum(CASE WHEN confidence > 0 THEN confidence ELSE 0.1 END) AS w FROM e WHERE kind IN ('calls', 'handles', 'extends', 'implements', 'references')
      AND from_id IN (SELECT id FROM v) AND to_id IN (SELECT id FROM v) GROUP BY from_id, to_id),
    l AS MATERIALIZED (SELECT from_id, to_id, w / sum(w) OVER (PARTITION BY from_id) AS part FROM w),
    {", ".join(steps)}, ranked AS MATERIALIZED (SELECT id AS node_id, rank / (SELECT max(rank) FROM r{rounds}) AS rank FROM r{rounds})"""




def ranks_of(spark: SparkSession, root: str) -> DataFrame:
    return graph.pagerank(live(spark, root), links(spark, root))


@registry.add("pagerank", f"WITH {_LIVE}, {_rank_sql()} SELECT node_id, round(rank, 6) AS rank FROM ranked")
def pagerank(spark: SparkSession, root: str) -> DataFrame:
    return ranks_of(spark, root).select("node_id", F.round("rank", 6).alias("rank"))


@registry.add(
    "repomap",
    f"""WITH {_LIVE}, {_rank_sql()} SELECT n.id, n.kind, n.name, n.file_path, n.start_line, round(coalesce(r.rank, 0), 6) AS rank FROM n LEFT JOIN ranked r ON r.node_id = n.id
    WHERE n.kind IN ('function', 'method', 'class', 'interface') ORDER BY round(coalesce(r.rank, 0), 9) DESC, n.file_path, n.start_line, n.id LIMIT 25""",
)
def repomap(spark: SparkSession, root: str) -> DataFrame:
    return graph.repo_map(live(spark, root), ranks_of(spark, root)).withColumn("rank", F.round("rank", 6))


@registry.add(
    "neighborhood_nodes",
    f"""WITH RECURSIVE {_LIVE}, hop AS (SELECT id, 0 AS d FROM n WHERE id = '{HUB}' UNION SELECT m.id, h.d + 1 FROM hop h
      JOIN (SELECT from_id AS a, to_id AS b FROM e UNION SELECT to_id, from_id FROM e) x ON x.a = h.id JOIN n m ON m.id = x.b WHERE h.d < 2)
    SELECT DISTINCT id FROM hop""",
)
def neighborhood_nodes(spark: SparkSession, root: str) -> DataFrame:
    nodes = live(spark, root)
    return graph.neighborhood(nodes, links(spark, root), tables.with_id(nodes, HUB), depth=2)[0].select("id")


@registry.add(
    "neighborhood_edges",
    f"WITH {_LIVE} SELECT id, from_id, to_id FROM e WHERE (from_id = '{HUB}' OR to_id = '{HUB}') AND '{HUB}' IN (SELECT id FROM n)",
)
def neighborhood_edges(spark: SparkSession, root: str) -> DataFrame:
    nodes = live(spark, root)
    return graph.neighborhood(nodes, links(spark, root), tables.with_id(nodes, HUB), depth=1)[1].select("id", "from_id", "to_id")


@registry.add(
    "impact",
    f"""WITH RECURSIVE {_LIVE}, hop AS (SELECT id, 0 AS d FROM n WHERE name = 'get' UNION SELECT x.from_id, h.d + 1 FROM hop h JOIN e x ON x.to_id = h.id
      AND x.kind IN ('calls', 'imports', 'references') JOIN n m ON m.id = x.from_id WHERE h.d < 4)
    SELECT id, min(d) AS depth FROM hop WHERE d > 0 GROUP BY id""",
)
def impact(spark: SparkSession, root: str) -> DataFrame:
    return graph.impact(live(spark, root), links(spark, root), "get")


@registry.add("trace_flow")
def trace_flow(spark: SparkSession, root: str) -> DataFrame:
    nodes, edges = live(spark, root), links(spark, root)
    busiest = edges.where("kind = 'calls'").groupBy(F.col("from_id").alias("id")).count()
    start = nodes.where("kind IN ('function', 'method')").join(busiest, "id").orderBy(F.desc("count"), "id").select("name").head()
    rows = graph.trace_flow(nodes, edges, start["name"] if start else "")
    return spark.createDataFrame(rows, "step int, `from` string, `to` string, kind string, confidence double, depth int")


@registry.add(
    "dead_code",
    f"""WITH {_LIVE} SELECT id, kind, name, file_path, start_line FROM n WHERE kind IN ('function', 'method') AND name NOT IN ('constructor', '__init__', 'main')
    AND NOT regexp_matches(file_path, '(^|/)(index|main|app|server|cli|__main__|program)\\.[A-Za-z]+$')
    AND id NOT IN (SELECT to_id FROM e WHERE kind IN ('calls', 'handles', 'references'))""",
)
def dead_code(spark: SparkSession, root: str) -> DataFrame:
    return graph.dead_code(live(spark, root), links(spark, root))


@registry.add(
    "routes",
    f"""WITH {_LIVE}, h AS (SELECT e.from_id AS id, t.name AS handler, e.confidence, row_number() OVER (PARTITION BY e.from_id ORDER BY t.file_path, t.start_line, t.id, t.name, e.confidence) AS rn
      FROM e JOIN n t ON t.id = e.to_id WHERE e.kind = 'handles')
    SELECT n.id, n.name AS route, n.file_path, h.handler, coalesce(h.confidence, 0.0) AS confidence FROM n LEFT JOIN h ON h.id = n.id AND h.rn = 1 WHERE n.kind = 'route'""",
)
def routes(spark: SparkSession, root: str) -> DataFrame:
    return graph.routes(live(spark, root), links(spark, root))


@registry.add(
    "export_edges",
    f"""WITH {_LIVE}, latest AS (SELECT node_id, arg_max(rank, computed_at) AS rank FROM ranks WHERE rank IS NOT NULL AND NOT isnan(rank) GROUP BY node_id),
    top AS (SELECT n.id FROM n LEFT JOIN latest r ON r.node_id = n.id WHERE n.kind IN ('function', 'method', 'class', 'interface', 'route')
      ORDER BY coalesce(r.rank, 0) DESC, n.file_path, n.start_line, n.id LIMIT 300)
    SELECT from_id AS "from", to_id AS "to", kind AS label, confidence FROM e WHERE from_id IN (SELECT id FROM top) AND to_id IN (SELECT id FROM top)""",
)
def export_edges(spark: SparkSession, root: str) -> DataFrame:
    ranks = table(spark, root, "ranks").where("rank IS NOT NULL AND NOT isnan(rank)").groupBy("node_id").agg(F.max_by("rank", "computed_at").alias("rank"))
    return graph.export_graph(live(spark, root), links(spark, root), ranks)[1]


_SUFFIXES = "['" + "', '".join(resolve.SUFFIXES) + "']"
_NORMAL = """CASE WHEN {0} IS NULL THEN NULL ELSE array_to_string(list_reduce(list_prepend([''], list_transform(list_filter(string_split({0}, '/'), lambda p: p <> '' AND p <> '.'), lambda p: [p])),
  lambda acc, p: CASE WHEN p[1] = '..' AND len(acc) > 1 AND acc[len(acc)] <> '..' THEN acc[1:len(acc) - 1] ELSE list_concat(acc, p) END)[2:], '/') END"""
_DIR = "CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '' END"
_IMPORTS_SQL = f"""
spec AS (SELECT DISTINCT file_path, name AS spec, {_DIR} AS dir FROM n WHERE kind = 'import'),
base AS (SELECT file_path, spec, {_NORMAL.format("(dir || '/' || spec)")} AS rel, {_NORMAL.format("spec")} AS plain, replace(spec, '.', '/') AS dotted,
  {_NORMAL.format("(dir || '/' || replace(spec, '.', '/'))")} AS reldot FROM spec),
tried AS (SELECT file_path, spec, unnest(c) AS path, unnest(range(0, len(c))) AS nth FROM (SELECT file_path, spec, CASE
  WHEN spec[1] = '.' THEN list_concat(list_transform({_SUFFIXES}, lambda s: rel || s), list_transform({_SUFFIXES}[2:], lambda s: rel || '/index' || s))
  WHEN contains(spec, '/') THEN list_transform({_SUFFIXES}, lambda s: plain || s)
  WHEN contains(spec, '.') THEN list_concat(list_transform({_SUFFIXES}, lambda s: dotted || s), list_transform({_SUFFIXES}, lambda s: reldot || s))
  ELSE list_concat(list_transform({_SUFFIXES}[2:], lambda s: rel || s), list_transform({_SUFFIXES}[2:], lambda s: spec || s)) END AS c FROM base)),
imp AS (SELECT file_path, spec, arg_min(path, nth) AS target FROM tried WHERE path IN (SELECT path FROM files) GROUP BY file_path, spec)
"""


@registry.add("imports_resolve", f"WITH {_LIVE}, {_IMPORTS_SQL} SELECT file_path, spec, target FROM imp")
def imports_resolve(spark: SparkSession, root: str) -> DataFrame:
    return resolve.resolve_imports(live(spark, root), table(spark, root, "files"))


_CALLS_SQL = rf"""
f AS (SELECT id, name, file_path, start_line, parent, row_number() OVER (ORDER BY file_path, start_line, id) AS ord FROM n WHERE kind IN ('function', 'method')),
c AS (SELECT row_number() OVER () AS site, s.caller_id AS caller, s.callee_name AS callee, s.receiver, k.file_path, k.parent AS cls, coalesce(k.signature, '') || chr(10) || coalesce(k.snippet, '') AS body,
    regexp_replace(s.receiver, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g') AS esc
  FROM (SELECT DISTINCT caller_id, callee_name, receiver FROM call_sites WHERE caller_id IS NOT NULL AND callee_name IS NOT NULL) s JOIN n k ON k.id = s.caller_id),
g AS (SELECT *, CASE WHEN regexp_matches(t1, '^[A-Z]') THEN t1 WHEN regexp_matches(t2, '^[A-Z]') THEN t2 WHEN regexp_matches(t3, '^[A-Z]') THEN t3 END AS inferred FROM (SELECT *,
    regexp_extract(body, '\b' || esc || '\s*(?::\s*[A-Za-z_$][\w$]*)?\s*=\s*new\s+([A-Za-z_$][\w$]*)', 1) AS t1,
    regexp_extract(body, '\b([A-Za-z_$][\w$]*)\s+' || esc || '\s*=', 1) AS t2, regexp_extract(body, '\b' || esc || '\s*:\s*([A-Za-z_$][\w$]*)', 1) AS t3 FROM c)),
reach AS (SELECT DISTINCT file_path, target FROM imp),
cand AS (SELECT g.*, f.id AS target, f.ord, f.parent AS tparent, f.file_path AS tfile, f.file_path = g.file_path AS same, r.target IS NOT NULL AS imported,
    row_number() OVER (PARTITION BY site, f.file_path = g.file_path ORDER BY f.ord) AS r_same, row_number() OVER (PARTITION BY site, r.target IS NOT NULL ORDER BY f.ord) AS r_imp
  FROM g JOIN f ON f.name = g.callee LEFT JOIN reach r ON r.file_path = g.file_path AND r.target = f.file_path),
q AS (SELECT parent, name, arg_max(id, ord) AS id FROM f WHERE parent IS NOT NULL GROUP BY parent, name),
agg AS (SELECT site, any_value(caller) AS caller, any_value(callee) AS callee, any_value(receiver) AS receiver, any_value(cls) AS cls, any_value(inferred) AS inferred, any_value(file_path) AS file_path,
    count(*) AS n_all, count(*) FILTER (same) AS n_file, count(*) FILTER (imported) AS n_imp, list(target ORDER BY ord) AS l_all, list(target ORDER BY ord) FILTER (same) AS l_file,
    list(target ORDER BY tfile, ord) FILTER (imported) AS l_imp, list(target) FILTER (same AND tparent IS NOT DISTINCT FROM cls) AS l_cls FROM cand GROUP BY site),
pick AS (SELECT a.caller, a.file_path, CASE
    WHEN a.receiver IN ('this', 'self') AND q1.id IS NOT NULL THEN row('1', [q1.id], 1.0)
    WHEN a.receiver IN (SELECT name FROM n WHERE kind IN ('class', 'interface')) AND q2.id IS NOT NULL THEN row('2', [q2.id], 0.95)
    WHEN q3.id IS NOT NULL THEN row('3', [q3.id], 0.95)
    WHEN n_file = 1 THEN row('4a', l_file, 0.95) WHEN n_file > 1 AND len(l_cls) = 1 THEN row('4b', l_cls, 0.95) WHEN n_file > 1 THEN row('4c', l_file[1:3], 0.5)
    WHEN n_imp = 1 THEN row('5a', l_imp, 0.9) WHEN n_imp > 1 THEN row('5b', l_imp[1:3], 0.6)
    WHEN n_all = 1 THEN row('6a', l_all, 0.8) WHEN n_all <= 3 THEN row('6b', l_all, 0.4) END AS p
  FROM agg a LEFT JOIN q q1 ON q1.parent = a.cls AND q1.name = a.callee LEFT JOIN q q2 ON q2.parent = a.receiver AND q2.name = a.callee LEFT JOIN q q3 ON q3.parent = a.inferred AND q3.name = a.callee),
flat AS (SELECT caller AS from_id, unnest(struct_extract(p, 2)) AS to_id, struct_extract(p, 3) AS confidence FROM pick WHERE p IS NOT NULL)
"""


@registry.add(
    "resolve_calls",
    f"""WITH {_LIVE}, {_IMPORTS_SQL}, {_CALLS_SQL} SELECT substr(sha1('calls' || from_id || to_id || chr(0)), 1, 20) AS id, from_id, to_id, CAST(max(confidence) AS DOUBLE) AS confidence
    FROM flat WHERE from_id <> to_id GROUP BY from_id, to_id""",
)
def resolve_calls(spark: SparkSession, root: str) -> DataFrame:
    return resolve.resolve_calls(table(spark, root, "call_sites"), live(spark, root), table(spark, root, "files")).select("id", "from_id", "to_id", "confidence")


@registry.add(
    "resolve_handlers",
    f"""WITH {_LIVE}, f AS (SELECT id, name, file_path, start_line, row_number() OVER (ORDER BY file_path, start_line, id) AS ord FROM n WHERE kind IN ('function', 'method')),
    r AS (SELECT id, file_path, json_extract_string(meta, '$.handlerName') AS h FROM n WHERE kind = 'route'),
    m AS (SELECT r.id AS from_id, count(*) AS n_all, count(*) FILTER (f.file_path = r.file_path) AS n_here, arg_min(f.id, ord) AS first, arg_min(f.id, ord) FILTER (f.file_path = r.file_path) AS here
      FROM r JOIN f ON f.name = r.h GROUP BY r.id)
    SELECT from_id, coalesce(here, first) AS to_id, CAST(CASE WHEN n_here = 1 THEN 0.95 WHEN n_all = 1 THEN 0.85 ELSE 0.5 END AS DOUBLE) AS confidence FROM m""",
)
def resolve_handlers(spark: SparkSession, root: str) -> DataFrame:
    return resolve.resolve_handlers(live(spark, root)).select("from_id", "to_id", "confidence")


@registry.add(
    "link_assets",
    f"""WITH {_LIVE}, w AS (SELECT DISTINCT id, unnest(regexp_split_to_array(lower(snippet), '[^a-z0-9_]+')) AS word FROM n WHERE kind = 'asset'),
    s AS (SELECT lower(name) AS word, arg_max(name, row(file_path, start_line, id)) AS name FROM n WHERE kind IN ('function', 'method', 'class', 'interface') AND length(name) > 3 GROUP BY lower(name))
    SELECT DISTINCT substr(sha1('documents' || w.id || t.id), 1, 20) AS id, w.id AS from_id, t.id AS to_id FROM w JOIN s USING (word) JOIN n t ON t.name = s.name WHERE length(w.word) > 3 AND w.id <> t.id""",
)
def link_assets(spark: SparkSession, root: str) -> DataFrame:
    nodes = live(spark, root)
    assets = nodes.where("kind = 'asset'").select("id", "file_path", F.col("snippet").alias("text"))
    return resolve.link_assets(assets, nodes).select("id", "from_id", "to_id")
