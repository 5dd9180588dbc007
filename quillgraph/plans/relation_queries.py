"""Queries of stored relations, updates, extraction and resolution that whole tables can be compared on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import changes, extract, graph, render, resolve, tables
from ..session import materialise, table
from ..sources import scan
from ..sources.state import Store
from ..streaming import changelog
from .graph_queries import _CALLS_SQL, _IMPORTS_SQL, _LIVE, links, live
from .registry import Registry
from .source_queries import _CASES, _EXT, _scans

registry = Registry()

# lookups and updates -----------------------------------------------------------------------------------------------------

_BUSY = "(SELECT from_id FROM e GROUP BY from_id ORDER BY count(*) DESC, from_id LIMIT 1)"


@registry.add("busiest_outgoing", f"WITH {_LIVE} SELECT id, kind, from_id, to_id, confidence FROM e WHERE from_id = {_BUSY}")
def busiest_outgoing(spark: SparkSession, root: str) -> DataFrame:
    edges = links(spark, root)
    busy = edges.groupBy("from_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "from_id").select("from_id").head()
    return tables.outgoing(edges, busy["from_id"] if busy else "").select("id", "kind", "from_id", "to_id", "confidence")


@registry.add("symbol_by_name", f"WITH {_LIVE} SELECT id FROM n WHERE name = 'get' OR id = 'get' ORDER BY id <> 'get', file_path, start_line, id LIMIT 1")
def symbol_by_name(spark: SparkSession, root: str) -> DataFrame:
    hit = graph.resolve_symbol(live(spark, root), "get")
    return spark.createDataFrame([(hit,)] if hit else [], "id string")


@registry.add("stored_files", "SELECT path, arg_max(hash, row(indexed_at, hash)) AS hash FROM files WHERE path IS NOT NULL GROUP BY path")
def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """The leaves of the last scan, written to the store and read again."""
    from ..session import checkpoint_dir

    last = _scans(spark, root)[1]
    store = Store(spark, f"{checkpoint_dir(spark)}/store")
    store.write(files=last.select("path", "hash", F.lit(0).cast("bigint").alias("size"), F.lit(0.0).alias("mtime_ms"), F.lit("").alias("language")))
    return store.read("files").select("path", "hash")


@registry.add(
    "leaf_changes",
    """WITH f AS (SELECT path, arg_min(hash, row(indexed_at, hash)) AS a, arg_max(hash, row(indexed_at, hash)) AS b FROM files WHERE path IS NOT NULL GROUP BY path)
    SELECT path, a <> b AS changed FROM f""",
)
def leaf_changes(spark: SparkSession, root: str) -> DataFrame:
    return changes.set_leaves(*_scans(spark, root))


@registry.add(
    "upsert_files",
    """WITH old AS (SELECT path, arg_min(hash, row(indexed_at, hash)) AS hash FROM files WHERE path IS NOT NULL GROUP BY path), new AS (SELECT DISTINCT path, sha1(content) AS hash FROM source_texts WHERE path LIKE '%.ts')
    SELECT path, hash FROM old WHERE path NOT IN (SELECT path FROM new) UNION ALL SELECT path, hash FROM new""",
)
def upsert_files(spark: SparkSession, root: str) -> DataFrame:
    fresh = table(spark, root, "source_texts").where("path LIKE '%.ts'").select("path", F.sha1("content").alias("hash"))
    return tables.upsert(_scans(spark, root)[0], fresh, "path")


@registry.add(
    "replace_graph",
    f"""WITH {_LIVE}, gone AS (SELECT DISTINCT path FROM files WHERE repo LIKE '%-core%')
    SELECT id, kind, name, file_path FROM n WHERE file_path NOT IN (SELECT path FROM gone) UNION ALL SELECT id, kind, 'fresh' AS name, file_path FROM n WHERE kind = 'class' AND file_path IN (SELECT path FROM gone)""",
)
def replace_graph(spark: SparkSession, root: str) -> DataFrame:
    """The nodes with those of the files of some repositories replaced."""
    nodes = live(spark, root).select("id", "kind", "name", "file_path")
    gone = table(spark, root, "files").where("repo LIKE '%-core%'").select("path").distinct()
    fresh = nodes.where("kind = 'class'").join(gone.withColumnRenamed("path", "file_path"), "file_path", "left_semi").withColumn("name", F.lit("fresh"))
    return tables.replace_files(nodes, fresh, gone)


@registry.add("delete_kinds", f"WITH {_LIVE} SELECT id, kind FROM e WHERE NOT (kind IN ('calls', 'imports') AND file_path IN (SELECT path FROM files WHERE repo LIKE '%-core%')) OR file_path IS NULL")
def delete_kinds(spark: SparkSession, root: str) -> DataFrame:
    files = table(spark, root, "files").where("repo LIKE '%-core%'").select("path").distinct()
    return tables.delete_edges(links(spark, root), ["calls", "imports"], files).select("id", "kind")


@registry.add("replace_edges", "SELECT id, max(confidence) AS confidence FROM edges WHERE id IS NOT NULL AND NOT isnan(confidence) AND confidence IS NOT NULL GROUP BY id")
def replace_edges(spark: SparkSession, root: str) -> DataFrame:
    known = table(spark, root, "edges").where("id IS NOT NULL AND confidence IS NOT NULL AND NOT isnan(confidence)")
    return tables.strongest(known.select("id", "kind", "confidence", "file_path")).select("id", "confidence")


@registry.add("last_operations", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_operations(spark: SparkSession, root: str) -> DataFrame:
    return changelog.last_operations(table(spark, root, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id").select("user_id", "event_type")


@registry.add(
    "quiet_periods",
    """WITH t AS (SELECT user_id, ts, event_type, event_id, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM t)
    SELECT CAST(user_id AS VARCHAR) AS path, min(ts) AS start, arg_max(event_type, event_id) AS op, count(*) AS n FROM g GROUP BY user_id, burst""",
)
def quiet_periods(spark: SparkSession, root: str) -> DataFrame:
    log = table(spark, root, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("op"), F.col("event_id").alias("seq"), "ts")
    return changelog.quiet_periods(log, "6 hours").select("path", "start", "op", "n")


# extraction ---------------------------------------------------------------------------------------------------------------


@registry.add("asset_read", f"SELECT path, CASE {_CASES} ELSE 'unknown' END AS language, CASE WHEN {_EXT} IN ('pdf', 'mp4', 'mov', 'mkv', 'webm', 'png', 'jpg', 'jpeg', 'gif', 'svg') THEN 0 ELSE length(content) END AS chars FROM source_texts WHERE content IS NOT NULL")
def asset_read(spark: SparkSession, root: str) -> DataFrame:
    texts = table(spark, root, "source_texts").where("content IS NOT NULL").select("path", F.encode("content", "UTF-8").alias("content"))
    return scan.readable(texts).select("path", "language", F.length("text").alias("chars"))


@registry.add(
    "asset_nodes",
    r"""SELECT substr(sha1(path || 'asset' || path || '0' || chr(0)), 1, 20) AS id, path AS name, '[markdown] ' || path AS signature, substr(content, 1, 4000) AS snippet, len(regexp_split_to_array(content, '\r?\n')) AS end_line
    FROM source_texts WHERE path LIKE '%.md' AND content IS NOT NULL""",
)
def asset_nodes(spark: SparkSession, root: str) -> DataFrame:
    texts = table(spark, root, "source_texts").where("content IS NOT NULL").select("path", F.col("content").alias("text"))
    return extract.asset_nodes(texts).select("id", "name", "signature", "snippet", "end_line")


_MADE = """made AS (SELECT DISTINCT id, json_extract_string(meta, '$.method') AS method, json_extract_string(meta, '$.path') AS route, json_extract_string(meta, '$.handlerName') AS handler FROM nodes WHERE kind = 'route' AND meta IS NOT NULL)"""


def _route_texts(spark: SparkSession, root: str) -> DataFrame:
    """Every route of the table written in each of the ways that frameworks have."""
    meta = F.from_json("meta", tables.META)
    made = table(spark, root, "nodes").where("kind = 'route' AND meta IS NOT NULL").select("id", meta["method"].alias("m"), meta["path"].alias("r"), meta["handlerName"].alias("h")).distinct()
    low, title = F.lower("m"), F.initcap(F.lower("m"))
    forms = {
        "call": F.format_string("app.%s('%s', ctrl.%s);\n", low, "r", "h"), "router": F.format_string('  router.%s( "%s" , %s)', low, "r", "h"),
        "decorator": F.format_string("@bp.%s('%s')\n# note\nasync def %s():\n    pass\n", low, "r", "h"), "annotation": F.format_string('@%sMapping(value = "%s")\npublic String show() { return "function %s"; }', title, "r", "h"),
        "far": F.format_string("server.%s(`%s`, (q) => {\n\n\n\n  function %s() {}", low, "r", "h"), "none": F.format_string("apps.%s('%s', %s)", low, "r", "h"),
    }
    return made.select(F.explode(F.array(*[F.struct(F.concat("id", F.lit("/" + k)).alias("path"), v.alias("text")) for k, v in forms.items()])).alias("x")).select("x.*")


@registry.add(
    "route_forms",
    f"""WITH {_MADE}, forms(form, named) AS (VALUES ('call', true), ('router', true), ('decorator', true), ('annotation', true), ('far', false))
    SELECT id || '/' || form AS path, 1 AS line, method || ' ' || route AS name, CASE WHEN named THEN handler END AS handler FROM made, forms""",
)
def route_forms(spark: SparkSession, root: str) -> DataFrame:
    return extract.route_lines(_route_texts(spark, root)).select("path", "line", "name", "handler")


_LINES = r"""ln AS (SELECT path, ext, trim(line, ' ' || chr(9)) AS line, len(line) - len(ltrim(line, ' ' || chr(9))) AS width, nr FROM (
  SELECT path, regexp_extract(path, '\.([a-z]+)$', 1) AS ext, unnest(regexp_split_to_array(content, '\r?\n')) AS line, unnest(range(1, len(regexp_split_to_array(content, '\r?\n')) + 1)) AS nr FROM source_texts WHERE content IS NOT NULL))"""


def _symbols(spark: SparkSession, root: str) -> DataFrame:
    return extract.parse_files(table(spark, root, "source_texts").select("path", F.col("content").alias("text")))["nodes"]


@registry.add(
    "python_definitions",
    rf"""WITH {_LINES} SELECT DISTINCT path AS file_path, regexp_extract(line, '^(?:async +)?(?:def|class) +(\w+)', 1) AS name, CASE WHEN line LIKE 'class %' THEN 'class' WHEN width > 0 THEN 'method' ELSE 'function' END AS kind, nr AS start_line, substr(line, 1, 200) AS signature
    FROM ln WHERE ext = 'py' AND regexp_matches(line, '^(async +)?def +\w+ *\(|^class +\w+')""",
)
def python_definitions(spark: SparkSession, root: str) -> DataFrame:
    return _symbols(spark, root).where("language = 'python' AND kind IN ('class', 'method', 'function')").select("file_path", "name", "kind", "start_line", "signature")


@registry.add(
    "go_definitions",
    rf"""WITH {_LINES} SELECT DISTINCT path AS file_path, CASE WHEN line LIKE 'type %' THEN regexp_extract(line, '^type +(\w+)', 1) ELSE regexp_extract(line, '^func +(?:\([^)]*\) *)?(\w+)', 1) END AS name,
      CASE WHEN line LIKE 'type %' THEN 'class' WHEN line LIKE 'func (%' THEN 'method' ELSE 'function' END AS kind, nr AS start_line
    FROM ln WHERE ext = 'go' AND width <= 1 AND regexp_matches(line, '^func +(\([^)]*\) *)?\w+\(|^type +\w+ +struct')""",
)
def go_definitions(spark: SparkSession, root: str) -> DataFrame:
    return _symbols(spark, root).where("language = 'go' AND kind IN ('class', 'method', 'function')").select("file_path", "name", "kind", "start_line")


@registry.add(
    "java_types",
    rf"""WITH {_LINES} SELECT DISTINCT path AS file_path, regexp_extract(line, 'class +(\w+)', 1) AS name, nr AS start_line, CASE WHEN contains(line, ' implements ') THEN regexp_extract(line, ' implements +(\w+)', 1) END AS super
    FROM ln WHERE ext = 'java' AND width = 0 AND regexp_matches(line, '^(public |final |abstract )*class +\w+')""",
)
def java_types(spark: SparkSession, root: str) -> DataFrame:
    found = _symbols(spark, root).where("language = 'java' AND kind = 'class'")
    return found.select("file_path", "name", "start_line", F.get(F.from_json("meta", tables.META)["supers"], F.lit(0)).alias("super"))


@registry.add(
    "script_imports",
    rf"""WITH {_LINES} SELECT DISTINCT path AS file_path, regexp_extract(line, '["'']([^"'']+)["'']', 1) AS name, nr AS start_line, substr(line, 1, 200) AS signature FROM ln
    WHERE ext IN ('ts', 'tsx', 'mts', 'js', 'jsx', 'mjs') AND regexp_matches(line, '^import\b[^=();"'']*["''][^"'']+["'']|\brequire\(["''][^"'']+["'']\)')""",
)
def script_imports(spark: SparkSession, root: str) -> DataFrame:
    return _symbols(spark, root).where("language IN ('typescript', 'javascript') AND kind = 'import'").select("file_path", "name", "start_line", "signature")


@registry.add(
    "snippet_lines",
    rf"""WITH {_LINES}, raw AS (SELECT path, string_agg(line, chr(10) ORDER BY nr) FILTER (nr <= 60) AS head, count(*) AS n FROM (
        SELECT path, unnest(regexp_split_to_array(content, '\r?\n')) AS line, unnest(range(1, len(regexp_split_to_array(content, '\r?\n')) + 1)) AS nr FROM source_texts WHERE content IS NOT NULL AND path LIKE '%.py') GROUP BY path)
    SELECT path AS file_path, n AS end_line FROM raw""",
)
def snippet_lines(spark: SparkSession, root: str) -> DataFrame:
    """File nodes with their number of lines."""
    return _symbols(spark, root).where("kind = 'file' AND language = 'python'").select("file_path", "end_line")


# resolution ----------------------------------------------------------------------------------------------------------------


@registry.add(
    "supers",
    f"""WITH {_LIVE}, t AS (SELECT id, name, kind, file_path, start_line FROM n WHERE kind IN ('class', 'interface')),
    s AS (SELECT DISTINCT id, file_path, unnest(CAST(json_extract_string(meta, '$.supers[*]') AS VARCHAR[])) AS name FROM n WHERE kind IN ('class', 'interface')),
    g AS (SELECT name, count(*) AS cnt, arg_min(id, row(file_path, start_line, id)) AS to_id, arg_min(kind, row(file_path, start_line, id)) AS kind FROM t GROUP BY name)
    SELECT DISTINCT CASE WHEN g.kind = 'interface' THEN 'implements' ELSE 'extends' END AS kind, s.id AS from_id, g.to_id, CASE WHEN cnt = 1 THEN 0.95 ELSE 0.6 END::DOUBLE AS confidence FROM s JOIN g USING (name) WHERE s.id <> g.to_id""",
)
def supers(spark: SparkSession, root: str) -> DataFrame:
    return resolve.resolve_supers(live(spark, root)).select("kind", "from_id", "to_id", "confidence")


_TREE_SQL = r"""
tree AS (SELECT DISTINCT file_path AS path, regexp_replace(file_path, '\.[A-Za-z]+$', '') AS stem, regexp_extract(file_path, '([^/]*)$', 1) AS base FROM n WHERE file_path IS NOT NULL AND kind <> 'asset'),
nxt AS (SELECT path, lead(path) OVER (ORDER BY path) AS next, lead(stem) OVER (ORDER BY path) AS stem FROM tree),
more AS (SELECT path AS file_path, stem AS name FROM nxt WHERE stem IS NOT NULL UNION ALL SELECT path, './' || regexp_replace(base, '\.[A-Za-z]+$', '') FROM tree UNION ALL SELECT path, '../' || regexp_extract(path, '([^/]+)/[^/]*$', 1) || '/' || base FROM tree WHERE contains(path, '/'))
"""


def _with_imports(spark: SparkSession, root: str) -> DataFrame:
    """The nodes, and an import of each file by its neighbour in the order of paths, of itself beside it, and of itself from above."""
    nodes = live(spark, root)
    tree = nodes.where("file_path IS NOT NULL AND kind <> 'asset'").select(F.col("file_path").alias("path")).distinct()
    # the order of the whole in ranges, each with its own window, and the first of the next range for the last of each
    ordered = materialise(tree.repartitionByRange("path").withColumn("part", F.spark_partition_id()))
    from pyspark.sql import Window

    firsts = ordered.groupBy("part").agg(F.min("path").alias("first"))
    following = F.min("first").over(Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing))
    within = ordered.withColumn("next", F.lead("path").over(Window.partitionBy("part").orderBy("path"))).join(F.broadcast(firsts.select("part", following.alias("later"))), "part")
    bare = lambda c: F.regexp_replace(c, r"\.[A-Za-z]+$", "")
    base = F.element_at(F.split("path", "/"), -1)
    specs = within.select("path", bare(F.coalesce("next", "later")).alias("spec")).where("spec IS NOT NULL").unionByName(tree.select("path", F.concat(F.lit("./"), bare(base)).alias("spec")))
    above = tree.where(F.col("path").contains("/")).select("path", F.concat(F.lit("../"), F.element_at(F.split("path", "/"), -2), F.lit("/"), base).alias("spec"))
    made = specs.unionByName(above).select(F.sha1(F.concat("path", "spec")).alias("id"), F.lit("import").alias("kind"), F.col("spec").alias("name"), F.col("path").alias("file_path"))
    return nodes.unionByName(made, allowMissingColumns=True)


_PATHS_SQL = "files AS (SELECT path FROM tree)"
_N2 = "n AS (SELECT * FROM n0 UNION ALL SELECT md5(file_path || name) AS id, 'import' AS kind, name, file_path, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM more)"
_LIVE2 = _LIVE.replace("n AS (", "n0 AS (", 1)
_TREE2 = _TREE_SQL.replace("FROM n WHERE", "FROM n0 WHERE")


def _paths(spark: SparkSession, root: str) -> DataFrame:
    return live(spark, root).where("file_path IS NOT NULL AND kind <> 'asset'").select(F.col("file_path").alias("path")).distinct()


@registry.add("imports_of_neighbours", f"WITH {_LIVE2}, {_TREE2}, {_PATHS_SQL}, {_N2}, {_IMPORTS_SQL} SELECT file_path, spec, target FROM imp")
def imports_of_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return resolve.resolve_imports(_with_imports(spark, root), _paths(spark, root))


@registry.add(
    "calls_through_imports",
    f"""WITH {_LIVE2}, {_TREE2}, {_PATHS_SQL}, {_N2}, {_IMPORTS_SQL}, {_CALLS_SQL} SELECT from_id, to_id, CAST(max(confidence) AS DOUBLE) AS confidence FROM flat WHERE from_id <> to_id GROUP BY from_id, to_id""",
)
def calls_through_imports(spark: SparkSession, root: str) -> DataFrame:
    return resolve.resolve_calls(table(spark, root, "call_sites"), _with_imports(spark, root), _paths(spark, root)).select("from_id", "to_id", "confidence")


_CHANGED = "changed AS (SELECT path FROM files WHERE path IS NOT NULL GROUP BY path HAVING count(*) > 1)"


def _changed(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "files").where("path IS NOT NULL").groupBy("path").count().where("count > 1").select("path")


@registry.add(
    "affected_files",
    f"""WITH {_LIVE}, {_CHANGED}, names AS (SELECT DISTINCT name FROM n WHERE file_path IN (SELECT path FROM changed)),
    u AS (SELECT callee_name AS name, file_path AS path FROM call_sites UNION ALL SELECT receiver, file_path FROM call_sites UNION ALL SELECT json_extract_string(meta, '$.handlerName'), file_path FROM n WHERE kind = 'route'
      UNION ALL SELECT unnest(CAST(json_extract_string(meta, '$.supers[*]') AS VARCHAR[])), file_path FROM n), {_IMPORTS_SQL}
    SELECT path FROM u WHERE name IN (SELECT name FROM names) UNION SELECT path FROM changed UNION SELECT file_path FROM tried WHERE path IN (SELECT path FROM changed)""",
)
def affected_files(spark: SparkSession, root: str) -> DataFrame:
    nodes = live(spark, root)
    return resolve.affected_files(_changed(spark, root), nodes, nodes, table(spark, root, "call_sites"))


@registry.add(
    "incremental_calls",
    f"""WITH {_LIVE}, {_IMPORTS_SQL}, {_CALLS_SQL} SELECT substr(sha1('calls' || from_id || to_id || chr(0)), 1, 20) AS id, from_id, to_id, CAST(max(confidence) AS DOUBLE) AS confidence FROM flat WHERE from_id <> to_id GROUP BY from_id, to_id""",
)
def incremental_calls(spark: SparkSession, root: str) -> DataFrame:
    """All calls, those of the files that changes affect resolved anew beside what is kept of the others; the same as resolving all."""
    nodes, files = live(spark, root), table(spark, root, "files")
    sites = table(spark, root, "call_sites").drop("file_path").join(nodes.select(F.col("id").alias("caller_id"), "file_path"), "caller_id")
    before = materialise(resolve.resolve_all(sites, nodes, files))
    affected = materialise(resolve.affected_files(_changed(spark, root), nodes, nodes, sites))
    stale = before.withColumn("confidence", F.lit(0.0)).join(affected.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select(*before.columns)
    kept = before.join(affected.withColumnRenamed("path", "file_path"), "file_path", "left_anti").select(*before.columns)
    return resolve.resolve_incremental(kept.unionByName(stale), affected, nodes, sites, files).where("kind = 'calls'").select("id", "from_id", "to_id", "confidence")


@registry.add(
    "resolution_quality",
    f"""WITH {_LIVE}, {_IMPORTS_SQL}, {_CALLS_SQL}, found AS (SELECT from_id, to_id, CAST(max(confidence) AS DOUBLE) AS confidence FROM flat WHERE from_id <> to_id GROUP BY from_id, to_id),
    truth AS (SELECT DISTINCT from_id, to_id FROM e WHERE kind = 'calls' AND from_id IN (SELECT id FROM n) AND to_id IN (SELECT id FROM n)),
    b AS (SELECT coalesce(f.from_id, t.from_id) AS from_id, f.from_id IS NOT NULL AS got, t.from_id IS NOT NULL AS wanted, f.confidence FROM found f FULL JOIN truth t ON f.from_id = t.from_id AND f.to_id = t.to_id)
    SELECT n.language, count(*) FILTER (wanted) AS expected, count(*) FILTER (got) AS found, count(*) FILTER (got AND wanted) AS matched, round(count(*) FILTER (got AND wanted) / nullif(count(*) FILTER (wanted), 0), 6) AS recall,
      round(count(*) FILTER (got AND wanted) / nullif(count(*) FILTER (got), 0), 6) AS precision, round(avg(confidence) FILTER (got AND wanted), 6) AS mean_confidence FROM b JOIN n ON n.id = b.from_id GROUP BY n.language""",
)
def resolution_quality(spark: SparkSession, root: str) -> DataFrame:
    nodes, edges = live(spark, root), links(spark, root)
    found = resolve.resolve_calls(table(spark, root, "call_sites"), nodes, table(spark, root, "files"))
    known = nodes.select("id")
    truth = edges.where("kind = 'calls'").join(known.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(known.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select("from_id", "to_id").distinct()
    return graph.quality(found, truth, nodes)


# graph and exports ----------------------------------------------------------------------------------------------------------


@registry.add(
    "metrics",
    f"""WITH {_LIVE} SELECT (SELECT count(DISTINCT path) FROM files) AS files, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM node_vectors) AS embeddings,
    count(*) AS total, count(*) FILTER (confidence >= 0.8) AS precise FROM e WHERE kind = 'calls'""",
)
def metrics(spark: SparkSession, root: str) -> DataFrame:
    files = table(spark, root, "files").select("path").where("path IS NOT NULL").distinct()
    counts = tables.table_counts(files, live(spark, root), links(spark, root), table(spark, root, "node_vectors"))
    wide = counts.groupBy().pivot("table_name", ["files", "nodes", "edges", "embeddings"]).agg(F.first("n_rows"))
    return wide.crossJoin(tables.edge_quality(links(spark, root)).select("total", "precise"))  # one row on either side


_FOCUS = f"""WITH RECURSIVE {_LIVE}, seed AS (SELECT id FROM n WHERE name = 'get' ORDER BY file_path, start_line, id LIMIT 1),
  x AS MATERIALIZED (SELECT from_id AS a, to_id AS b FROM e UNION SELECT to_id, from_id FROM e),
  hop AS (SELECT id, 0 AS d FROM seed UNION SELECT m.id, h.d + 1 FROM hop h JOIN x ON x.a = h.id JOIN n m ON m.id = x.b WHERE h.d < 2), shown AS (SELECT DISTINCT id FROM hop)"""


def _no_ranks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "node_id string, rank double")


@registry.add("focus_nodes", _FOCUS + " SELECT n.id, CASE WHEN parent IS NULL THEN name ELSE parent || '.' || name END AS label, kind AS \"group\" FROM n JOIN shown USING (id)")
def focus_nodes(spark: SparkSession, root: str) -> DataFrame:
    return graph.export_graph(live(spark, root), links(spark, root), _no_ranks(spark), focus="get")[0].select("id", "label", "group")


_FILLS = " ".join(f"WHEN kind = '{k}' THEN '{c}'" for k, c in render.COLOURS.items())


@registry.add(
    "dot_statements",
    _FOCUS + f""", lab AS (SELECT id, kind, replace(CASE WHEN parent IS NULL THEN name ELSE parent || '.' || name END, '"', '\\"') AS label FROM n JOIN shown USING (id))
    SELECT '  "' || id || '" [label="' || label || '", fillcolor="' || CASE {_FILLS} ELSE '{render.OTHER}' END || '"];' AS line FROM lab
    UNION ALL SELECT '  "' || from_id || '" -> "' || to_id || '" [label="' || kind || '"];' FROM e WHERE from_id IN (SELECT id FROM shown) AND to_id IN (SELECT id FROM shown)""",
)
def dot_statements(spark: SparkSession, root: str) -> DataFrame:
    return render.dot_lines(*graph.export_graph(live(spark, root), links(spark, root), _no_ranks(spark), focus="get")).select("line")


# text -----------------------------------------------------------------------------------------------------------------------


@registry.add(
    "embedding_of_items",
    """WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '[_\\-.]', ' ', 'g'), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1) AS w FROM eval_items),
    g AS (SELECT item_id, unnest(w) AS tok FROM t), x AS (SELECT item_id, tok AS f, 1.0 AS w FROM g UNION ALL SELECT item_id, unnest(list_transform(range(1, length(tok) - 1), lambda i: tok[i:i+2])), 0.5 FROM g WHERE length(tok) > 2),
    h AS (SELECT item_id, w, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, length(f) + 1), lambda i: ascii(f[i])::HUGEINT)), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT AS h FROM x),
    s AS (SELECT item_id, CAST((CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END) % 256 AS INT) AS i, CAST(sum(CASE WHEN h % 2 = 0 THEN w ELSE -w END) AS DOUBLE) AS v FROM h GROUP BY 1, 2)
    SELECT item_id, i, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 4) AS v FROM s WHERE v <> 0""",
)
def embedding_of_items(spark: SparkSession, root: str) -> DataFrame:
    vectors = table(spark, root, "eval_items").select("item_id", F.posexplode(text.local_embedding(F.col("text"), 256)).alias("i", "v"))
    return vectors.where("v <> 0").select("item_id", "i", F.round(F.col("v").cast("double"), 4).alias("v"))

