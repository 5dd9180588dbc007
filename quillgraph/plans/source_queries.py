"""Queries of scanning, change detection and extraction on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, extract
from ..sources import scan
from ..session import table
from .registry import Registry

registry = Registry()

_EXT = r"lower(regexp_extract(path, '[^/]\.([^./]*)$', 1))"
_CASES = " ".join(f"WHEN {_EXT} = '{e}' THEN '{k}'" for d in (scan.LANGUAGES, scan.ASSETS) for k, es in d.items() for e in es.split())


@registry.add("language_detect", f"SELECT DISTINCT path, CASE {_CASES} ELSE 'unknown' END AS detected FROM files WHERE path IS NOT NULL")
def language_detect(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "files").where("path IS NOT NULL").select("path", scan.detect_language(F.col("path")).alias("detected")).distinct()


@registry.add("file_hash", "SELECT path, sha1(content) AS hash FROM source_texts")
def file_hash(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "source_texts").select("path", F.sha1("content").alias("hash"))


_EXCLUDED = scan.exclusion_pattern(scan.DEFAULT_EXCLUDES).replace("'", "''")


@registry.add("scan_excludes", f"SELECT path FROM source_texts WHERE NOT regexp_matches(path, '{_EXCLUDED}') AND strlen(content) <= 1500000")
def scan_excludes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "source_texts").where(~F.col("path").rlike(scan.exclusion_pattern(scan.DEFAULT_EXCLUDES)) & (F.octet_length("content") <= scan.MAX_FILE_BYTES)).select("path")


def _scans(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The first and the last scan of each path; between them stand files scanned again."""
    files = table(spark, root, "files").where("path IS NOT NULL")
    pick = lambda f: files.groupBy("path").agg(f("hash", F.struct("indexed_at", "hash")).alias("hash"))
    return pick(F.min_by), pick(F.max_by)


_SCANS_SQL = """first_scan AS (SELECT path, arg_min(hash, row(indexed_at, hash)) AS hash FROM files WHERE path IS NOT NULL GROUP BY path),
    last_scan AS (SELECT path, arg_max(hash, row(indexed_at, hash)) AS hash FROM files WHERE path IS NOT NULL GROUP BY path),
    b AS (SELECT * FROM first_scan WHERE substr(hash, 1, 1) <> '0'), a AS (SELECT path, CASE WHEN substr(hash, 1, 1) = '1' THEN 'x' || hash ELSE hash END AS hash FROM last_scan WHERE substr(hash, 1, 1) <> '2')"""


def _two_snapshots(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    first, last = _scans(spark, root)
    start = F.substring("hash", 1, 1)
    return first.where(start != "0"), last.where(start != "2").select("path", F.when(start == "1", F.concat(F.lit("x"), F.col("hash"))).otherwise(F.col("hash")).alias("hash"))


@registry.add(
    "snapshot_diff",
    f"""WITH {_SCANS_SQL} SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS op
    FROM b FULL JOIN a ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash""",
)
def snapshot_diff(spark: SparkSession, root: str) -> DataFrame:
    return changes.snapshot_diff(*_two_snapshots(spark, root))


@registry.add(
    "diff_stats",
    f"""WITH {_SCANS_SQL}, d AS (SELECT CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS op
    FROM b FULL JOIN a ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash)
    SELECT (SELECT count(*) FROM a) AS scanned, count(*) FILTER (op = 'added') AS added, count(*) FILTER (op = 'changed') AS changed, count(*) FILTER (op = 'removed') AS removed, 0 AS embedded FROM d""",
)
def diff_stats(spark: SparkSession, root: str) -> DataFrame:
    before, after = _two_snapshots(spark, root)
    return changes.diff_stats(changes.snapshot_diff(before, after), after.count())


@registry.add(
    "merkle_root",
    """WITH RECURSIVE f AS (SELECT path, arg_max(hash, row(indexed_at, hash)) AS hash FROM files WHERE path IS NOT NULL GROUP BY path),
    lv AS (SELECT 0 AS depth, row_number() OVER (ORDER BY path) - 1 AS n, sha1(path || hash || chr(0)) AS leaf FROM f
      UNION ALL SELECT depth + 1, n // 2, sha1(max(leaf) FILTER (n % 2 = 0) || coalesce(max(leaf) FILTER (n % 2 = 1), max(leaf) FILTER (n % 2 = 0)) || chr(0))
      FROM lv WHERE (SELECT count(*) FROM lv) > 1 GROUP BY depth, n // 2)
    SELECT arg_max(leaf, depth) AS root FROM lv""",
)
def merkle_root(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame([(changes.merkle_root(_scans(spark, root)[1]),)], "root string")


_ROUTE_SQL = r"""
ln AS (SELECT path, line, nr FROM (SELECT path, unnest(regexp_split_to_array(content, '\r?\n')) AS line, unnest(range(1, len(regexp_split_to_array(content, '\r?\n')) + 1)) AS nr FROM source_texts WHERE content IS NOT NULL)),
hit AS (SELECT path, nr, p.nth, regexp_extract(line, p.rx, 1) AS method, regexp_extract(line, p.rx, 2) AS route FROM ln, (VALUES
  (1, '\b(?:app|router|api|server|router?)\.(get|post|put|patch|delete|options|head|all)\s*\(\s*[''"`]([^''"`]+)[''"`]'),
  (2, '@\w+\.(get|post|put|patch|delete|route)\s*\(\s*[''"`]([^''"`]+)[''"`]'),
  (3, '@(Get|Post|Put|Patch|Delete|Request)Mapping\s*\(\s*(?:value\s*=\s*)?[''"]([^''"]+)[''"]')) p(nth, rx))
"""


@registry.add("route_lines", f"WITH {_ROUTE_SQL} SELECT path, nr AS line, upper(method) || ' ' || route AS name FROM hit WHERE method <> ''")
def route_lines(spark: SparkSession, root: str) -> DataFrame:
    texts = table(spark, root, "source_texts").where("content IS NOT NULL")
    return extract.route_lines(texts.select("path", F.col("content").alias("text"))).select("path", "line", "name")


@registry.add("extract_symbols")
def extract_symbols(spark: SparkSession, root: str) -> DataFrame:
    return extract.parse_files(table(spark, root, "source_texts").select("path", F.col("content").alias("text")))["nodes"].select("id", "kind", "name", "file_path", "start_line", "end_line")


@registry.add("extract_call_sites")
def extract_call_sites(spark: SparkSession, root: str) -> DataFrame:
    return extract.parse_files(table(spark, root, "source_texts").select("path", F.col("content").alias("text")))["call_sites"]
