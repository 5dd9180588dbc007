"""Queries on whole tables: references without a record, and results per key under heavy skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import orphans, skew
from ..session import table
from .registry import Registry

registry = Registry()

FIELDS = [
    orphans.RefField("edges", "from_id", "id"),
    orphans.RefField("edges", "to_id", "id"),
    orphans.RefField("call_sites", "caller_id", "site_id"),
    orphans.RefField("node_vectors", "node_id", "node_id"),
]

_REFS_SQL = r"""
refs AS (
  SELECT source_table, ref_field, record_key, seen, lower(regexp_replace(ref, '^\s+|\s+$', '', 'g')) AS ref FROM (
    SELECT 'edges' AS source_table, 'from_id' AS ref_field, id AS record_key, from_id AS ref, indexed_at AS seen FROM edges
    UNION ALL SELECT 'edges', 'to_id', id, to_id, indexed_at FROM edges
    UNION ALL SELECT 'call_sites', 'caller_id', CAST(site_id AS VARCHAR), caller_id, indexed_at FROM call_sites
    UNION ALL SELECT 'node_vectors', 'node_id', node_id, node_id, indexed_at FROM node_vectors)
),
judged AS (
  SELECT r.source_table, r.ref_field, r.record_key, r.seen,
    CASE WHEN count(n.id) = 0 THEN 'missing'
         WHEN coalesce(bool_or(n.indexed_at <= r.seen AND (n.deleted_at IS NULL OR n.deleted_at > r.seen)), false) THEN 'live'
         WHEN coalesce(bool_or(n.indexed_at <= r.seen), false) THEN 'deleted' ELSE 'late' END AS status
  FROM (SELECT DISTINCT * FROM refs WHERE ref IS NOT NULL AND ref <> '') r
  LEFT JOIN (SELECT DISTINCT id, indexed_at, deleted_at FROM nodes) n ON n.id = r.ref
  GROUP BY r.source_table, r.ref_field, r.record_key, r.seen, r.ref
),
orphan AS (
  SELECT source_table, ref_field, record_key,
    arg_min(status, row(seen, status)) AS status, strftime(min(seen), '%Y-%m') AS month
  FROM judged WHERE status <> 'live' GROUP BY ALL
)
"""
_REFS_SQL = _REFS_SQL.replace("GROUP BY ALL", "GROUP BY source_table, ref_field, record_key")


def _orphans(spark: SparkSession, root: str) -> DataFrame:
    names = {f.source_table for f in FIELDS}
    refs = orphans.references({n: table(spark, root, n) for n in names}, FIELDS)
    return orphans.orphan_references(refs, table(spark, root, "nodes"))


@registry.add(
    "p4_found", f"WITH {_REFS_SQL} SELECT source_table, ref_field, record_key FROM orphan"
)
def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return _orphans(spark, root).select("source_table", "ref_field", "record_key")


@registry.add(
    "p4_counts",
    f"WITH {_REFS_SQL} SELECT source_table, ref_field, month, status, count(*) AS orphans FROM orphan "
    "GROUP BY source_table, ref_field, month, status",
)
def p4_counts(spark: SparkSession, root: str) -> DataFrame:
    return (
        _orphans(spark, root)
        .groupBy("source_table", "ref_field", "month", "status")
        .agg(F.count(F.lit(1)).alias("orphans"))
    )


def _profiles(spark: SparkSession, root: str) -> DataFrame:
    month = F.date_format("indexed_at", "yyyy-MM")
    edges = skew.key_profile(
        table(spark, root, "edges"), "to_id", callers=F.col("from_id"), confidence=F.col("confidence"), months=month
    )
    calls = skew.key_profile(
        table(spark, root, "call_sites"), "callee_name", callers=F.col("caller_id"),
        confidence=F.lit(None).cast("double"), months=month,
    )
    return edges.select(F.lit("edges").alias("source_table"), "*").unionByName(
        calls.select(F.lit("call_sites").alias("source_table"), "*")
    )


_BLANK = r"regexp_replace(key_value, '\s', '', 'g') <> ''"
_KEYS_SQL = """
keyed AS (
  SELECT 'edges' AS source_table, to_id AS key_value, from_id AS caller, confidence, strftime(indexed_at, '%Y-%m') AS month FROM edges
  UNION ALL SELECT 'call_sites', callee_name, caller_id, NULL, strftime(indexed_at, '%Y-%m') FROM call_sites
),
totals AS (SELECT source_table, count(*) AS total FROM keyed GROUP BY source_table)
"""


@registry.add(
    "p6_found",
    f"WITH {_KEYS_SQL} SELECT k.source_table, k.key_value FROM keyed k JOIN totals USING (source_table) "
    f"WHERE {_BLANK} GROUP BY k.source_table, k.key_value HAVING count(*) >= 0.02 * any_value(total)",
)
def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return _profiles(spark, root).where("heavy").select("source_table", "key_value")


@registry.add(
    "p6_profiles",
    f"""WITH {_KEYS_SQL},
    months AS (SELECT source_table, key_value, arg_max(month, row(n, -mon)) AS busiest_month FROM (
        SELECT source_table, key_value, month, count(*) AS n, CAST(replace(month, '-', '') AS INT) AS mon FROM keyed
        WHERE month IS NOT NULL GROUP BY source_table, key_value, month) GROUP BY source_table, key_value)
    SELECT k.source_table, k.key_value, count(*) AS n_rows, count(DISTINCT caller) AS n_callers,
      round(avg(confidence) FILTER (confidence BETWEEN 0 AND 1), 6) AS mean_confidence,
      round(quantile_cont(confidence, 0.5) FILTER (confidence BETWEEN 0 AND 1), 6) AS median_confidence,
      count(DISTINCT month) AS n_months, any_value(m.busiest_month) AS busiest_month,
      count(*) >= 0.02 * any_value(total) AS heavy
    FROM keyed k JOIN totals USING (source_table) LEFT JOIN months m USING (source_table, key_value)
    WHERE {_BLANK.replace('key_value', 'k.key_value')} GROUP BY k.source_table, k.key_value""",
)
def p6_profiles(spark: SparkSession, root: str) -> DataFrame:
    return _profiles(spark, root).withColumns(
        {c: F.round(c, 6) for c in ("mean_confidence", "median_confidence")}
    )
