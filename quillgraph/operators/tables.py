"""Stored relations: last deliveries, point and set lookups, and updates by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "id kind name file_path language start_line end_line signature snippet meta".split()
SYMBOLS = ("function", "method", "class", "interface")
RANKED = (*SYMBOLS, "route")
META = "parent string, supers array<string>, method string, path string, handlerName string, assetKind string"


def last_delivery(rows: DataFrame, key: str = "id") -> DataFrame:
    """One row for each key, the one that arrived last; rows without key left out. Pre-aggregated, not windowed."""
    cols = [c for c in rows.columns if c != key]
    newest = F.struct(*[F.col(c) for c in ("arrived_at", "indexed_at") if c in cols])
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), newest).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def live_nodes(nodes: DataFrame) -> DataFrame:
    """Current symbols: last deliveries that aren't deleted, with ``parent`` from meta."""
    last = last_delivery(nodes)
    live = last.where(F.col("deleted_at").isNull()) if "deleted_at" in last.columns else last
    return live.select(*NODE, F.get_json_object("meta", "$.parent").alias("parent"))


def clean_edges(edges: DataFrame) -> DataFrame:
    """Last deliveries with tidy ends; a confidence that is null, NaN or outside [0, 1] becomes 0."""
    tidy = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    conf = F.col("confidence")
    return last_delivery(edges).select(
        "id", "kind", tidy("from_id").alias("from_id"), tidy("to_id").alias("to_id"),
        F.when(conf.between(0.0, 1.0), conf).otherwise(F.lit(0.0)).alias("confidence"), "file_path",
    ).where("from_id <> '' AND to_id <> ''")


def order_key(prefix: str = "") -> Column:
    """The order in which "first" is meant wherever several rows qualify: path, line, id."""
    return F.struct(*[F.col(prefix + c) for c in ("file_path", "start_line", "id")])


def with_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def with_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("name") == name)


def of_kinds(rows: DataFrame, kinds) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds))


def outgoing(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where(F.col("from_id") == node_id)


def incoming(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where(F.col("to_id") == node_id)


def missing_vectors(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes, imports aside, without a vector."""
    return nodes.where("kind <> 'import'").join(vectors.select(F.col("node_id").alias("id")), "id", "left_anti")


def without_dangling(edges: DataFrame, nodes: DataFrame, kinds=None) -> DataFrame:
    """Edges but those (of ``kinds``) whose target isn't a node."""
    gone = edges.join(nodes.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    gone = gone.where(F.col("kind").isin(*kinds)) if kinds else gone
    return edges.join(gone.select("id"), "id", "left_anti")


def replace_files(stored: DataFrame, fresh: DataFrame, files: DataFrame, column: str = "file_path") -> DataFrame:
    """``stored`` with the rows of ``files`` (path) replaced by ``fresh``; a file without fresh rows is removed."""
    return stored.join(files.select(F.col("path").alias(column)), column, "left_anti").select(*stored.columns).unionByName(fresh.select(*stored.columns))


def upsert(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Insert or replace by key; of several fresh rows with one key the first in the order of all columns stays."""
    one = fresh.groupBy(key).agg(F.min(F.struct(*[c for c in fresh.columns if c != key])).alias("r"))
    one = one.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in stored.columns])
    return stored.join(one.select(key), key, "left_anti").select(*stored.columns).unionByName(one)


def delete_edges(edges: DataFrame, kinds, files: DataFrame | None = None) -> DataFrame:
    """Edges but those of ``kinds``, all or of ``files`` (path)."""
    hit = edges.where(F.col("kind").isin(*kinds))
    if files is not None:
        hit = hit.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    return edges.join(hit.select("id"), "id", "left_anti")


def strongest(edges: DataFrame) -> DataFrame:
    """One edge for each id, the one with the highest confidence."""
    cols = [c for c in edges.columns if c != "id"]
    return edges.groupBy("id").agg(F.max_by(F.struct(*cols), F.struct("confidence", "file_path")).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in cols])


def table_counts(files: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(table_name, n_rows) of the four stored tables."""
    out = None
    for name, df in (("files", files), ("nodes", nodes), ("edges", edges), ("embeddings", vectors)):
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def edge_quality(edges: DataFrame) -> DataFrame:
    """One row: call edges in all, precise (>= 0.8), probable (>= 0.5), ambiguous, and the precise percentage."""
    c = F.col("confidence")
    n = F.count(F.lit(1))
    precise = F.count_if(c >= 0.8)
    return edges.where("kind = 'calls'").agg(
        n.alias("total"), precise.alias("precise"), F.count_if((c >= 0.5) & (c < 0.8)).alias("probable"), F.count_if(c < 0.5).alias("ambiguous"),
        F.coalesce(F.floor(F.try_divide(precise * 1000.0, n) + 0.5) / 10, F.lit(0.0)).alias("precise_pct"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges of every kind that begin or end there."""
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))

