"""Identity rules as SHA-1 expressions; bit-exact and foldable inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(*parts: Column) -> Column:
    """Hex SHA-1 of the parts' concatenation and one NUL."""
    return F.sha1(F.concat(*[p.cast("string") for p in parts], F.char(F.lit(0))))


def node_id(path: Column, kind: Column, qualified: Column, start_line: Column) -> Column:
    return F.substring(content_hash(path, kind, qualified, start_line), 1, 20)


def edge_id(kind: Column, from_id: Column, to_id: Column) -> Column:
    return F.substring(content_hash(kind, from_id, to_id), 1, 20)


def documents_edge_id(asset: Column, target: Column) -> Column:
    """The id of an asset's edge, without the trailing NUL."""
    return F.substring(F.sha1(F.concat(F.lit("documents"), asset, target)), 1, 20)


def qualified_name(name: Column, parent: Column) -> Column:
    return F.when(parent.isNull(), name).otherwise(F.concat(parent, F.lit("."), name))
