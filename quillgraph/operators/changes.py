"""Change detection: snapshot differences and a Merkle root over content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import content_hash
from ..session import materialise


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, op): added, changed or removed between two snapshots (path, hash); unchanged paths don't appear."""
    b = before.select("path", F.col("hash").alias("old"))
    a = after.select("path", F.col("hash").alias("new"))
    op = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return b.join(a, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("path", op.alias("op"))


def set_leaves(before: DataFrame, leaves: DataFrame) -> DataFrame:
    """(path, changed): for each leaf (path, hash) that is set, whether that changes what ``before`` (path, hash) holds; a null hash
    deletes the leaf."""
    old = before.select("path", F.col("hash").alias("old"))
    return leaves.select("path", "hash").join(old, "path", "left").select("path", (~F.col("hash").eqNullSafe(F.col("old"))).alias("changed"))


def diff_stats(diff: DataFrame, scanned: int, embedded: int = 0) -> DataFrame:
    """One row (scanned, added, changed, removed, embedded)."""
    n = lambda op: F.count_if(F.col("op") == op).alias(op)
    return diff.agg(F.lit(scanned).alias("scanned"), n("added"), n("changed"), n("removed"), F.lit(embedded).alias("embedded"))


def merkle_leaves(files: DataFrame) -> DataFrame:
    """(n, leaf): leaf hashes in the order of the paths, numbered from 0 without bringing all rows into one task."""
    parts = files.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = materialise(files.select("path", "hash").repartitionByRange(int(parts), "path").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = totals.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("path")) - 1
    return ranged.join(F.broadcast(before), "part").select((F.col("before") + nth).alias("n"), content_hash(F.col("path"), F.col("hash")).alias("leaf"))


#: Levels of the tree that one task reduces by itself; its leaves are the 2^LEVELS that belong together.
LEVELS = 12


def _reduce(leaves, levels: int):
    """The nodes ``levels`` above a list of ``leaves``, or their single root where that comes first."""

    def up(nodes):
        pair = lambda i: content_hash(F.element_at(nodes, i), F.element_at(nodes, F.least(i + 1, F.size(nodes))))
        return F.transform(F.sequence(F.lit(1), F.size(nodes), F.lit(2)), pair)

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), leaves, lambda nodes, _: F.when(F.size(nodes) > 1, up(nodes)).otherwise(nodes))


def merkle_root(files: DataFrame) -> str:
    """The root over (path, hash): pairs are hashed level by level, an odd last one with itself; no files: the hash of ``empty``.

    Blocks of 2^LEVELS neighbouring nodes are reduced within a task, so a billion files take three rounds.
    """
    level = merkle_leaves(files)
    n = files.count()
    if not n:
        return files.sparkSession.range(1).select(content_hash(F.lit("empty")).alias("r")).head()["r"]
    width = 1 << LEVELS
    while n > 1:
        block = level.groupBy(F.floor(F.col("n") / width).alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "leaf"))), lambda s: s["leaf"]).alias("leaves"))
        # alone at some level, the last node is still hashed with itself as long as other blocks have a node there
        lone = lambda h: content_hash(h, h)
        top = F.element_at(_reduce(F.col("leaves"), LEVELS), 1)
        if n > width:
            short = F.lit(LEVELS) - F.ceil(F.log2(F.size("leaves").cast("double"))).cast("int")
            top = F.when(short > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), top, lambda h, _: lone(h))).otherwise(top)
        level = materialise(block.select("n", top.alias("leaf")))
        n = -(-n // width)
    return level.head()["leaf"]
