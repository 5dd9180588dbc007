"""One ranking from scores on different scales: a Borda count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import materialise


def _usable(c: Column) -> Column:
    c = c.cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c + F.lit(0.0))


def positions(values: DataFrame, partitions: int | None = None) -> DataFrame:
    """(value, place) for a table (value, n) of distinct values: the mean of the competition ranks its rows tie for, 1 lowest.

    No task sees all values: they are divided into ranges, each range is numbered by itself, and the ranges' totals, one
    row each, give what stands before a range.
    """
    spark = values.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(values.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(F.broadcast(before), "part").select(
        "value", (F.col("before") + F.sum("n").over(own) - F.col("n") + (F.col("n") + 1) / 2).alias("place")
    )


def borda(items: DataFrame, scores: dict[str, float], id_col: str = "node_id") -> DataFrame:
    """Ranks ``items`` by the weighted Borda points of ``scores`` (column name to weight).

    Returns (id_col, the scores, points, place): an item's points for one score are ``(rank - 0.5) / ranked``, rank 1 being
    the lowest of the ``ranked`` items that have it and ties sharing the mean of their ranks; a missing score (null, NaN,
    infinite) gets 0.5, the middle. ``points`` is the weighted mean, ``place`` counts from the highest, points that are equal to
    twelve digits by id.

    Only the order within a score matters, so no score counts for more because its range is larger. Items are expected
    once each; an empty input gives an empty ranking.
    """
    total = float(sum(scores.values()))
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    # read several times below, for each score and once more for the points
    base = materialise(items.select(id_col, *[_usable(F.col(c)).alias(c) for c in scores]))
    points: Column = F.lit(0.0)
    for c, weight in scores.items():
        counted = base.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        place = positions(counted)
        ranked = base.agg(F.count(c).alias("m")).scalar()
        # missing scores match nothing; a number of their own keeps them from meeting in one task
        own = F.when(F.col(c).isNull(), F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) + 1).otherwise(F.lit(0))
        right = place.select(F.col("value").alias(c), F.col("place").alias(f"_{c}"), F.lit(0).cast("bigint").alias("_own"))
        base = base.withColumn("_own", own.cast("bigint")).join(right, [c, "_own"], "left").drop("_own")
        points = points + F.lit(weight / total) * F.coalesce((F.col(f"_{c}") - 0.5) / ranked, F.lit(0.5))
    summed = materialise(base.select(id_col, *scores, F.round(points, 12).alias("points")))
    # the order of the whole: ranges of (points, id) numbered each by itself, as for the scores
    ordered = materialise(summed.repartitionByRange(F.desc("points"), F.asc(id_col)).withColumn("part", F.spark_partition_id()))
    totals = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
    before = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = Window.partitionBy("part").orderBy(F.desc("points"), id_col)
    return ordered.join(F.broadcast(before), "part").select(id_col, *scores, F.round("points", 9).alias("points"), (F.col("before") + F.row_number().over(own)).alias("place"))


def node_scores(nodes: DataFrame, ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, rank, confidence, in_degree) for every node: its last computed rank, the mean confidence of its incoming
    edges (those within [0, 1]) and their number; an edge delivered twice counts once.

    Several ranks computed at one time: the greatest. A node without edges has in_degree 0 and no confidence.
    """
    last = ranks.where(F.col("node_id").isNotNull()).groupBy("node_id").agg(
        F.max(F.struct("computed_at", F.when(~F.isnan("rank"), F.col("rank")).alias("rank")))["rank"].alias("rank")
    )
    clean = F.lower(F.regexp_replace("to_id", r"^\s+|\s+$", ""))
    once = edges.select("id", clean.alias("node_id"), F.when(F.col("confidence").between(0.0, 1.0), F.col("confidence")).alias("confidence")).where("node_id <> ''")
    per_edge = once.groupBy("node_id", "id").agg(F.max("confidence").alias("confidence"))
    incoming = per_edge.groupBy("node_id").agg(F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("in_degree"))
    ids = nodes.select(F.col("id").alias("node_id")).where("node_id IS NOT NULL").distinct()
    return (
        ids.join(last, "node_id", "left")
        .join(incoming, "node_id", "left")
        .select("node_id", "rank", F.round("confidence", 9).alias("confidence"), F.coalesce("in_degree", F.lit(0)).cast("double").alias("in_degree"))
    )
