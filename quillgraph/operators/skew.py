"""Handling of keys that hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heavy_keys(rows: DataFrame, key: str, share: float) -> DataFrame:
    """Keys holding at least ``share`` of ``rows``: (key, n, parts), ``parts`` being how many pieces of ``share`` they make.

    At most ``1/share`` keys can qualify, so the result is small enough to broadcast whatever the input size.
    The count is combined before the shuffle, so a heavy key costs one row per input partition.
    """
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= share * total) & (F.col("n") > 0)).withColumn("parts", F.ceil(F.col("n") / (share * total)).cast("int"))


def piece_share(rows: DataFrame, most: float = 0.01) -> float:
    """The part of all rows that one task should get of one key: an average shuffle partition's, at most ``most``."""
    return min(most, 1.0 / int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def salted(left: DataFrame, right: DataFrame, key: str, share: float, salt_by: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``_salt``: rows of ``left`` with one heavy key are spread over as many salts as the key has pieces of
    ``share``, and the rows of ``right`` with that key stand under each of them. Other keys have salt 0.

    Only the right-hand rows of heavy keys (at most ``1/share`` keys) are repeated. Null keys of ``left``, which match nothing, are
    spread like a key that holds everything.
    """
    heavy = F.broadcast(heavy_keys(left.select(key), key, share).select(F.col(key).alias("_hk"), "parts"))
    parts = F.when(F.col(key).isNull(), F.lit(int(1 / share))).otherwise(F.coalesce("parts", F.lit(1)))
    lhs = left.join(heavy, F.col(key) == F.col("_hk"), "left").withColumn("_salt", F.pmod(F.xxhash64(salt_by), parts).cast("int")).drop("_hk", "parts")
    rhs = right.join(heavy, F.col(key) == F.col("_hk"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("_hk", "parts")
    return lhs, rhs


def salted_left_join(left: DataFrame, right: DataFrame, key: str, *, share: float | None = None, salt_by: Column | None = None) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on ``key`` by sort-merge, heavy keys of ``left`` spread over several tasks (see ``salted``)."""
    lhs, rhs = salted(left, right, key, share or piece_share(left), F.monotonically_increasing_id() if salt_by is None else salt_by)
    return lhs.hint("merge").join(rhs.hint("merge"), [key, "_salt"], "left").drop("_salt")


def compress(rows: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Value-frequency table (key, what, value, n): every key's values with the rows that carry them.

    One pass: each named value becomes one row, then key and value are grouped together before the key alone, so
    no task ever holds the rows of one key. ``value`` is the string form; null stays null.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("what"), col.cast("string").alias("value")) for name, col in values.items()])
    return (
        rows.select(F.col(key).alias("key"), F.inline(pairs))
        .groupBy("key", "what", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


#: Ranges into which an interval of values is divided at once when a median is looked for.
RANGES = 1 << 12


def weighted_medians(values: DataFrame, levels: int = 2) -> DataFrame:
    """(key, median): the exact median of every key of ``values`` (key, v in [0, 1], n), n being how often v occurs.

    No task holds the values of one key. They are counted by range, the range that holds the middle is divided again, and
    only the values of the last range (one in ``RANGES ** levels`` where they are spread) are put in order. For an even number
    the middle is the mean of the two next to it. Rows may be repeated; nulls must be gone.
    """
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = values.select("key", "v", "n", F.lit(0).cast("bigint").alias("cell"))
    # the cells that hold the two middle places, their offset within the key, and those places (counted from 0)
    ends = values.groupBy("key").agg(F.sum("n").alias("m"))
    cells = ends.select("key", F.lit(0).cast("bigint").alias("cell"), F.lit(0).cast("bigint").alias("before"), F.floor((F.col("m") - 1) / 2).alias("lo"), F.floor(F.col("m") / 2).alias("hi"))
    held = first
    for level in range(1, levels + 1):
        finer = F.least(F.floor(F.col("v") * float(RANGES**level)), F.lit(RANGES**level - 1)).cast("bigint")
        held = held.join(cells, ["key", "cell"]).withColumn("cell", finer)
        counted = held.groupBy("key", "cell").agg(F.sum("n").alias("n"), F.min("before").alias("base"), F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.floor(F.first("cell") / RANGES).alias("within"))
        sums = counted.withColumn("after", F.col("base") + F.sum("n").over(upto("key", "within").orderBy("cell"))).withColumn("before", F.col("after") - F.col("n"))
        cells = sums.where("before <= hi AND after > lo").select("key", "cell", "before", "lo", "hi")
        held = held.select("key", "v", "n", "cell")
    last = held.join(cells, ["key", "cell"]).groupBy("key", "cell", "v").agg(F.sum("n").alias("n"), F.min("before").alias("before"), F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    placed = last.withColumn("after", F.col("before") + F.sum("n").over(upto("key", "cell").orderBy("v")))
    middle = lambda at: F.min(F.when(F.col("after") > F.col(at), F.col("v")))
    return placed.groupBy("key").agg(((middle("lo") + middle("hi")) / 2).alias("median"))


def key_profile(
    rows: DataFrame, key: str, *, callers: Column, confidence: Column, months: Column, share: float = 0.02
) -> DataFrame:
    """Exact results per key without gathering a key's rows in one task.

    Returns ``key_value, n_rows, n_callers, mean_confidence, median_confidence, n_months, busiest_month, heavy``.

    * null and blank keys are left out, yet their rows count in the total that ``heavy`` (>= ``share``) refers to
    * null callers and months are not counted; the busiest month is the most frequent, the earlier one on ties
    * a confidence that is null, NaN or outside [0, 1] takes no part in mean and median (null if none is left)
    * an empty input gives no row; columns other than those named are ignored
    """
    keyed = rows.select(
        F.col(key).alias("key"), callers.alias("_caller"), confidence.alias("_conf"), months.alias("_month")
    )
    weighted = compress(keyed, "key", {"caller": F.col("_caller"), "confidence": F.col("_conf"), "month": F.col("_month")})
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    what, n, value = F.col("what"), F.col("n"), F.col("value")
    conf = value.try_cast("double")
    usable = (what == "confidence") & conf.between(0.0, 1.0) & ~F.isnan(conf)
    weighted = weighted.where(F.col("key").isNotNull() & (F.trim(F.regexp_replace("key", r"\s", " ")) != ""))
    medians = weighted_medians(weighted.where(usable).select("key", conf.alias("v"), "n"))
    return (
        weighted.groupBy("key")
        .agg(
            F.sum(F.when(what == "month", n)).alias("n_rows"),
            F.count(F.when((what == "caller") & value.isNotNull(), 1)).alias("n_callers"),
            (F.sum(F.when(usable, conf * n)) / F.sum(F.when(usable, n))).alias("mean_confidence"),
            F.count(F.when((what == "month") & value.isNotNull(), 1)).alias("n_months"),
            F.min(F.when((what == "month") & value.isNotNull(), F.struct((-n).alias("w"), value.alias("m"))))["m"].alias("busiest_month"),
        )
        .join(medians, "key", "left")
        .select(
            F.col("key").alias("key_value"), "n_rows", "n_callers", "mean_confidence", F.col("median").alias("median_confidence"), "n_months",
            "busiest_month", (F.col("n_rows") >= share * total).alias("heavy"),
        )
    )
