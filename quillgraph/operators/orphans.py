"""References whose parent record is missing, already deleted, or not there yet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import piece_share, salted

#: White space removed on both ends of a reference, tabs and line ends included.
_ENDS = r"^\s+|\s+$"
#: The end of an interval that has none.
_OPEN = "9999-12-31 00:00:00"


def normal_ref(ref: Column) -> Column:
    return F.lower(F.regexp_replace(ref, _ENDS, ""))


@dataclass(frozen=True)
class RefField:
    """One referring column: where it comes from and how a record of it is named."""

    source_table: str
    ref_field: str
    record_key: str
    at: str = "indexed_at"


def references(tables: dict[str, DataFrame], fields: list[RefField]) -> DataFrame:
    """All references of ``fields`` as (source_table, ref_field, record_key, ref, at); null and blank ones left out."""
    parts = []
    for f in fields:
        src = tables[f.source_table]
        parts.append(
            src.select(
                F.lit(f.source_table).alias("source_table"),
                F.lit(f.ref_field).alias("ref_field"),
                F.col(f.record_key).cast("string").alias("record_key"),
                normal_ref(F.col(f.ref_field)).alias("ref"),
                F.col(f.at).alias("at"),
            ).where(F.col("ref").isNotNull() & (F.col("ref") != ""))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validity(parents: DataFrame, key: str = "id", start: str = "indexed_at", end: str = "deleted_at") -> DataFrame:
    """The events of parent keys (ref, t, until): one with t null for each key, and for each start of an interval the latest end of
    those that begin there, far in the future where one has none.

    Repeated deliveries collapse before the shuffle. An interval that ends no later than it starts is never live; it is
    kept so that a reference to it counts as deleted.
    """
    known = parents.where(F.col(key).isNotNull()).select(F.col(key).alias("ref"), F.col(start).alias("s"), F.coalesce(F.col(end), F.lit(_OPEN).cast("timestamp")).alias("e"))
    events = known.select("ref", F.explode(F.array(F.struct(F.lit(None).cast("timestamp").alias("t"), F.lit(None).cast("timestamp").alias("until")), F.struct(F.col("s").alias("t"), F.when(F.col("s").isNotNull(), F.col("e")).alias("until")))).alias("x"))
    return events.groupBy("ref", F.col("x.t").alias("t")).agg(F.max("x.until").alias("until"))


def classify_references(refs: DataFrame, parents: DataFrame, *, share: float | None = None) -> DataFrame:
    """Adds ``status`` (live, missing, deleted, late) to every reference.

    References and parents are partitioned by the key and sorted by key and time, and one pass merges them: the latest end
    among the intervals begun so far tells whether one is live. A key with more than ``share`` of the references is spread over as
    many tasks as it has such shares, its parent's events repeated for each.

    * live: an interval with start <= at and (end null or end > at)
    * missing: no parent row of that key; late: every interval starts after ``at``; deleted: the others
    * ``at`` null: never live; missing without a parent row, else late
    * empty inputs give an empty result or, for empty parents, missing throughout
    """
    keyed = refs.select("ref", F.struct(*refs.columns).alias("row"))
    lhs, rhs = salted(keyed, validity(parents), "ref", share or piece_share(refs), F.col("row.record_key"))
    no = F.lit(None)
    both = lhs.select("ref", "_salt", F.col("row.at").alias("t"), F.lit(1).alias("side"), no.cast("timestamp").alias("until"), "row").unionByName(
        rhs.select("ref", "_salt", "t", F.lit(0).alias("side"), "until", no.cast(lhs.schema["row"].dataType).alias("row"))
    )
    # nulls come first, so a key's event without time precedes all of its references, also those without time
    so_far = Window.partitionBy("ref", "_salt").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = both.select(
        "row", "side", F.max(1 - F.col("side")).over(so_far).alias("known"), F.max("until").over(so_far).alias("until"),
        F.max(F.when((F.col("side") == 0) & F.col("t").isNotNull(), 1)).over(so_far).alias("begun"),
    ).where("side = 1")
    live = F.coalesce(F.col("until") > F.col("row.at"), F.lit(False))
    status = F.when(F.col("known") == 0, "missing").when(live, "live").when(F.col("begun") == 1, "deleted").otherwise("late")
    return merged.select("row.*", status.alias("status"))


def orphan_references(refs: DataFrame, parents: DataFrame, **kw) -> DataFrame:
    """Orphans, one row per record and field: (source_table, ref_field, record_key, status, month).

    A record delivered twice counts once; where its deliveries disagree the reference is an orphan if any of them is.
    """
    return (
        classify_references(refs, parents, **kw)
        .where(F.col("status") != "live")
        .groupBy("source_table", "ref_field", "record_key")
        .agg(F.min(F.struct("at", "status")).alias("_first"))
        .select(
            "source_table", "ref_field", "record_key",
            F.col("_first.status").alias("status"),
            F.date_format("_first.at", "yyyy-MM").alias("month"),
        )
    )
