"""Change-log streams: files arrive as (path, op, content, seq) rows, the last operation of a path wins.

A file source sees neither edits nor deletions, so a watcher writes a change log; each micro-batch is debounced to one operation
for each path and applied to the stored tables like a small index run. Batches are serial.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG_SCHEMA = "path string, op string, content string, seq bigint, ts timestamp"


def read_log(spark: SparkSession, folder: str, schema: str = LOG_SCHEMA, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def last_operations(batch: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """One row for each key, the one of the highest sequence number."""
    cols = [c for c in batch.columns if c != key]
    return batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def quiet_periods(log: DataFrame, gap: str = "200 milliseconds", late: str = "10 minutes") -> DataFrame:
    """(path, start, end, op, n): debouncing in event time, one row for each path and burst of changes without a gap; rows later than
    ``late`` behind the newest are dropped by the watermark."""
    marked = log.withWatermark("ts", late) if log.isStreaming else log
    return (
        marked.groupBy("path", F.session_window("ts", gap).alias("w"))
        .agg(F.max_by("op", "seq").alias("op"), F.count(F.lit(1)).alias("n"))
        .select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "op", "n")
    )


def real_changes(log: DataFrame) -> DataFrame:
    """(path, op, hash): operations that change something, by the hash last seen for each path.

    Keeps one hash for each path in the state store; an upsert with the known hash or the removal of an unknown path is dropped. An
    upsert without content is a removal.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for op, h in zip(rows["op"], rows["hash"]):
            new = None if op == "remove" or h is None or h != h else h
            if new != known:
                out.append((key[0], "remove" if new is None else "upsert", new))
                known = new
        if known is None:
            if state.exists:
                state.remove()
        else:
            state.update((known,))
        yield pd.DataFrame(out, columns=["path", "op", "hash"])

    hashed = log.where("path IS NOT NULL").select("path", "op", F.sha1("content").alias("hash"), "seq")
    return hashed.groupBy("path").applyInPandasWithState(step, "path string, op string, hash string", "hash string", "append", GroupStateTimeout.NoTimeout)


def apply_log(log: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str, on_batch: Callable[[dict], None] | None = None, trigger: dict | None = None):
    """Start a query that hands each batch's upserts (path, content) and removals (path) to ``apply``; returns the query.

    A batch that fails is reported as ``error`` and stops the query; it is run again from the checkpoint.
    """

    def each(batch: DataFrame, number: int) -> None:
        last = last_operations(batch).persist()
        try:
            gone = F.col("op").isin("remove", "unlink") | F.col("content").isNull()
            upserts, removes = last.where(~gone).select("path", "content"), last.where(gone).select("path")
            apply(upserts, removes)
            if on_batch:
                on_batch({"batch": number, "upserts": upserts.count(), "removes": removes.count()})
        except Exception as e:
            if on_batch:
                on_batch({"batch": number, "error": str(e)})
            raise
        finally:
            last.unpersist()

    return log.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
