"""Mixing sources to target shares of the total size, by hash-threshold histograms."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import materialise
from .abuse import normal_source

#: Where the public tokenizers' vocabularies lie; overridden by the parameter or the environment.
TOKENIZERS = os.environ.get("QUILLGRAPH_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the pattern by which the byte-level vocabulary splits a text before merging.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

BITS, LEVELS = 10, 6
BUCKETS = 1 << BITS
#: Targets up to this number are broadcast to the documents' tasks; more of them are joined as Spark sees fit.
FEW = 50_000


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(rows: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Adds ``tokens``: the size of the text in tokens of a public byte-level vocabulary; null and empty texts have 0.

    ``rows`` must not yet have a column of that name. Texts are sent to Python alone with the columns that are kept.
    """
    vocabulary = path or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
    keep = [c for c in rows.columns if c != text_col]
    schema = rows.select(*keep).schema.add("tokens", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(vocabulary)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    return rows.select(*keep, text_col).mapInArrow(run, schema)


class Mixture:
    """A corpus in which each source has its target share of the tokens, whole documents, no source repeated beyond its cap.

    * ``documents`` (doc_id, source, text) and ``targets`` (source, target_share, max_repeats); sources are compared after
      lower-casing, trimming and joining words by underscores. Null and blank sources and sources without a target take no
      part; targets without documents stay empty. Shares that are null or not positive count as 0, caps below 1 as 1.
      A source named twice in ``targets`` has the sum of its shares and the larger cap.
    * the total is ``total_tokens``, or all tokens that sources with a target have. A source's quota is its part of the total
      by share. Every document is taken ``quota // available`` times, and documents whose hash lies below a threshold once
      more, so that the quota is undercut by less than the next document in hash order. A quota beyond
      ``available * max_repeats`` gives just that; what is missing is reported, not given to other sources.
    * the threshold is found from histograms of tokens by source and hash bucket: the bucket in which the quota runs out is
      divided again, so only boundary buckets are read further and nothing is sorted. Documents of equal hash go together.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str | None = None, seed: int = 17):
        wanted = targets.select(
            normal_source(F.col("source")).alias("source"),
            F.when(F.col("target_share") > 0, F.col("target_share")).otherwise(0.0).alias("share"),
            F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("cap"),
        ).where(F.col("source").isNotNull() & ~F.isnan("share"))
        self.wanted = wanted.groupBy("source").agg(F.sum("share").alias("share"), F.max("cap").alias("cap"))
        few = self.wanted.limit(FEW + 1).count() <= FEW
        self._small = F.broadcast if few else lambda df: df
        docs = documents.select("doc_id", normal_source(F.col("source")).alias("source"), "text")
        part = docs.join(self._small(self.wanted.select("source")), "source", "left_semi")
        sized = count_tokens(part.select("doc_id", "source", "text"), path=tokenizer)
        #: (doc_id, source, tokens, h): h in [0, 2^60)
        self.sized = materialise(sized.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 4)))
        self._plan(total_tokens)

    def _plan(self, total_tokens: int | None) -> None:
        have = self.sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("documents"))
        full = self.wanted.join(have, "source", "left").fillna({"available": 0, "documents": 0})
        total = total_tokens if total_tokens is not None else (have.agg(F.sum("available").alias("t")).scalar())
        shares = self.wanted.agg(F.sum("share").alias("s")).scalar()
        quota = F.coalesce(F.floor(F.try_divide(F.col("share"), shares) * total), F.lit(0)).cast("bigint")
        capped = F.least(quota, F.col("available") * F.col("cap"))
        plan = full.select("*", quota.alias("quota"), capped.alias("goal")).withColumn(
            "whole", F.coalesce(F.floor(F.try_divide("goal", "available")), F.lit(0)).cast("int")
        )
        # one row for each source: the quota left for the partial copy, and the hash range in which it runs out
        self.plan = materialise(plan.withColumn("rest", F.col("goal") - F.col("whole") * F.col("available")))
        edge = self.plan.select("source", "rest", F.lit(0).cast("bigint").alias("floor"))
        rows = self.sized
        for level in range(LEVELS):
            shift = 60 - BITS * (level + 1)
            bucket = F.shiftright("h", shift).alias("bucket")
            inside = rows.join(self._small(edge), "source")
            if level:
                inside = inside.where(F.shiftright("h", shift + BITS) == F.shiftright("floor", shift + BITS))
            if level == 1:
                # from here on only the boundary buckets are read, one part in BUCKETS of each source
                rows = materialise(inside.select("source", "tokens", "h"))
                inside = rows.join(self._small(edge), "source")
            hist = inside.groupBy("source", bucket).agg(F.sum("tokens").alias("tokens"))
            upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            # the first bucket whose tokens no longer fit; where all fit, the one after the last
            cut = (
                hist.withColumn("sum", F.sum("tokens").over(upto))
                .join(self._small(edge), "source")
                .groupBy("source")
                .agg(
                    F.min(F.when(F.col("sum") > F.col("rest"), F.col("bucket"))).alias("over"),
                    F.max("bucket").alias("last"),
                    F.first("rest").alias("before"),
                    F.max(F.when(F.col("sum") <= F.col("rest"), F.col("sum"))).alias("taken"),
                )
            )
            edge = materialise(
                edge.join(cut.select("source", "over", "last", "taken"), "source", "left").select(
                    "source",
                    (F.col("rest") - F.coalesce("taken", F.lit(0))).alias("rest"),
                    F.coalesce(F.shiftleft(F.coalesce("over", F.col("last") + 1), shift), F.col("floor")).alias("floor"),
                )
            )
        self.edges = edge.select("source", F.col("floor").alias("threshold"))

    def copies(self) -> DataFrame:
        """(doc_id, source, tokens, copies) of the documents taken at least once."""
        rule = self._small(self.plan.select("source", "whole").join(self.edges, "source"))
        return (
            self.sized.join(rule, "source")
            .withColumn("copies", F.col("whole") + (F.col("h") < F.col("threshold")).cast("int"))
            .where("copies > 0")
            .select("doc_id", "source", "tokens", "copies")
        )

    def report(self) -> DataFrame:
        """(source, target_share, max_repeats, documents, available, quota, tokens, share, short) for every target."""
        taken = self.copies().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
        rows = self.plan.join(taken, "source", "left").fillna({"tokens": 0})
        total = taken.agg(F.sum("tokens").alias("t")).scalar()
        return rows.select(
            "source", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), "documents", "available", "quota", "tokens",
            F.round(F.coalesce(F.try_divide("tokens", total), F.lit(0.0)), 6).alias("share"),
            (F.col("goal") < F.col("quota")).alias("short"),
        )
