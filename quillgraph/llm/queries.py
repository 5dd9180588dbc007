"""The registered queries on training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import table
from . import abuse, fusion, leaks, mixing, provenance, syntax
from .spans import SharedSpans
from .vectors import VectorIndex

registry = Registry()

_WINDOWS_SQL = """
snips AS (SELECT DISTINCT id, snippet FROM nodes WHERE id IS NOT NULL AND length(snippet) >= 120),
wins AS (SELECT DISTINCT id, substr(snippet, CAST(i AS INT), 120) AS w
  FROM (SELECT id, snippet, unnest(range(1, length(snippet) - 118)) AS i FROM snips))
"""


@registry.add(
    "p1_found",
    f"""WITH {_WINDOWS_SQL}, h AS (SELECT id, md5(w) AS w FROM wins)
    SELECT DISTINCT a.id AS node_id_a, b.id AS node_id_b FROM h a JOIN h b ON a.w = b.w AND a.id < b.id""",
)
def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return SharedSpans(table(spark, root, "nodes")).pairs()


@registry.add(
    "p1_shared_parts",
    """WITH t AS (SELECT DISTINCT id, snippet, md5(snippet) AS cls FROM nodes WHERE id IS NOT NULL AND snippet IS NOT NULL),
    texts AS (SELECT DISTINCT cls, snippet FROM t WHERE length(snippet) >= 120),
    wins AS (SELECT cls, i, md5(substr(snippet, CAST(i AS INT), 120)) AS w FROM (SELECT cls, snippet, unnest(range(1, length(snippet) - 118)) AS i FROM texts)),
    met AS (SELECT w FROM wins GROUP BY w HAVING count(DISTINCT cls) > 1),
    cover AS (SELECT cls, sum(least(120, step)) AS covered FROM (SELECT cls, i - coalesce(lag(i) OVER (PARTITION BY cls ORDER BY i), i - 120) AS step FROM wins WHERE w IN (SELECT w FROM met)) GROUP BY cls),
    copies AS (SELECT cls, count(DISTINCT id) AS n FROM t WHERE length(snippet) >= 120 GROUP BY cls),
    one AS (SELECT id, arg_max(cls, row(length(snippet), cls)) AS cls, max(length(snippet)) AS n_chars FROM t GROUP BY id)
    SELECT id, n_chars, CAST(CASE WHEN n > 1 THEN n_chars ELSE coalesce(covered, 0) END AS INT) AS shared_chars, round((CASE WHEN n > 1 THEN n_chars ELSE coalesce(covered, 0) END) / nullif(n_chars, 0), 6) AS shared_part, cls AS class_id
    FROM one LEFT JOIN cover USING (cls) LEFT JOIN copies USING (cls)""",
)
def p1_shared_parts(spark: SparkSession, root: str) -> DataFrame:
    return SharedSpans(table(spark, root, "nodes")).per_record()


@registry.add(
    "p5_found",
    """WITH u AS (SELECT node_id, dim, CAST(vec AS DOUBLE[]) AS v FROM node_vectors
      WHERE vec IS NOT NULL AND len(vec) = dim AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(vec, lambda x: x <> 0)) > 0)
    SELECT DISTINCT a.node_id AS node_id_a, b.node_id AS node_id_b FROM u a JOIN u b ON a.dim = b.dim AND a.node_id < b.node_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.9""",
)
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return VectorIndex(table(spark, root, "node_vectors")).pairs(0.9).select("node_id_a", "node_id_b")


@registry.add("p5_neighbours")
def p5_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The ten nearest of every fiftieth vector (by the hash of its id, since the ids are strings), against all."""
    index = VectorIndex(table(spark, root, "node_vectors"))
    asked = index.coded.where(F.pmod(F.xxhash64("node_id"), F.lit(50)) == 0)
    return index.neighbours(asked, k=10)


def _abuse(spark: SparkSession, root: str) -> DataFrame:
    return abuse.score_documents(table(spark, root, "documents"))


@registry.add("p10_found")
def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return _abuse(spark, root).where(F.col("score") >= abuse.MARK).select("doc_id").distinct()


@registry.add("p10_scores")
def p10_scores(spark: SparkSession, root: str) -> DataFrame:
    return _abuse(spark, root)


@registry.add("p10_rates")
def p10_rates(spark: SparkSession, root: str) -> DataFrame:
    return abuse.rates(_abuse(spark, root))


@registry.add("p8_method")
def p8_method(spark: SparkSession, root: str) -> DataFrame:
    return leaks.LatentLeaks(table(spark, root, "documents"), table(spark, root, "eval_items")).leaks()


@registry.add(
    "p8_found",
    """WITH t AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents
      UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[a-z0-9]+') FROM eval_items),
    r AS (SELECT DISTINCT side, id, array_to_string(w[i : i + 11], ' ') AS run
      FROM (SELECT side, id, w, unnest(range(1, len(w) - 10)) AS i FROM t WHERE len(w) >= 12))
    SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM r d JOIN r i ON d.side = 'd' AND i.side = 'i' AND d.run = i.run""",
)
def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return leaks.verbatim_leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


_BORDA = {"rank": 1.0, "confidence": 1.0, "in_degree": 1.0}


@registry.add(
    "p7_ranking",
    r"""WITH n AS (SELECT DISTINCT id AS node_id FROM nodes WHERE id IS NOT NULL),
    newest AS (SELECT node_id, max(computed_at) AS at_most FROM ranks GROUP BY node_id),
    rr AS (SELECT x.node_id, max(CASE WHEN isnan(x.rank) THEN NULL ELSE x.rank END) AS rank FROM ranks x JOIN newest m ON x.node_id = m.node_id
      AND x.computed_at = m.at_most GROUP BY x.node_id),
    e AS (SELECT lower(regexp_replace(to_id, '^\s+|\s+$', '', 'g')) AS node_id, id,
      max(CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END) AS confidence FROM edges GROUP BY ALL),
    i AS (SELECT node_id, avg(confidence) AS confidence, count(*) AS in_degree FROM e WHERE node_id <> '' GROUP BY node_id),
    s AS (SELECT n.node_id, rr.rank, round(i.confidence, 9) AS confidence, CAST(coalesce(i.in_degree, 0) AS DOUBLE) AS in_degree
      FROM n LEFT JOIN rr USING (node_id) LEFT JOIN i USING (node_id)),
    p AS (SELECT *,
      CASE WHEN rank IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY rank IS NULL ORDER BY rank) + (count(*) OVER (PARTITION BY rank) - 1) / 2.0 - 0.5) / count(rank) OVER () END AS p1,
      CASE WHEN confidence IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY confidence IS NULL ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2.0 - 0.5) / count(confidence) OVER () END AS p2,
      (rank() OVER (ORDER BY in_degree) + (count(*) OVER (PARTITION BY in_degree) - 1) / 2.0 - 0.5) / count(*) OVER () AS p3 FROM s)
    SELECT node_id, rank, confidence, in_degree, round((p1 + p2 + p3) / 3, 9) AS points,
      row_number() OVER (ORDER BY round((p1 + p2 + p3) / 3, 12) DESC, node_id) AS place FROM p""".replace("GROUP BY ALL", "GROUP BY 1, 2"),
)
def p7_ranking(spark: SparkSession, root: str) -> DataFrame:
    scores = fusion.node_scores(table(spark, root, "nodes"), table(spark, root, "ranks"), table(spark, root, "edges"))
    return fusion.borda(scores, _BORDA)


def _mixture(spark: SparkSession, root: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, root, "documents"), table(spark, root, "mix_targets"))


@registry.add("p9_corpus")
def p9_corpus(spark: SparkSession, root: str) -> DataFrame:
    return _mixture(spark, root).copies()


@registry.add("p9_shares")
def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return _mixture(spark, root).report()


def _not_by_hand(spark: SparkSession, root: str) -> DataFrame:
    return provenance.classify_files(table(spark, root, "files"), table(spark, root, "source_texts"), table(spark, root, "third_party"))


@registry.add("p2_method")
def p2_method(spark: SparkSession, root: str) -> DataFrame:
    """What the named method finds by itself: notices in comments, places and names."""
    return provenance.noticed_files(table(spark, root, "files"), table(spark, root, "source_texts"))


@registry.add("p2_found")
def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _not_by_hand(spark, root).select("path").distinct()


@registry.add("p2_reasons")
def p2_reasons(spark: SparkSession, root: str) -> DataFrame:
    return _not_by_hand(spark, root)


def _checked(spark: SparkSession, root: str) -> DataFrame:
    return syntax.check_files(table(spark, root, "files"), table(spark, root, "source_texts"))


@registry.add("p3_found")
def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _checked(spark, root).where("NOT valid").select("path").distinct()


@registry.add("p3_failures")
def p3_failures(spark: SparkSession, root: str) -> DataFrame:
    return _checked(spark, root).where("NOT valid")


@registry.add("p3_rates")
def p3_rates(spark: SparkSession, root: str) -> DataFrame:
    return syntax.rates(_checked(spark, root))
