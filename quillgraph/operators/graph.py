"""Iterative graph operators: every round is a join, lineage is cut in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .tables import RANKED, SYMBOLS, order_key

RANK_EDGES = ("calls", "handles", "extends", "implements", "references")
IMPACT_EDGES = ("calls", "imports", "references")
FLOW_EDGES = ("calls", "handles")
ENTRY_FILE = r"(^|/)(index|main|app|server|cli|__main__|program)\.[A-Za-z]+$"
NEVER_DEAD = ("constructor", "__init__", "main")


#: Rounds of PageRank between two written stages.
STRIDE = 5


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 25) -> DataFrame:
    """(node_id, rank): weighted PageRank over symbols and routes, divided by the highest.

    A fixed number of rounds from a uniform start; an edge weighs its confidence (0.1 where that isn't positive) over the
    weights leaving its node; nodes without leaving edges spread their rank evenly. The links are partitioned once by where they
    begin and kept so (spilling to disk), the ranks of a round come partitioned the same way out of their aggregation, so a round
    shuffles contributions alone, added up before they move; a node with many incoming edges is no hot task. Every ``STRIDE``
    rounds are written as a stage, which cuts the lineage that a lost executor would have to go through again.
    """
    ids = nodes.where(F.col("kind").isin(*RANKED)).select("id").distinct()
    ids = materialise(ids)
    n = ids.count()
    if not n:
        return ids.select(F.col("id").alias("node_id"), F.lit(0.0).alias("rank"))
    weight = F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(0.1)
    kept = (
        edges.where(F.col("kind").isin(*RANK_EDGES))
        .select("from_id", "to_id", weight.alias("w"))
        .join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
        .join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    )
    kept = kept.groupBy("from_id", "to_id").agg(F.sum("w").alias("w"))
    out = kept.groupBy("from_id").agg(F.sum("w").alias("out"))
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stage = materialise(kept.join(out, "from_id").select("from_id", "to_id", (F.col("w") / F.col("out")).alias("part")))
    links = stage.repartition(parts, "from_id").persist()
    # Spreading the sinks' rank evenly adds a multiple of the all-ones vector each round, so the rank is a combination of
    # y_k = (damping * links)^k applied to ones. The y_k need no global sum on the way: one join and one aggregation each.
    sinks = ids.join(stage.select(F.col("from_id").alias("id")), "id", "left_anti")
    y = ids.select("id", F.lit(1.0).alias("y"))
    terms = y.withColumn("k", F.lit(0))
    k = 0
    while k < rounds:
        block, kept_rounds = None, []
        for k in range(k + 1, min(k + STRIDE, rounds) + 1):
            y = links.join(y.hint("merge"), links["from_id"] == y["id"]).groupBy("to_id").agg((F.sum(F.col("y") * F.col("part")) * damping).alias("y")).withColumnRenamed("to_id", "id").persist()
            kept_rounds.append(y)
            one = y.withColumn("k", F.lit(k))
            block = one if block is None else block.unionByName(one)
        block = materialise(block)
        for done in kept_rounds:
            done.unpersist()
        y = block.where(F.col("k") == k).select("id", "y")
        terms = terms.unionByName(block)
    links.unpersist()
    held = {r["k"]: r["s"] for r in terms.join(sinks, "id", "left_semi").groupBy("k").agg(F.sum("y").alias("s")).collect()}
    factors = [1.0 / n]
    for _ in range(rounds):
        lost = sum(f * held.get(k, 0.0) for k, f in enumerate(factors))
        factors = [(1 - damping + damping * lost) / n, *factors]
    weight = F.element_at(F.array(*map(F.lit, factors)), F.col("k") + 1)
    ranks = materialise(terms.groupBy("id").agg(F.sum(F.col("y") * weight).alias("rank")))
    top = ranks.agg(F.max("rank").alias("m")).collect()[0]["m"]
    return ranks.select(F.col("id").alias("node_id"), (F.col("rank") / F.lit(top or 1.0)).alias("rank"))


def repo_map(nodes: DataFrame, ranks: DataFrame, limit: int = 25) -> DataFrame:
    """The ``limit`` symbols of highest rank (0 where there is none), ties by path, line and id."""
    scored = nodes.where(F.col("kind").isin(*SYMBOLS)).join(ranks.withColumnRenamed("node_id", "id"), "id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    return scored.orderBy(F.round("rank", 9).desc(), "file_path", "start_line", "id").limit(limit).select("id", "kind", "name", "file_path", "start_line", "rank")


def resolve_symbol(nodes: DataFrame, symbol: str) -> str | None:
    """The id ``symbol`` is, or that of the first node of that name."""
    hit = nodes.where((F.col("id") == symbol) | (F.col("name") == symbol))
    row = hit.orderBy((F.col("id") != symbol).cast("int"), "file_path", "start_line", "id").select("id").head()
    return row["id"] if row else None


def neighborhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 1, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within ``depth`` steps of ``seeds`` (id).

    Edges are those at expanded nodes only, so two nodes of the last ring may be joined by an edge that isn't listed; edges
    to ids without a node are listed, the ids are not. Unknown seeds give nothing.
    """
    frontier = seeds.select("id").join(nodes.select("id"), "id", "left_semi").distinct()
    seen, used = frontier, edges.limit(0)
    for _ in range(depth):
        parts = []
        if direction in ("out", "both"):
            parts.append(edges.join(frontier.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(*edges.columns, F.col("to_id").alias("_next")))
        if direction in ("in", "both"):
            parts.append(edges.join(frontier.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*edges.columns, F.col("from_id").alias("_next")))
        step = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        step = materialise(step)
        used = used.unionByName(step.drop("_next"))
        frontier = materialise(step.select(F.col("_next").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi").join(seen, "id", "left_anti"))
        seen = seen.unionByName(frontier)
    return nodes.join(seen, "id", "left_semi"), used.dropDuplicates(["id"])


def impact(nodes: DataFrame, edges: DataFrame, name: str, depth: int = 4) -> DataFrame:
    """(id, depth): everything from which a node called ``name`` is reached in 1 to ``depth`` steps, with the fewest."""
    frontier = nodes.where(F.col("name") == name).select("id")
    kept = edges.where(F.col("kind").isin(*IMPACT_EDGES)).select("from_id", "to_id")
    known = nodes.select("id")
    found = None
    for d in range(1, depth + 1):
        step = kept.join(frontier.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct()
        step = step.join(known, "id", "left_semi")
        if found is not None:
            step = step.join(found, "id", "left_anti")
        step = materialise(step.withColumn("depth", F.lit(d)))
        found = step if found is None else found.unionByName(step)
        frontier = step.select("id")
    return found


def trace_flow(nodes: DataFrame, edges: DataFrame, name: str, max_depth: int = 6, most: int = 200_000) -> list[dict]:
    """The steps a call flow takes from the first function, method or route called ``name``, depth first.

    Joins bring together what lies within reach; the walk itself, whose order is the result, runs on the driver over that
    remainder, refused where it has more than ``most`` edges. Every edge is a step, a node is expanded once, and a node first
    met below ``max_depth`` isn't.
    """
    start = nodes.where((F.col("name") == name) & F.col("kind").isin("function", "method", "route")).orderBy("file_path", "start_line", "id").head()
    if start is None:
        return []
    flow = edges.where(F.col("kind").isin(*FLOW_EDGES))
    seed = nodes.where(F.col("id") == start["id"]).select("id")
    _, reach = neighborhood(nodes, flow, seed, depth=max_depth + 1, direction="out")
    steps: dict[str, list] = {}
    named = reach.join(nodes.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"), order_key().alias("ord")), "to_id")
    rows = named.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges within {max_depth} steps of {name}: ask for a smaller depth")
    for r in rows:
        steps.setdefault(r["from_id"], []).append(r)
    for rows in steps.values():
        rows.sort(key=lambda r: (-r["confidence"], tuple(r["ord"])))
    names = {start["id"]: start["name"]} | {r["to_id"]: r["to_name"] for rows in steps.values() for r in rows}
    out: list[dict] = []
    seen: set[str] = set()
    stack = [(start["id"], 0, None)]
    while stack:
        node, depth, edge = stack.pop()
        if edge is not None:
            out.append({"step": len(out) + 1, "from": names[edge["from_id"]], "to": names[node], "kind": edge["kind"], "confidence": edge["confidence"], "depth": depth})
        if node in seen or depth > max_depth:
            continue
        seen.add(node)
        stack += [(r["to_id"], depth + 1, r) for r in reversed(steps.get(node, []))]
    return out


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and methods nothing refers to: no incoming call, handle or reference, not in an entry file.

    Reachability need not be followed: whatever a walk from the roots reaches has an incoming call.
    """
    used = edges.where(F.col("kind").isin("calls", "handles", "references")).select(F.col("to_id").alias("id"))
    return (
        nodes.where(F.col("kind").isin("function", "method") & ~F.col("name").isin(*NEVER_DEAD) & ~F.col("file_path").rlike(ENTRY_FILE))
        .join(used, "id", "left_anti")
        .select("id", "kind", "name", "file_path", "start_line")
    )


def routes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(route, file_path, handler, confidence): each route with its first handler, confidence 0 where there is none."""
    target = nodes.select(F.col("id").alias("to_id"), F.col("name").alias("handler"), order_key().alias("ord"))
    handled = edges.where("kind = 'handles'").join(target, "to_id").groupBy(F.col("from_id").alias("id")).agg(F.min(F.struct("ord", "handler", "confidence")).alias("h"))
    return (
        nodes.where("kind = 'route'").join(handled, "id", "left")
        .select("id", F.col("name").alias("route"), "file_path", F.col("h.handler").alias("handler"), F.coalesce("h.confidence", F.lit(0.0)).alias("confidence"))
    )


def export_graph(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, focus: str | None = None, limit: int = 300) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) to draw: two steps around ``focus``, or the symbols, the ``limit`` of highest rank where there are more."""
    if focus is not None:
        hit = resolve_symbol(nodes, focus)
        shown, _ = neighborhood(nodes, edges, nodes.where(F.col("id") == hit).select("id"), depth=2)
    else:
        shown = nodes.where(F.col("kind").isin(*RANKED))
        shown = shown.join(ranks.select(F.col("node_id").alias("id"), "rank"), "id", "left").orderBy(F.coalesce("rank", F.lit(0.0)).desc(), "file_path", "start_line", "id").limit(limit)
    shown = materialise(shown.select("id", "kind", "name", "parent", "file_path", "start_line"))
    ids = shown.select("id")
    between = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    label = F.when(F.col("parent").isNull(), F.col("name")).otherwise(F.concat_ws(".", "parent", "name"))
    return (
        shown.select("id", label.alias("label"), F.col("kind").alias("group"), F.concat("kind", F.lit(" "), label, F.lit("\n"), "file_path", F.lit(":"), "start_line").alias("title")),
        between.select(F.col("from_id").alias("from"), F.col("to_id").alias("to"), F.col("kind").alias("label"), "confidence"),
    )


def quality(found: DataFrame, truth: DataFrame, nodes: DataFrame) -> DataFrame:
    """(language, expected, found, matched, recall, precision, mean_confidence) of resolved edges (from_id, to_id, confidence) against
    known ones (from_id, to_id), by the language of the node they begin at; a rate over nothing is null."""
    got, want = F.col("confidence").isNotNull(), F.coalesce("wanted", F.lit(False))
    both = found.select("from_id", "to_id", "confidence").join(truth.select("from_id", "to_id").withColumn("wanted", F.lit(True)), ["from_id", "to_id"], "full_outer")
    part = lambda a, b: F.round(F.try_divide(a, b), 6)
    n, m, k = F.count_if(want), F.count_if(got), F.count_if(want & got)
    return (
        both.join(nodes.select(F.col("id").alias("from_id"), "language"), "from_id")
        .groupBy("language")
        .agg(n.alias("expected"), m.alias("found"), k.alias("matched"), part(k, n).alias("recall"), part(k, m).alias("precision"), F.round(F.avg(F.when(want & got, F.col("confidence"))), 6).alias("mean_confidence"))
    )
