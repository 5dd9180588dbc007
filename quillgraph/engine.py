"""The engine: index a source tree, keep it up to date, and answer structural and retrieval questions."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import providers
from .functions.text import embedding_text
from .operators import changes, extract, graph, render, resolve, search, tables
from .session import materialise
from .sources import scan
from .sources.state import BUCKETS, Store, bucket_of
from .streaming import changelog


class Engine:
    def __init__(self, spark: SparkSession, root: str, **overrides):
        self.spark, self.cfg = spark, config.resolve(root, **overrides)
        self.store = Store(spark, self.cfg.state)
        self.provider = providers.choose(self.cfg.embeddings, self.cfg.embedding_dim)
        self._ranked, self.affected, self._streams = time.time(), 0, []

    # indexing ------------------------------------------------------------------------------------------------------

    def index(self) -> dict:
        """Scan, parse what changed, link and resolve, rank, embed what has no vector; the counts of each."""
        began = time.time()
        scanned = materialise(scan.scan_files(self.spark, self.cfg.root, list(self.cfg.exclude), self.cfg.max_file_bytes))
        new = scan.snapshot(scanned)
        diff = materialise(changes.snapshot_diff(self.store.read("files"), new))
        stats = changes.diff_stats(diff, scanned.count()).head().asDict()
        if stats["added"] or stats["changed"] or stats["removed"]:
            touched = diff.where("op <> 'removed'").select("path")
            stats["embedded"] = self._apply(scan.readable(scanned.join(touched, "path", "left_semi")).select("path", "text"), diff.select("path"), new)
        self.store.set_meta(lastIndex=datetime.now(timezone.utc).isoformat(), merkleRoot=changes.merkle_root(new), embedSignature=self.provider.signature)
        return stats | {"duration_s": round(time.time() - began, 3), "root": self.cfg.root}

    def _apply(self, texts: DataFrame, touched: DataFrame, files: DataFrame, rank: bool = True) -> int:
        """Replace the graph of ``touched`` (path) by that of ``texts`` (path, text); returns how many nodes were embedded.

        Only the touched files are parsed, only files that they affect are resolved anew, and only the buckets of these files are
        written; vectors and the links of assets, which are few, are written whole. Without ``rank`` the ranks are left as
        they are and marked as outdated; the next question that needs them computes them.
        """
        store = self.store
        touched = materialise(touched.distinct())
        hit = store.buckets(touched)
        others = set(range(BUCKETS)) - hit
        before = extract.with_parent(store.read("nodes"))
        parsed = extract.parse_files(texts)
        new_nodes = materialise(tables.replace_files(store.read("nodes", hit), parsed["nodes"], touched))
        new_sites = materialise(tables.replace_files(store.read("call_sites", hit), parsed["call_sites"], touched))
        nodes, sites = store.read("nodes", others).unionByName(new_nodes), store.read("call_sites", others).unionByName(new_sites)
        known = extract.with_parent(nodes)
        affected = materialise(resolve.affected_files(touched, before, known, sites))
        self.affected = affected.count()
        wide = store.buckets(affected)
        edges = tables.replace_files(store.read("edges", wide), parsed["edges"], touched)
        edges = materialise(resolve.resolve_incremental(edges, affected, known, sites, files))
        assets = nodes.where("kind = 'asset' AND snippet IS NOT NULL").select("id", "file_path", F.col("snippet").alias("text"))
        documents = materialise(resolve.link_assets(assets, nodes))
        vectors, embedded = self._embed(nodes)
        in_hit = files.where(bucket_of(F.col("path")).isin(*hit)) if hit else files.limit(0)
        store.write({"nodes": hit, "call_sites": hit, "files": hit, "edges": wide}, nodes=new_nodes, call_sites=new_sites, files=materialise(in_hit), edges=edges, documents=documents, embeddings=vectors)
        store.set_meta(ranksOutdated=True)
        if rank:
            self._rank()
        return embedded

    def _rank(self) -> None:
        self.store.write(ranks=graph.pagerank(self.nodes(), self.edges()))
        self.store.set_meta(ranksOutdated=False)
        self._ranked = time.time()

    def _embed(self, nodes: DataFrame) -> tuple[DataFrame, int]:
        """Vectors by node and text: a node whose text changed, or whose vector another provider made, is embedded again."""
        text = embedding_text(F.col("name"), F.col("signature"), F.col("snippet"))
        wanted = nodes.where("kind <> 'import'").select(F.col("id").alias("node_id"), text.alias("text"), F.sha1(text).alias("text_hash"))
        have = self.store.read("embeddings").where(F.col("signature") == self.provider.signature).join(wanted, ["node_id", "text_hash"], "left_semi")
        pending = wanted.join(have, "node_id", "left_anti")
        fresh = pending.select("node_id", F.lit(self.provider.dim).alias("dim"), self.provider.embed(F.col("text")).alias("vec"), "text_hash", F.lit(self.provider.signature).alias("signature"))
        fresh = materialise(fresh)
        return have.select(*fresh.columns).unionByName(fresh), fresh.count()

    def follow(self, log_folder: str, on_batch=None, trigger: dict | None = None, rank_every: float = 1.5):
        """Apply a change log as a stream; see ``streaming.changelog``. Oversized contents are passed over.

        Ranks are global, so they are computed at most once in ``rank_every`` seconds, and else when they are asked for.
        """

        def apply(upserts: DataFrame, removes: DataFrame) -> None:
            small = upserts.where(F.octet_length("content") <= self.cfg.max_file_bytes)
            before = self.store.read("files")
            path = F.col("path")
            new = small.select("path", F.sha1("content").alias("hash"), F.octet_length("content").cast("bigint").alias("size"), F.lit(None).cast("double").alias("mtime_ms"), scan.detect_language(path).alias("language"))
            new = new.join(before.select("path", "hash"), ["path", "hash"], "left_anti")
            touched = materialise(new.select("path").union(removes.join(before, "path", "left_semi").select("path")))
            if touched.isEmpty():
                return
            files = materialise(before.join(touched, "path", "left_anti").unionByName(new.select(*before.columns)))
            self._apply(small.join(touched, "path", "left_semi").select("path", F.col("content").alias("text")), touched, files, rank=time.time() - self._ranked >= rank_every)

        stream = changelog.apply_log(changelog.read_log(self.spark, log_folder), apply, f"{self.cfg.state}/stream", on_batch, trigger)
        self._streams.append(stream)
        return stream

    def stop_watch(self) -> None:
        """Stop following; what a batch has not finished is done again by the next ``follow``."""
        for stream in self._streams:
            stream.stop()
        self._streams = []

    def close(self) -> None:
        """Stop following and bring the ranks up to date. The session stays the caller's."""
        self.stop_watch()
        if self.store.meta().get("ranksOutdated"):
            self._rank()

    # questions -----------------------------------------------------------------------------------------------------

    def nodes(self) -> DataFrame:
        return extract.with_parent(self.store.read("nodes"))

    def edges(self) -> DataFrame:
        return self.store.read("edges").unionByName(self.store.read("documents"))

    def ranks(self) -> DataFrame:
        """The ranks of the nodes there are, computed now if the graph has changed since."""
        if self.store.meta().get("ranksOutdated"):
            self._rank()
        return self.store.read("ranks").join(self.store.read("nodes").select(F.col("id").alias("node_id")), "node_id", "left_semi")

    def find(self, query: str, limit: int = 12) -> DataFrame:
        """(node columns, score, bm25, vector, graph) of the best hits."""
        nodes = self.nodes()
        pool = max(4 * limit, 40)
        lexical = search.bm25(nodes, "id", F.concat_ws(" ", "name", "signature", "snippet"), query, pool, stemmed=True)
        asked = self.spark.createDataFrame([(query,)], "q string").select(self.provider.embed(F.col("q")).alias("v")).head()["v"]
        vector = search.vector_topk(self.store.read("embeddings"), "node_id", "vec", asked, pool)
        return nodes.join(search.hybrid(lexical, vector, nodes, self.edges(), self.ranks(), limit), "id").orderBy(F.desc("score"), "id")

    def context(self, query: str, budget: int | None = None, fmt: str = "markdown", limit: int = 16) -> DataFrame:
        return search.pack_context(self.find(query, limit), query, budget or self.cfg.token_budget, xml=fmt == "xml")

    def important_symbols(self, limit: int = 25) -> DataFrame:
        return graph.repo_map(self.nodes(), self.ranks(), limit)

    def dead_code(self) -> DataFrame:
        return graph.dead_code(self.nodes(), self.edges()).orderBy("file_path", "start_line", "id")

    def trace_flow(self, name: str, max_depth: int = 6) -> list[dict]:
        return graph.trace_flow(self.nodes(), self.edges(), name, max_depth)

    def impact(self, name: str, max_depth: int = 4) -> DataFrame:
        return self.nodes().join(graph.impact(self.nodes(), self.edges(), name, max_depth), "id")

    def routes(self) -> DataFrame:
        return graph.routes(self.nodes(), self.edges()).orderBy("route", "id")

    def neighborhood(self, symbol: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
        nodes = self.nodes()
        hit = graph.resolve_symbol(nodes, symbol)
        return graph.neighborhood(nodes, self.edges(), nodes.where(F.col("id") == hit).select("id"), depth)

    def graph_data(self, focus: str | None = None, limit: int = 300) -> tuple[DataFrame, DataFrame]:
        return graph.export_graph(self.nodes(), self.edges(), self.ranks(), focus, limit)

    def render_graph(self, fmt: str = "html", focus: str | None = None, limit: int = 300) -> str:
        nodes, edges = self.graph_data(focus, limit)
        if fmt == "json":
            return render.to_json(nodes, edges)
        return render.to_dot(nodes, edges) if fmt == "dot" else render.to_html(nodes, edges, inline=self.cfg.viewer == "inline")

    def stats(self) -> dict:
        counts = tables.table_counts(self.store.read("files"), self.store.read("nodes"), self.edges(), self.store.read("embeddings"))
        meta = self.store.meta()
        return {r["table_name"]: r["n_rows"] for r in counts.collect()} | {k: meta.get(k) for k in ("lastIndex", "merkleRoot", "embedSignature")}

    def metrics(self) -> dict:
        return self.stats() | tables.edge_quality(self.edges()).head().asDict()
