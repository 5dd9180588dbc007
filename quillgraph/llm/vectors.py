"""Most similar vectors by additive quantisation.

A vector is approximated by the sum of one codeword from each of several full-dimensional codebooks, fitted one after
the other on what the earlier ones leave (residuals) and encoded by beam search. The codewords of the first codebook, or of
the first few, also divide the collection into cells. A query visits the cells whose sums of codewords are nearest, scores the
codes there through lookup tables of its products with all codewords, keeps what the stored norms leave possible, and reranks
that exactly.

The number of cells follows the number of rows (``cell_rows`` in each), so a query meets as many rows in a large collection as
in a small one: the first codebook grows up to ``cells_max`` words, then the codewords of further ones divide its cells.
Codebooks are fitted on a bounded sample (``train_rows`` for each dimension, the smallest hashes of the ids); every row
is encoded and indexed. Cells larger than ``block`` rows are divided, so that no task holds an unbounded cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import materialise


@dataclass(frozen=True)
class AqConfig:
    train_rows: int = 20_000
    cell_rows: int = 512
    cells_max: int = 2_048
    books: int = 4
    words: int = 128
    beam: int = 4
    probes: int = 6
    widen: int = 5
    block: int = 4_096
    iterations: int = 6


def _kmeans(x: np.ndarray, k: int, iterations: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(iterations):
        near = _nearest(x, centres, 1)[:, 0]
        size = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        cuts = np.searchsorted(near[order], np.flatnonzero(size))
        centres[size > 0] = np.add.reduceat(x[order], cuts, axis=0) / size[size > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Indices of the ``n`` nearest centres of each row, nearest first."""
    n = min(n, len(centres))
    out = np.empty((len(x), n), dtype=np.int64)
    half = (centres**2).sum(1) / 2
    for i in range(0, len(x), 4096):
        d = half - x[i : i + 4096] @ centres.T
        near = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(n), (len(d), 1))
        out[i : i + 4096] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
    return out


def book_sizes(total: int, sample: int, cfg: AqConfig) -> tuple[list[int], int]:
    """(words of each codebook, how many of them divide the cells) for ``total`` rows: the first get what the cells need, with
    more than ``cfg.books`` codebooks only where the cells need them."""
    most = max(1, sample // 4)
    wanted = max(1, math.ceil(total / cfg.cell_rows))
    sizes = [min(cfg.cells_max, wanted, most)]
    while math.prod(sizes) < wanted and most > 1:
        sizes.append(min(cfg.words, most, math.ceil(wanted / math.prod(sizes))))
    depth = len(sizes)
    return sizes + [min(cfg.words, most)] * (cfg.books - depth), depth


def fit_books(sample: np.ndarray, total: int, cfg: AqConfig) -> tuple[list[np.ndarray], int]:
    """The codebooks of one dimension, and how many of them divide the cells."""
    rng = np.random.default_rng(7)
    books, rest = [], sample.astype(np.float32)
    sizes, depth = book_sizes(total, len(sample), cfg)
    for k in sizes:
        book = _kmeans(rest, k, cfg.iterations, rng)
        rest = rest - book[_nearest(rest, book, 1)[:, 0]]
        books.append(book)
    return books, depth


def nearest_cells(x: np.ndarray, books: list[np.ndarray], depth: int, n: int, widen: int) -> np.ndarray:
    """Numbers of the ``n`` cells nearest to each row, nearest first, ``n * widen`` where further codebooks divide them; found by a
    beam over the codebooks. """
    cells = _nearest(x, books[0], n * 2 if depth > 1 else n)
    if depth == 1:
        return cells
    out = []
    for i in range(0, len(x), 1024):
        part, cell = x[i : i + 1024], cells[i : i + 1024]
        rest = part[:, None, :] - books[0][cell]
        for book in books[1:depth]:
            width = rest.shape[1]
            far = ((rest**2).sum(2)[:, :, None] + (book**2).sum(1) - 2 * (rest.reshape(-1, x.shape[1]) @ book.T).reshape(len(part), width, -1)).reshape(len(part), -1)
            keep = min(n * widen, far.shape[1])
            best = np.argpartition(far, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(far, best, 1), axis=1, kind="stable"), 1)
            where, word = np.divmod(best, len(book))
            rest = np.take_along_axis(rest, where[:, :, None], 1) - book[word]
            cell = np.take_along_axis(cell, where, 1) * len(book) + word
        out.append(cell)
    return np.concatenate(out) if out else np.zeros((0, n), dtype=np.int64)


def cells_of(codes: np.ndarray, books: list[np.ndarray], depth: int) -> np.ndarray:
    cell = codes[:, 0].astype(np.int64)
    for m in range(1, depth):
        cell = cell * len(books[m]) + codes[:, m]
    return cell


def encode(x: np.ndarray, books: list[np.ndarray], beam: int) -> np.ndarray:
    """Codes (rows x books) by beam search: at each codebook the ``beam`` best sums so far are kept."""
    out = np.empty((len(x), len(books)), dtype=np.int16)
    for i in range(0, len(x), 1024):
        part = x[i : i + 1024]
        n = len(part)
        rest, codes = part[:, None, :], np.empty((n, 1, 0), dtype=np.int16)
        for book in books:
            width = rest.shape[1]
            score = (book**2).sum(1) - 2 * (rest.reshape(-1, x.shape[1]) @ book.T)
            score = score.reshape(n, width, -1) + (rest**2).sum(2)[:, :, None]
            flat = score.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
            where, word = np.divmod(best, len(book))
            rest = np.take_along_axis(rest, where[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, where[:, :, None], 1), word[:, :, None].astype(np.int16)], 2)
        out[i : i + 1024] = codes[:, 0]
    return out


def _decode(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def usable_vectors(rows: DataFrame, id_col: str = "node_id", dim_col: str = "dim", vec_col: str = "vec") -> DataFrame:
    """(node_id, dim, vec) of rows that take part: vec of length dim, finite throughout, not zero throughout."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(
        F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) == F.col(dim_col)) & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    ).select(F.col(id_col).alias("node_id"), F.col(dim_col).cast("int").alias("dim"), v.cast("array<float>").alias("vec"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_CODED = "node_id string, dim int, cell bigint, codes binary, norm float, err float, vec binary, probes array<bigint>"


def _encoder(books_by_dim: dict[int, tuple[list[np.ndarray], int]], cfg: AqConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                unit = _unit(np.asarray(part.column(2).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)).astype(np.float32)
                books, depth = books_by_dim[int(dim)]
                codes = encode(unit, books, cfg.beam)
                approx = _decode(codes, books)
                probes = nearest_cells(unit, books, depth, cfg.probes, cfg.widen)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1).cast(pa.int32()), pa.array(cells_of(codes, books, depth)),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array((approx**2).sum(1).astype(np.float32)),
                        pa.array(np.linalg.norm(unit - approx, axis=1).astype(np.float32)),
                        pa.array([u.tobytes() for u in unit], pa.binary()),
                        pa.array(list(probes), pa.list_(pa.int64())),
                    ],
                    names=["node_id", "dim", "cell", "codes", "norm", "err", "vec", "probes"],
                )

    return run


class VectorIndex:
    """Nearest neighbours by cosine among vectors of equal dimension.

    Rows that cannot be used (see ``usable_vectors``) take no part; extra columns are ignored; equal vectors are
    neighbours of each other with cosine 1; an empty table gives an empty index.
    """

    def __init__(self, rows: DataFrame, cfg: AqConfig = AqConfig(), **cols: str):
        self.cfg = cfg
        spark = rows.sparkSession
        usable = usable_vectors(rows, **cols)
        # the sample: at most train_rows of each dimension, by the order of the ids' hashes
        sizes = {r["dim"]: r["n"] for r in usable.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
        sampled = []
        for dim, n in sizes.items():
            cut = min(1.0, 1.5 * cfg.train_rows / n)
            hashed = F.pmod(F.xxhash64("node_id"), F.lit(1 << 20))
            sampled += [usable.where((F.col("dim") == dim) & (hashed < int(cut * (1 << 20)) + 1)).orderBy(hashed, "node_id").limit(cfg.train_rows)]
        self.books: dict[int, tuple[list[np.ndarray], int]] = {}
        for dim, df in zip(sizes, sampled):
            vecs = df.select("vec").toArrow().column(0).combine_chunks()
            unit = _unit(np.asarray(vecs.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)) if len(vecs) else np.zeros((1, dim))
            self.books[dim] = fit_books(unit, sizes[dim], cfg)
        self.spark = spark
        self.coded = materialise(usable.mapInArrow(_encoder(self.books, cfg), _CODED))
        #: rows of each cell
        self.cells = self.coded.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("rows"))

    def _units(self, queries: DataFrame) -> DataFrame:
        """Index rows and queries side by side, keyed by (dim, cell, block, part); each query meets each block once."""
        cfg = self.cfg
        asked = queries.select("node_id", "dim", "vec", F.explode("probes").alias("cell"))
        load = asked.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("asked"))
        # cells that are met as one piece, which are most, need no row here; Spark broadcasts the others if they are few
        plan = (
            self.cells.join(load, ["dim", "cell"])
            .select(
                "dim", "cell",
                F.ceil(F.col("rows") / cfg.block).cast("int").alias("blocks"),
                F.ceil(F.col("asked") / (4 * cfg.block)).cast("int").alias("parts"),
            )
            .where("blocks > 1 OR parts > 1")
        )
        n = lambda c: F.coalesce(F.col(c), F.lit(1))
        spread = lambda c, salt: F.pmod(F.xxhash64("node_id", F.lit(salt)), n(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), n(c) - 1))
        no = F.lit(None)
        index = self.coded.join(plan, ["dim", "cell"], "left").select(
            "dim", "cell", spread("blocks", 1).alias("block"), every("parts").alias("part"), "node_id", "vec", "codes", "norm", "err"
        )
        ask = asked.join(plan, ["dim", "cell"], "left").select(
            "dim", "cell", every("blocks").alias("block"), spread("parts", 2).alias("part"), "node_id", "vec",
            no.cast("binary").alias("codes"), no.cast("float").alias("norm"), no.cast("float").alias("err"),
        )
        return index.unionByName(ask)

    def pairs(self, threshold: float) -> DataFrame:
        """(node_id_a, node_id_b, cosine) with cosine >= threshold, smaller id first.

        A pair is found when either vector's cell is among the cells the other one visits; within a cell nothing is lost,
        since the product with the approximation differs from the true one by no more than the stored error.
        """
        books = self.books

        def score(keys, t):
            return _score(t, books, threshold, None)

        found = self._units(self.coded).groupBy("dim", "cell", "block", "part").applyInArrow(
            score, "q string, x string, cosine double"
        )
        return (
            found.select(F.least("q", "x").alias("node_id_a"), F.greatest("q", "x").alias("node_id_b"), "cosine")
            .groupBy("node_id_a", "node_id_b")
            .agg(F.max("cosine").alias("cosine"))
        )

    def neighbours(self, queries: DataFrame, k: int, probes: int = 48) -> DataFrame:
        """(node_id, rank, neighbour_id, cosine): the k best of each query, which must be rows of ``coded``."""
        books = self.books

        def score(keys, t):
            return _score(t, books, None, k)

        wide = queries.mapInArrow(_prober(books, probes, self.cfg.widen), "node_id string, dim int, vec binary, probes array<bigint>")
        found = self._units(wide).groupBy("dim", "cell", "block", "part").applyInArrow(score, "q string, x string, cosine double")
        best = Window.partitionBy("q").orderBy(F.desc("cosine"), "x")
        return (
            found.withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k)
            .select(F.col("q").alias("node_id"), "rank", F.col("x").alias("neighbour_id"), "cosine")
        )


def _prober(books: dict[int, tuple[list[np.ndarray], int]], probes: int, widen: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(b.schema.get_field_index(n)) for n in ("node_id", "dim", "vec")}
            dims = cols["dim"].to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                own = pa.array(dims == dim)
                vec = cols["vec"].filter(own)
                near = nearest_cells(_matrix(vec, int(dim)), *books[int(dim)], probes, widen)
                yield pa.RecordBatch.from_arrays(
                    [cols["node_id"].filter(own), cols["dim"].filter(own), vec, pa.array(list(near), pa.list_(pa.int64()))],
                    names=["node_id", "dim", "vec", "probes"],
                )

    return run


def _score(t: pa.Table, books_by_dim: dict[int, tuple[list[np.ndarray], int]], threshold: float | None, k: int | None) -> pa.Table:
    """Lookup-table scores of one block of codes for its queries, what they leave possible, and the exact cosine of that."""
    dim = t.column("dim")[0].as_py()
    books, _ = books_by_dim[dim]
    asked = np.asarray(t.column("codes").is_null())
    index, ask = t.filter(pa.array(~asked)), t.filter(pa.array(asked))
    none = pa.table({"q": pa.array([], pa.string()), "x": pa.array([], pa.string()), "cosine": pa.array([], pa.float64())})
    if not len(index) or not len(ask):
        return none
    codes = np.frombuffer(b"".join(index.column("codes").to_pylist()), dtype=np.int16).reshape(-1, len(books))
    norm, err = (np.asarray(index.column(c)) for c in ("norm", "err"))
    x, q = _matrix(index.column("vec"), dim), _matrix(ask.column("vec"), dim)
    xid, qid = index.column("node_id").to_numpy(), ask.column("node_id").to_numpy()
    out = []
    step = max(1, 4_000_000 // len(x))
    for i in range(0, len(q), step):
        part = q[i : i + step]
        score = np.zeros((len(part), len(x)), dtype=np.float32)
        for m, book in enumerate(books):
            used, at = np.unique(codes[:, m], return_inverse=True)
            score += np.take(part @ book[used].T, at, axis=1)
        if threshold is not None:
            left = score >= (threshold - 1e-4) - err
            # where much is left, its products are taken as one matrix; only what comes near the threshold is listed
            if np.count_nonzero(left) > 0.05 * left.size:
                left &= part @ x.T >= threshold - 1e-4
            a, b = np.nonzero(left)
        else:
            # the best by the codes give a bound; whatever their error may lift above it is reranked too, so a block loses nothing
            keep, most = min(8 * k, len(x)), min(k + 1, len(x))
            near = np.argpartition(norm - 2 * score, keep - 1, axis=1)[:, :keep] if keep < len(x) else np.tile(np.arange(len(x)), (len(part), 1))
            bound = np.partition(np.einsum("ij,ikj->ik", part, x[near]), keep - most, axis=1)[:, keep - most]
            exact = np.where(score >= (bound - 1e-4)[:, None] - err, part @ x.T, np.float32(-2))
            b = (np.argpartition(-exact, most - 1, axis=1)[:, :most] if most < len(x) else np.tile(np.arange(len(x)), (len(part), 1))).ravel()
            a = np.repeat(np.arange(len(part)), most)
        for j in range(0, len(a), 500_000):
            aa, bb = a[j : j + 500_000], b[j : j + 500_000]
            cos = np.einsum("ij,ij->i", part[aa].astype(np.float64), x[bb].astype(np.float64))
            ok = qid[i + aa] != xid[bb]
            if threshold is not None:
                ok &= cos >= threshold
            out.append(pd.DataFrame({"q": qid[i + aa[ok]], "x": xid[bb[ok]], "cosine": cos[ok]}))
    got = pd.concat(out) if out else None
    if got is None or not len(got):
        return none
    if k is not None:
        got = got.sort_values(["q", "cosine", "x"], ascending=[True, False, True]).groupby("q").head(k)
    return pa.Table.from_pandas(got, schema=none.schema, preserve_index=False)
