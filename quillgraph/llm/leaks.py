"""Evaluation texts inside a training corpus: verbatim runs, and latent semantic retrieval of altered passages.

``verbatim_leaks`` is the plain rule (``run`` consecutive words). No similarity in a truncated latent space can promise it,
for a run of twelve words need not dominate any passage, so it stands beside the latent search and isn't derived from it.

``LatentLeaks`` is a randomised SVD of the TF-IDF matrix of all passages of the corpus, computed where the passages are:
a pass multiplies blocks of passages with a thin matrix and adds up contributions of fixed size. Passages near an item
in the latent space are candidates; the longest common subsequence and the item's telling words decide, in the same task.

Words are numbered by 20 bits of their hash, and counted, weighed and compared under these numbers. The matrix has fewer columns
(``features``): a word adds to one of them with a sign of its own, so that words that meet in a column cancel out on average
instead of adding up, and inner products of passages are kept up to small noise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import xxhash64
from xxhash import xxh64_intdigest

from ..session import materialise

_WORD = re.compile(r"[a-z0-9]+")


def words_of(text):
    """The maximal runs of a-z and 0-9 after lower-casing."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))


def _runs(rows: DataFrame, id_col: str, run: int) -> DataFrame:
    """(id, h): the hash of every run of ``run`` words, distinct within the row; shorter texts have none."""
    words = rows.select(F.col(id_col), words_of(F.col("text")).alias("w")).where(F.size("w") >= run)
    starts = F.when(F.size("w") >= run, F.sequence(F.lit(1), F.size("w") - (run - 1)))
    # the outer form, since for the inner one the optimizer derives a filter that computes the runs once more
    runs = words.select(id_col, F.array_distinct(F.transform(starts, lambda i: xxhash64(F.slice("w", i, run)))).alias("runs"))
    return runs.select(id_col, F.explode_outer("runs").alias("h")).where(F.col("h").isNotNull())


def verbatim_leaks(docs: DataFrame, items: DataFrame, run: int = 12) -> DataFrame:
    """(doc_id, item_id) of documents that hold ``run`` consecutive words of an item.

    Null, empty and shorter texts hold none; repeated rows count once. The items' runs are broadcast if Spark's size
    estimate allows, else both sides are partitioned on the run.
    """
    asked = _runs(items.where(F.col("item_id").isNotNull()), "item_id", run).distinct()
    return _runs(docs, "doc_id", run).join(asked, "h").select("doc_id", "item_id").distinct()


#: Bits of a word's number.
NUMBER_BITS = 20


@dataclass(frozen=True)
class LatentConfig:
    stride: int = 12
    features: int = 1 << 13
    rank: int = 80
    oversample: int = 8
    power: int = 0
    cosine: float = 0.6
    lcs: float = 0.45
    answer: float = 0.65


def number_of(word: str) -> int:
    """The same as ``pmod(xxhash64(word), 2 ** NUMBER_BITS)`` in Spark."""
    return xxh64_intdigest(word, seed=42) % (1 << NUMBER_BITS)


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & masks.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


class _Passages:
    """Passages over a block of documents: two neighbouring stretches of ``stride`` words, every word covered.

    A document of one stretch is one passage; a document without words has none.
    """

    def __init__(self, lengths: np.ndarray, stride: int):
        base = np.cumsum(lengths) - lengths
        count = -(-lengths // stride)
        owner = np.repeat(np.arange(len(lengths)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        #: first word of each stretch, in the concatenation
        self.heads = base[owner] + nth * stride
        self.sizes = np.diff(np.append(self.heads, lengths.sum()))
        last = nth == count[owner] - 1
        self.one = np.flatnonzero(~last | (nth == 0))
        self.double = ~last[self.one]
        self.two = self.one[self.double] + 1
        self.owner = owner[self.one]
        self.at = (nth[self.one] * stride).astype(np.int32)

    def __len__(self) -> int:
        return len(self.one)

    def gather(self, stretches: np.ndarray) -> np.ndarray:
        out = stretches[self.one]
        out[self.double] += stretches[self.two]
        return out

    def scatter(self, passages: np.ndarray) -> np.ndarray:
        """The transpose of ``gather``; a stretch begins at most one passage and ends at most one."""
        out = np.zeros((len(self.heads), passages.shape[1]), dtype=passages.dtype)
        out[self.one] = passages
        out[self.two] += passages[self.double]
        return out


def _row_sums(at: np.ndarray, rows: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each different value of ``at``, the sum of its ``rows[which]``): frequent ones summed at once, the others in rounds."""
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[which[order]]
    heads = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    size = np.diff(np.append(heads, len(at)))
    out = rows[heads]
    for k in np.flatnonzero(size > 24):
        out[k] = rows[heads[k] : heads[k] + size[k]].sum(axis=0)
    few = np.where(size > 24, 0, size)
    for j in range(1, int(few.max(initial=1))):
        k = np.flatnonzero(few > j)
        out[k] += rows[heads[k] + j]
    return at[heads], out


def _blocks(batches: Iterator[pa.RecordBatch], words: int = 40_000):
    """Blocks of documents with words: (doc ids, word numbers, lengths)."""
    ids, parts, sizes, held = [], [], [], 0
    for b in batches:
        lists = b.column(1)
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False)
        for d, x, y in zip(b.column(0).to_pylist(), ends[:-1], ends[1:]):
            ids.append(d)
            parts.append(values[x:y])
            sizes.append(y - x)
            held += y - x
            if held >= words:
                yield ids, np.concatenate(parts), np.array(sizes, dtype=np.int64)
                ids, parts, sizes, held = [], [], [], 0
    if held:
        yield ids, np.concatenate(parts), np.array(sizes, dtype=np.int64)


_PART = "part int, data binary"
_PARTS = 16


def _emit(total: np.ndarray) -> pa.RecordBatch:
    rows = np.array_split(total, _PARTS)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(_PARTS, dtype=np.int32)), pa.array([np.ascontiguousarray(r, dtype=np.float32).tobytes() for r in rows], pa.binary())],
        names=["part", "data"],
    )


def _add(t):
    cols = t.column("data").to_pylist()
    total = np.frombuffer(cols[0], dtype=np.float32).astype(np.float64)
    for c in cols[1:]:
        total = total + np.frombuffer(c, dtype=np.float32)
    return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "data": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _total(df: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Adds up matrices of fixed shape emitted by the tasks; the driver gets one matrix, whatever the corpus."""
    parts = df.groupBy("part").applyInArrow(_add, _PART).collect()
    data = b"".join(r["data"] for r in sorted(parts, key=lambda r: r["part"]))
    return np.frombuffer(data, dtype=np.float32).reshape(shape).astype(np.float64) if parts else np.zeros(shape)


def _unit_rows(y: np.ndarray) -> np.ndarray:
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)


class _Space:
    """How numbered words map to columns of the matrix: the column, and the weight with its sign. Small, for each pass ships it."""

    def __init__(self, idf: np.ndarray, features: int):
        self.features, self.idf = features, idf.astype(np.float16)

    def place(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(column, signed weight) of each word."""
        mixed = (words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        weight = self.idf[words].astype(np.float32)
        return (mixed % np.uint64(self.features)).astype(np.int64), np.where((mixed >> np.uint64(20)) & np.uint64(1), -weight, weight)

    def sums(self, p: _Passages, words: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Per passage the weighted sum of its words' rows of ``right`` (features x width)."""
        own, which = np.unique(words, return_inverse=True)
        column, weight = self.place(own)
        rows = right[column] * weight[:, None]
        total = np.zeros((len(p.heads), right.shape[1]), dtype=np.float32)
        for j in range(int(p.sizes.max(initial=0))):
            has = np.flatnonzero(p.sizes > j)
            total[has] += rows[which[p.heads[has] + j]]
        return p.gather(total)

    def lengths(self, p: _Passages, words: np.ndarray) -> np.ndarray:
        """Per passage the length of its row, words taken as columns of their own."""
        square = self.idf[words].astype(np.float32) ** 2
        return np.sqrt(p.gather(np.add.reduceat(square, p.heads)[:, None]))


class _Items:
    """Passages of the items in the latent space, in groups by direction.

    A passage of the corpus looks into a group only if its angle to the group's centre leaves room for an item within
    the angle wanted (triangle inequality), so nothing is lost, and its products with the items of other groups aren't taken.
    """

    def __init__(self, vectors: np.ndarray, cosine: float):
        rng = np.random.default_rng(3)
        n = len(vectors)
        centres = vectors[rng.choice(n, max(1, round(np.sqrt(n))), replace=False)] if n else vectors
        for _ in range(5):
            own = (vectors @ centres.T).argmax(axis=1) if n else np.zeros(0, dtype=np.int64)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, vectors)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
        own = (vectors @ centres.T).argmax(axis=1) if n else own
        self.vectors, self.cosine, self.centres = vectors, cosine, centres
        self.groups = [np.flatnonzero(own == g) for g in range(len(centres))]
        reach = np.array([np.arccos(np.clip((vectors[g] @ c).min(initial=1.0), -1, 1)) for g, c in zip(self.groups, centres)])
        self.least = np.cos(np.minimum(reach + np.arccos(cosine), np.pi)) - 1e-5

    def near(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of y, item passage, cosine) of all products of at least ``cosine``."""
        rows, items, cosines = [], [], []
        to = y @ self.centres.T
        for g, members in enumerate(self.groups):
            k = np.flatnonzero(to[:, g] >= self.least[g])
            if len(k) and len(members):
                product = y[k] @ self.vectors[members].T
                a, b = np.nonzero(product >= self.cosine)
                rows.append(k[a])
                items.append(members[b])
                cosines.append(product[a, b])
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(rows), np.concatenate(items), np.concatenate(cosines)) if rows else (none, none, np.zeros(0))


_LEAK = "doc_id bigint, item_id bigint, cosine double, lcs double, answer double"


class LatentLeaks:
    """Items whose passages, also altered ones, stand in documents.

    Null and empty texts match nothing. Repeated documents are each reported. ``items`` are the queries; they are searched in
    blocks of about ``item_block``, one pass over the corpus for each. All documents, whole texts, are in the statistics and the
    search.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, cfg: LatentConfig = LatentConfig(), item_block: int = 20_000):
        self.cfg, self.item_block = cfg, item_block
        self.items = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
        numbers = F.transform(words_of(F.col("text")), lambda w: F.pmod(xxhash64(w), F.lit(1 << NUMBER_BITS)).cast("int"))
        numbered = docs.where(F.col("text").isNotNull()).select("doc_id", numbers.alias("words")).where(F.size("words") > 0)
        self.numbered = materialise(numbered)
        sc = docs.sparkSession.sparkContext
        #: the passes add up a matrix for each task, so they get a few tasks for each core, not one for each piece of a file
        self.few = self.numbered.coalesce(4 * sc.defaultParallelism)
        self._weigh()
        self._decompose()

    def _weigh(self) -> None:
        cfg, size = self.cfg, 1 << NUMBER_BITS

        def count(batches):
            seen = np.zeros(size + 1)
            for _, words, lengths in _blocks(batches):
                p = _Passages(lengths, cfg.stride)
                stretch = np.repeat(np.arange(len(p.heads)), p.sizes)
                # a stretch's words, once for each passage it belongs to
                begins, ends = np.full(len(p.heads), -1), np.full(len(p.heads), -1)
                begins[p.one] = np.arange(len(p))
                ends[p.two] = np.flatnonzero(p.double)
                for_each = np.concatenate([begins[stretch], ends[stretch]])
                word = np.tile(words, 2)[for_each >= 0]
                pair = np.sort(for_each[for_each >= 0] * size + word)
                once = pair[np.append(True, pair[1:] != pair[:-1])]
                numbers, n = np.unique(once % size, return_counts=True)
                seen[numbers] += n
                seen[size] += len(p)
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at].astype(np.int64))], names=["number", "n"])

        counted = self.few.mapInArrow(count, "number bigint, n bigint").groupBy("number").agg(F.sum("n").alias("n")).toArrow()
        df = np.zeros(size + 1)
        df[counted.column("number").to_numpy()] = counted.column("n").to_numpy()
        self.n_passages = df[-1]
        self.space = _Space(np.log((1 + df[-1]) / (1 + df[:-1])) + 1e-3, cfg.features)

    def _multiply(self, right: np.ndarray) -> np.ndarray:
        """A'A right, A being the passages' TF-IDF rows of unit length."""
        cfg, space = self.cfg, self.space
        table = right.astype(np.float32)

        def work(batches):
            total = np.zeros(table.shape)
            for _, words, lengths in _blocks(batches):
                p = _Passages(lengths, cfg.stride)
                scale = 1 / space.lengths(p, words)
                z = p.scatter(space.sums(p, words, table) * scale**2)
                own, sums = _row_sums(words, z, np.repeat(np.arange(len(p.heads)), p.sizes))
                column, weight = space.place(own)
                # several words may meet in a column: each round adds one of each column
                order = np.argsort(column, kind="stable")
                nth = np.arange(len(order)) - np.searchsorted(column[order], column[order])
                for j in range(int(nth.max(initial=0)) + 1):
                    k = order[nth == j]
                    total[column[k]] += sums[k] * weight[k, None]
            yield _emit(total)

        return _total(self.few.mapInArrow(work, _PART), right.shape)

    def _decompose(self) -> None:
        """Subspace iteration (``power`` rounds), then the Nystroem form: with Q orthonormal and W = A'A Q, A'A is close to W (Q'W)^-1 W'.

        Without a round the space is found in one pass over the corpus; rounds sharpen the leading directions at the cost of the
        others, which telling words need, and found fewer leaks on the test tables.
        """
        cfg = self.cfg
        q, _ = np.linalg.qr(np.random.default_rng(11).standard_normal((cfg.features, cfg.rank + cfg.oversample)))
        for _ in range(cfg.power):
            q, _ = np.linalg.qr(self._multiply(q))
        w = self._multiply(q)
        # a small shift keeps the small matrix positive, and is taken from the values again
        shift = 1e-6 * max(np.linalg.norm(w), 1e-9)
        w = w + shift * q
        small = q.T @ w
        factor = np.linalg.cholesky((small + small.T) / 2)
        vectors, values, _ = np.linalg.svd(np.linalg.solve(factor, w.T).T, full_matrices=False)
        #: features x rank; the right singular vectors
        self.basis = vectors[:, : cfg.rank]
        self.singular = np.sqrt(np.maximum(values[: cfg.rank] ** 2 - shift, 0))

    def _blocks_of_items(self) -> Iterator[list[tuple[int, str]]]:
        blocks = max(1, -(-self.items.count() // self.item_block))
        for b in range(blocks):
            rows = self.items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
            yield sorted((r["item_id"], r["text"]) for r in rows)

    def leaks(self) -> DataFrame:
        """(doc_id, item_id, cosine, lcs, answer): the best passage of each document and item that passes both checks.

        ``lcs`` is the longest common subsequence with the surrounding words as a share of the item's passage, ``answer``
        the share of what its words tell that is found there: each different word counts by its inverse passage frequency, so the
        names and numbers of an item count for more than the wording it has in common with others.
        """
        found = None
        for items in self._blocks_of_items():
            part = self.numbered.mapInArrow(self._search(items), _LEAK)
            found = part if found is None else found.unionByName(part)
        return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))

    def _search(self, items: list[tuple[int, str]]):
        cfg, space, basis = self.cfg, self.space, self.basis.astype(np.float32)
        texts = [_WORD.findall(t.lower()) for _, t in items]
        numbers = [np.array([number_of(w) for w in ws], dtype=np.int64) for ws in texts]
        asked = _Passages(np.array([len(w) for w in texts], dtype=np.int64), cfg.stride)
        index = _Items(_unit_rows(space.sums(asked, np.concatenate([*numbers, np.zeros(0, dtype=np.int64)]), basis)), cfg.cosine)
        ids, owner, at = [i for i, _ in items], asked.owner, asked.at
        wants = [numbers[o][a : a + 2 * cfg.stride].tolist() for o, a in zip(owner, at)]
        keys = [{n: float(space.idf[n]) for n in w} for w in wants]
        tells = [sum(k.values()) for k in keys]

        def check(item: int, around: list[int]) -> tuple[float, float]:
            """(lcs, answer)"""
            lcs = lcs_length(wants[item], around) / len(wants[item])
            return lcs, sum(v for n, v in keys[item].items() if n in around) / tells[item]

        def search(batches):
            for docs, words, lengths in _blocks(batches):
                p = _Passages(lengths, cfg.stride)
                starts = np.cumsum(lengths) - lengths
                best: dict[tuple[int, int], tuple[float, float, float]] = {}
                for k, item, cosine in zip(*(x.tolist() for x in index.near(_unit_rows(space.sums(p, words, basis))))):
                    doc = p.owner[k]
                    lo = max(0, p.at[k] - cfg.stride // 2)
                    hi = min(lengths[doc], p.at[k] + 2 * cfg.stride + cfg.stride // 2)
                    lcs, answer = check(item, words[starts[doc] + lo : starts[doc] + hi].tolist())
                    pair = (docs[doc], ids[owner[item]])
                    if lcs >= cfg.lcs and answer >= cfg.answer and lcs > best.get(pair, (0, 0, 0))[1]:
                        best[pair] = (cosine, lcs, answer)
                rows = [(*pair, *got) for pair, got in best.items()]
                cols = list(zip(*rows)) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

        return search
