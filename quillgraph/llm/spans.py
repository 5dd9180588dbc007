"""Long verbatim spans shared between records, by recompression.

Every text is rewritten in rounds: a round either names maximal runs of one symbol or names pairs (a, b) with ``a`` on
the left and ``b`` on the right side of a partition of the alphabet. A name is a 64-bit mix of what it stands for, so
all tasks agree on it without a dictionary or a shuffle, and equal substrings carry equal symbols everywhere but at
their ends. How far that instability reaches is a function of the substring alone: each round spoils at most the first
symbol (or run) and the last. So every window of ``span`` characters has, wherever it stands, the same stable symbols.
After ``ROUNDS`` rounds (or as many as leave seven tenths of the window stable) a last round names the sequences of
symbols that cover ``CORE`` characters, and the window's key is the smallest name among its stable sequences. Neighbouring
windows mostly agree, which leaves few keys for a text.

Recompression thus finds the candidates: neighbouring windows of one key form a stretch, and stretches whose key is met in
two different texts are cut out of their texts. The decision is exact and by content: equal stretches (128 bits) are shared
as a whole, which settles the inside of every long span; where stretches of one key differ, as at the ends of a span, their
windows are named by all of their ``span`` characters (128 bits), one naming for all copies of a stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release

#: Characters that the symbols of a key cover at least.
CORE = 40
_BATCH_CHARS = 400_000
#: Rounds after which windows are keyed; windows whose stable part is too short by then are keyed after fewer.
ROUNDS = 6
_BASE = 0xD6E8FEB86659FD93
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _name(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(a * _U(0x9E3779B97F4A7C15) + _mix(b + _U(salt)))


class _Parse:
    """The symbols of a batch at one level: names, start offsets, and whether a text begins there."""

    def __init__(self, chars: np.ndarray, first: np.ndarray):
        self.sym = _mix(chars.astype(np.uint64) + _U(1))
        self.at = np.arange(len(chars) + 1, dtype=np.int64)
        self.first = first

    def _regroup(self, head: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Keep symbols where ``head``; returns the new index of each old boundary."""
        new = np.empty(len(head) + 1, dtype=np.int64)
        new[0] = 0
        np.cumsum(head, out=new[1:])
        where = np.flatnonzero(head)
        self.sym, self.first = names[where], self.first[where]
        self.at = np.append(self.at[where], self.at[-1])
        return new

    def runs(self, lo: np.ndarray, hi: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.sym)
        head = np.ones(n, dtype=bool)
        head[1:] = (self.sym[1:] != self.sym[:-1]) | self.first[1:]
        starts = np.flatnonzero(head)
        length = np.diff(np.append(starts, n))
        names = self.sym.copy()
        long = length > 1
        names[starts[long]] = _name(self.sym[starts[long]], length[long].astype(np.uint64), salt)
        new = self._regroup(head, names)
        # new[k + 1] - 1 is the run that holds old symbol k; the first and last run of a window may reach beyond it
        return np.minimum(new[lo + 1], new[hi]), np.maximum(new[hi] - 1, 0)

    def pairs(self, lo: np.ndarray, hi: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
        right = (_mix(self.sym ^ _U(salt)) >> _U(17)) & _U(1) == 1
        join = np.zeros(len(self.sym), dtype=bool)
        join[:-1] = ~right[:-1] & right[1:] & ~self.first[1:]
        names = self.sym.copy()
        k = np.flatnonzero(join)
        names[k] = _name(self.sym[k], self.sym[k + 1], salt)
        head = np.ones(len(self.sym), dtype=bool)
        head[k + 1] = False
        lo = lo + right[lo]
        hi = hi - ~right[np.maximum(hi - 1, 0)]
        new = self._regroup(head, names)
        return new[lo], new[np.maximum(hi, 0)]


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the smallest value in each [lo, hi), all non-empty."""
    table = [np.arange(len(values))]
    widest, step = int((hi - lo).max(initial=1)), 1
    while step * 2 <= widest:
        last = table[-1]
        a, b = last[: len(last) - step], last[step:]
        table.append(np.where(values[b] < values[a], b, a))
        step *= 2
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), dtype=np.int64)
    for k, t in enumerate(table):
        own = level == k
        a, b = t[lo[own]], t[hi[own] - (1 << k)]
        out[own] = np.where(values[b] < values[a], b, a)
    return out


def _windows(texts: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters, starts of texts among them, and for every window its text, number and first character."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    first = np.zeros(len(chars), dtype=bool)
    first[starts[:-1][sizes > 0]] = True
    count = np.maximum(sizes - span + 1, 0)
    doc = np.repeat(np.arange(len(texts)), count)
    window = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return chars, first, doc, window, starts[doc] + window


def _assign(chars, first, begin, span: int, levels_from: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of every window and where its sequence stands, after ``levels_from`` rounds or more; -1 where too little is stable."""
    core, room = min(CORE, span), span * 7 // 10
    parse = _Parse(chars, first)
    key = np.zeros(len(begin), dtype=np.uint64)
    place = np.full(len(begin), -1, dtype=np.int64)
    # neighbouring windows with the same stable symbols go on as one group [w0, w1)
    lo, hi = begin, begin + span
    w0 = np.arange(len(begin))
    w1 = w0 + 1
    for level in range(ROUNDS + 1):
        at, n = parse.at, len(parse.sym)
        ok = (hi > lo) & (at[np.maximum(hi, lo)] - at[lo] >= room)
        if not ok.all():
            lo, hi, w0, w1 = lo[ok], hi[ok], w0[ok], w1[ok]
        if not len(lo):
            break
        same = (lo[1:] == lo[:-1]) & (hi[1:] == hi[:-1]) & (w0[1:] == w1[:-1])
        if same.any():
            cut = np.flatnonzero(np.append(True, ~same))
            w1 = w1[np.append(cut[1:], len(lo)) - 1]
            lo, hi, w0 = lo[cut], hi[cut], w0[cut]
        if level >= levels_from:
            # the shortest sequence of symbols from each symbol that covers ``core`` characters, and its name
            end = np.searchsorted(at, at[:-1] + core)
            prefix = np.zeros(n + 1, dtype=np.uint64)
            with np.errstate(over="ignore"):
                spread = np.cumprod(np.full(n + 1, _BASE, dtype=np.uint64))
                back = np.cumprod(np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64))
                np.cumsum(_mix(parse.sym) * spread[:n], out=prefix[1:])
                stop = np.minimum(end, n)
                name = _mix((prefix[stop] - prefix[:n]) * back[:n] + (stop - np.arange(n)).astype(np.uint64))
            last = np.searchsorted(end, hi, side="right")
            has = np.flatnonzero(last > lo)
            best = _range_min(name, lo[has], last[has])
            width = w1[has] - w0[has]
            into = np.repeat(w0[has] - np.cumsum(width) + width, width) + np.arange(width.sum())
            key[into] = np.repeat(name[best], width)
            place[into] = np.repeat(at[best], width)
        salt = 0x51ED270B + 0x1000193 * level
        lo, hi = parse.runs(lo, hi, salt) if level % 4 == 0 else parse.pairs(lo, hi, salt)
    return key, place


def window_keys(texts: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, key, first window, last window) for every stretch of windows with one key.

    The low levels are looked at only for texts in which some window has no key on the higher ones.
    """
    chars, first, doc, window, begin = _windows(texts, span)
    key, place = _assign(chars, first, begin, span, ROUNDS)
    if (place < 0).any():
        again = np.unique(doc[place < 0])
        part = _windows([texts[i] for i in again], span)
        low_key, low_place = _assign(part[0], part[1], part[4], span, 0)
        into = np.flatnonzero(np.isin(doc, again))
        unset = place[into] < 0
        key[into[unset]], place[into[unset]] = low_key[unset], (low_place - part[4] + begin[into])[unset]
    if not len(key):
        return doc, key, window, window
    change = np.ones(len(key), dtype=bool)
    change[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])
    cut = np.flatnonzero(change)
    return doc[cut], key[cut], window[cut], window[np.append(cut[1:], len(key)) - 1]


def window_names(texts: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, window, two independent 64-bit names) of every window of ``texts``."""
    chars, _, doc, window, begin = _windows(texts, span)
    chars, out = chars.astype(np.uint64), []
    for seed, base in ((0x243F6A88, 0x9E3779B97F4A7C15), (0x13198A2E, 0xC2B2AE3D27D4EB4F)):
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(chars) + 1, base, dtype=np.uint64))
            back = np.cumprod(np.full(len(chars) + 1, pow(base, -1, 1 << 64), dtype=np.uint64))
            sums = np.concatenate([[_U(0)], np.cumsum(_mix(chars + _U(seed)) * power[: len(chars)])])
            out.append(_mix((sums[begin + span] - sums[begin]) * back[begin]))
    return doc, window, out[0], out[1]


_KEYS = "key bigint, num bigint, w0 int, w1 int"
_STRETCHES = "num bigint, key bigint, w0 int, piece string"
_NAMES = "h1 bigint, h2 bigint, cid binary, off int, once boolean"


def _keys_of(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(nums, texts):
            doc, key, w0, w1 = window_keys(texts, span)
            return pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(np.array(nums, dtype=np.int64)[doc]), pa.array(w0.astype(np.int32)), pa.array(w1.astype(np.int32))],
                names=["key", "num", "w0", "w1"],
            )

        nums, texts, held = [], [], 0
        for b in batches:
            for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                nums.append(c)
                texts.append(t)
                held += len(t)
                if held > _BATCH_CHARS:
                    yield flush(nums, texts)
                    nums, texts, held = [], [], 0
        if texts:
            yield flush(nums, texts)

    return run


def _cut_out(span: int):
    """(num, text, spans) to the text of every stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, t, spans in zip(*(b.column(i).to_pylist() for i in range(3))):
                for i in range(0, len(spans), 4096):
                    part = spans[i : i + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([n] * len(part), pa.int64()), pa.array([s["key"] for s in part], pa.int64()), pa.array([s["w0"] for s in part], pa.int32()),
                            pa.array([t[s["w0"] : s["w1"] + span] for s in part], pa.string()),
                        ],
                        names=["num", "key", "w0", "piece"],
                    )

    return run


def _names_of(span: int):
    """(cid, piece) to the names of the windows of every piece; ``once`` is false where a piece repeats a window of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids, texts):
            doc, window, h1, h2 = window_names(texts, span)
            first = np.zeros(len(doc), dtype=bool)
            first[np.unique(np.rec.fromarrays([doc, h1, h2]), return_index=True)[1]] = True
            return pa.RecordBatch.from_arrays(
                [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids, pa.binary()).take(pa.array(doc)), pa.array(window.astype(np.int32)), pa.array(first)],
                names=["h1", "h2", "cid", "off", "once"],
            )

        ids, texts, held = [], [], 0
        for b in batches:
            for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(c)
                texts.append(t)
                held += len(t)
                if held > _BATCH_CHARS:
                    yield flush(ids, texts)
                    ids, texts, held = [], [], 0
        if texts:
            yield flush(ids, texts)

    return run


_SET = ("n", "x", "y")


def _set_of(cid) -> list:
    """The name of a set of pieces: their number and two mixes of their names; aggregates."""
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(cid)).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), cid)).alias("y")]


class SharedSpans:
    """Spans of at least ``span`` characters that occur verbatim in more than one record.

    Input: an id and a text column of ``rows``; further columns are ignored. Rows with a null id or text take no part,
    texts shorter than ``span`` (the empty one too) share nothing, repeated rows of one id are one record, an id with
    several texts has the spans of each. Characters are code points, white space and line ends included.

    Exact copies form one class and are handled once; ``pairs`` expands them, ``per_record`` and ``classes`` don't.
    """

    def __init__(self, rows: DataFrame, id_col: str = "id", text_col: str = "snippet", span: int = 120):
        if span < 2:
            raise ValueError("span must be at least 2")
        self.span = span
        base = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
        self.records = base.withColumn("cls", F.unhex(F.md5("text")))
        long = self.records.where(F.length("text") >= span)
        self.members = long.select("cls", "id").distinct()
        docs = materialise(long.groupBy("cls").agg(F.first("text").alias("text")).withColumn("num", F.monotonically_increasing_id()))
        keys = materialise(docs.select("num", "text").mapInArrow(_keys_of(span), _KEYS))
        #: (num, cls): a short number for each text
        self.classes = materialise(docs.select("num", "cls"))
        met = keys.groupBy("key").agg(F.min("num").alias("a"), F.max("num").alias("b")).where("a < b").select("key")
        spans = keys.join(met, "key", "left_semi").groupBy("num").agg(F.collect_list(F.struct("key", "w0", "w1")).alias("spans"))
        cut = docs.join(spans, "num").select("num", "text", "spans").mapInArrow(_cut_out(span), _STRETCHES)
        #: (num, key, w0, piece, cid): stretches of a key that another text has too, with their text and its name
        self.stretches = materialise(cut.withColumn("cid", F.unhex(F.md5("piece"))))
        release(docs, keys)
        pieces = self.stretches.groupBy("cid", "key").agg(F.min("num").alias("lo"), F.max("num").alias("hi"))
        #: (cid, key, lo, hi): the different stretches
        self.pieces = materialise(pieces)
        unlike = self.pieces.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
        apart = self.stretches.join(unlike, "key", "left_semi").groupBy("cid").agg(F.first("piece").alias("piece"))
        names = materialise(apart.mapInArrow(_names_of(span), _NAMES))
        groups = names.where("once").groupBy("h1", "h2").agg(*_set_of(F.col("cid"))).where("n > 1")
        #: (cid, off, n, x, y): windows that several pieces hold; (n, x, y) tells the set of those pieces
        self.windows = materialise(names.join(groups, ["h1", "h2"]).select("cid", "off", *_SET))
        release(names)

    def _sets(self) -> DataFrame:
        """(n, x, y, num): the texts of every set of pieces that share something, a piece alone being such a set too."""
        partial = self.windows.select("cid", *_SET).distinct()
        whole = self.pieces.where("lo < hi").groupBy("cid").agg(*_set_of(F.col("cid"))).select("cid", *_SET)
        return partial.unionByName(whole).join(self.stretches.select("cid", "num").distinct(), "cid").select(*_SET, "num").distinct()

    def class_pairs(self) -> DataFrame:
        """(num_a, num_b): different texts that share a span; one emission for each set of texts, not each window."""
        sets = self._sets()
        return (
            sets.withColumnRenamed("num", "num_a")
            .join(sets.withColumnRenamed("num", "num_b"), [*_SET])
            .where("num_a < num_b")
            .select("num_a", "num_b")
            .distinct()
        )

    def pairs(self) -> DataFrame:
        """(node_id_a, node_id_b), smaller first, of all records that share a span."""
        m = self.members.join(self.classes, "cls").select("num", "id")
        a, b = m.select(F.col("num").alias("num_a"), F.col("id").alias("ia")), m.select(F.col("num").alias("num_b"), F.col("id").alias("ib"))
        across = self.class_pairs().join(a, "num_a").join(b, "num_b").select("ia", "ib")
        within = a.join(b, F.col("num_a") == F.col("num_b")).select("ia", "ib")
        return (
            across.union(within)
            .where("ia <> ib")
            .select(F.least("ia", "ib").alias("node_id_a"), F.greatest("ia", "ib").alias("node_id_b"))
            .distinct()
        )

    def per_record(self) -> DataFrame:
        """(id, n_chars, shared_chars, shared_part, class_id) for every record: how much of it stands elsewhere too.

        A text that another record repeats as a whole is shared throughout if it is ``span`` long; for an id with
        several texts the longest text counts. ``shared_part`` is null for the empty text.
        """
        whole = self.stretches.join(self.pieces.where("lo < hi").select("cid").distinct(), "cid", "left_semi")
        spread = self._sets().groupBy(*_SET).agg(F.min("num").alias("lo"), F.max("num").alias("hi")).where("lo < hi").select(*_SET)
        offs = self.windows.join(spread, [*_SET], "left_semi").groupBy("cid").agg(F.collect_set("off").alias("offs"))
        single = self.stretches.join(offs, "cid").select("num", F.explode("offs").alias("off"), "w0")
        # first and last window of each shared part; the merge below adds up what they cover
        parts = whole.select("num", F.col("w0").alias("a"), (F.col("w0") + F.length("piece") - self.span).alias("b")).unionByName(
            single.select("num", (F.col("w0") + F.col("off")).alias("a"), (F.col("w0") + F.col("off")).alias("b"))
        )
        cover = parts.groupBy("num").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("p")).select(
            "num",
            F.aggregate(
                "p",
                F.struct(F.lit(0).alias("sum"), F.lit(0).alias("upto")),
                lambda s, x: F.struct(
                    (s["sum"] + F.greatest(F.lit(0), x["b"] + self.span - F.greatest(x["a"], s["upto"]))).alias("sum"), F.greatest(s["upto"], x["b"] + self.span).alias("upto")
                ),
                lambda s: s["sum"],
            ).alias("covered"),
        ).join(self.classes, "num").select("cls", "covered")
        copies = self.members.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
        one = self.records.groupBy("id").agg(F.max(F.struct(F.length("text").alias("n"), F.col("cls").alias("cls"))).alias("r"))
        return (
            one.select("id", F.col("r.n").alias("n_chars"), F.col("r.cls").alias("cls"))
            .join(cover, "cls", "left")
            .join(copies, "cls", "left")
            .withColumn("shared_chars", F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))))
            .select(
                "id", "n_chars", "shared_chars",
                F.round(F.try_divide("shared_chars", "n_chars"), 6).alias("shared_part"),
                F.lower(F.hex("cls")).alias("class_id"),
            )
        )
