"""Source files that are not syntactically valid in the language of their extension."""

from __future__ import annotations

import re
import sys
import warnings
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grammars import grammar, python_grammar, python_lines

#: Extension to (grammar, language).
EXTENSIONS = {
    "ts": ("ts", "typescript"), "mts": ("ts", "typescript"), "tsx": ("tsx", "typescript"), "js": ("js", "javascript"), "mjs": ("js", "javascript"),
    "jsx": ("jsx", "javascript"), "py": ("py", "python"), "go": ("go", "go"), "java": ("java", "java"), "rs": ("rs", "rust"),
}

#: Frames that a parse may take, for the memory of an executor; a level of nesting takes about 13 of them.
MOST_FRAMES = 1_000_000
UNDECIDED = -2

_CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7}|={7})(?: |$)", re.M)
_DIFF = re.compile(r"\A(?:diff --git |--- \S+\n\+\+\+ )")
_MARKUP = re.compile(r"\A\s*<(?:!doctype|html|\?xml)", re.I)


def _python_fault(text: str) -> int:
    """Where a Python text fails, -1 if it is valid. The grammar decides; what it rejects goes through the compiler as an exact
    check, which clears texts that only a gap of the grammar rejects."""
    lined, origin, fault = python_lines(text)
    if lined is not None:
        v = python_grammar().check(lined)
        if v.ok:
            return -1
        at, source = origin[max(0, bisect_right(origin, (v.position, len(text) + 1)) - 1)]
        fault = min(len(text), source + v.position - at)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "<text>", "exec", dont_inherit=True)
        return -1
    except (SyntaxError, ValueError, MemoryError, RecursionError, OverflowError):
        return fault


def fault_of(text: str, ext: str) -> int:
    """Position of the furthest failure of ``text`` in the language of ``ext``; -1 if it is valid, UNDECIDED if its nesting
    takes more than MOST_FRAMES."""
    text = text[1:] if text.startswith("﻿") else text
    if not text:
        return -1
    limit = sys.getrecursionlimit()
    # no rule is entered twice at one position, so the frames are in proportion to the text at most
    rules = len((python_grammar() if ext == "py" else grammar(EXTENSIONS[ext][0])).rules)
    sys.setrecursionlimit(max(limit, min(MOST_FRAMES, rules * (2 * len(text) + 2) + 1000)))
    try:
        if ext == "py":
            return _python_fault(text)
        v = grammar(EXTENSIONS[ext][0]).check(text)
        return -1 if v.ok else v.position
    except (RecursionError, MemoryError):
        return UNDECIDED
    finally:
        sys.setrecursionlimit(limit)


def cause(text: str, at: int) -> str:
    """conflict, diff, markup, truncated or invalid."""
    mark = _CONFLICT.search(text)
    if mark and abs(mark.start() - at) <= 400:
        return "conflict"
    if _DIFF.match(text):
        return "diff"
    if _MARKUP.match(text):
        return "markup"
    return "truncated" if not text[at:].strip() else "invalid"


_OUT = "path string, language string, valid boolean, line int, column int, cause string"


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ext, text = path.rpartition(".")[2].lower(), text or ""
            at = fault_of(text, ext)
            if at == UNDECIDED:
                rows.append((path, EXTENSIONS[ext][1], None, None, None, "undecided"))
            elif at < 0:
                rows.append((path, EXTENSIONS[ext][1], True, None, None, None))
            else:
                line = text.count("\n", 0, at) + 1
                rows.append((path, EXTENSIONS[ext][1], False, line, at - text.rfind("\n", 0, at), cause(text, at)))
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _OUT.split(", ")])


def check_files(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, repo, language, valid, line, column, cause) for every path of ``files`` with a known extension and a text.

    A text is valid if the grammar of its extension consumes all of it; the empty and the null text are. ``line`` and
    ``column`` (from 1) give the furthest failure. A path listed several times counts once, with the repository of its last
    scan; null paths are left out. For a text nested deeper than the parser can follow, ``valid`` is null and the cause undecided.
    """
    known = F.lower(F.substring_index("path", ".", -1)).isin(*EXTENSIONS) & F.col("path").contains(".")
    listed = files.where(F.col("path").isNotNull() & known).groupBy("path").agg(F.max_by("repo", F.struct("indexed_at", "repo")).alias("repo"))
    wanted = texts.select("path", "content").where(F.col("path").isNotNull() & known)
    checked = wanted.mapInArrow(_check, _OUT)
    return listed.join(checked, "path").select("path", "repo", "language", "valid", "line", "column", "cause")


def rates(checked: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, conflicts, undecided, rate): the rate is that of the decided files."""
    return (
        checked.groupBy("repo", "language")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum((~F.col("valid")).cast("int")).alias("invalid"),
            F.sum(F.when(F.col("cause") == "conflict", 1).otherwise(0)).alias("conflicts"),
            F.sum(F.col("valid").isNull().cast("int")).alias("undecided"),
        )
        .withColumn("invalid", F.coalesce("invalid", F.lit(0).cast("bigint")))
        .withColumn("rate", F.round(F.col("invalid") / F.nullif(F.col("files") - F.col("undecided"), F.lit(0)), 6))
    )
