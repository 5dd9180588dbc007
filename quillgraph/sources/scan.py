"""Source trees as relations: scan, exclusion, language, hashes, assets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILE_BYTES = 1_500_000

#: Folders and names a scan leaves out.
DEFAULT_EXCLUDES = (
    "**/node_modules/** **/.git/** **/dist/** **/build/** **/out/** **/.next/** **/coverage/** **/.venv/** **/venv/** **/__pycache__/** **/.quillgraph/** **/*.min.js **/*.map"
).split()

#: Languages and the extensions of their files.
LANGUAGES = {
    "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs", "python": "py", "ruby": "rb", "go": "go", "rust": "rs", "java": "java", "kotlin": "kt", "csharp": "cs",
    "php": "php", "c": "c h", "cpp": "cpp cc hpp", "swift": "swift", "scala": "scala", "sql": "sql", "shell": "sh", "r": "r", "lua": "lua", "dart": "dart", "vue": "vue",
    "svelte": "svelte",
}

#: Kinds of assets and their extensions.
ASSETS = {"pdf": "pdf", "markdown": "md mdx", "docs": "rst", "text": "txt", "video": "mp4 mov mkv webm", "image": "png jpg jpeg gif svg"}
TEXT_ASSETS = ("md", "mdx", "rst", "txt")


def extension(path: Column) -> Column:
    """The lower-cased extension without dot, empty if there is none; a leading dot begins a name, not an extension."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def _lookup(kinds: dict[str, str]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(e), F.lit(k)) for k, es in kinds.items() for e in es.split()))


def detect_language(path: Column) -> Column:
    ext = extension(path)
    return F.coalesce(F.try_element_at(_lookup(LANGUAGES), ext), F.try_element_at(_lookup(ASSETS), ext), F.lit("unknown"))


def is_code(path: Column) -> Column:
    return extension(path).isin(*" ".join(LANGUAGES.values()).split())


def is_asset(path: Column) -> Column:
    return extension(path).isin(*" ".join(ASSETS.values()).split())


def asset_kind(path: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(ASSETS), extension(path)), F.lit("text"))


def exclusion_pattern(globs: list[str]) -> str:
    """One regular expression for all globs: leading ``**/`` and trailing ``/**`` fall away, what is left matches a name at any depth,
    with everything below it; one with a slash inside is anchored at the root."""
    parts = []
    for g in globs:
        core = re.sub(r"/\*\*$", "", re.sub(r"^(\*\*/)+", "", g))
        core = re.sub(r"^/", "", core)
        body = re.escape(core).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        parts.append(("^" if "/" in core else "(?:^|/)") + body + "(?:/|$)")
    return "|".join(parts)


def _read_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got, keep = [], []
        for i, path in enumerate(b.column(0).to_pylist()):
            try:
                with open(path, "rb") as f:
                    got.append(f.read())
                keep.append(i)
            except OSError:
                continue
        kept = b.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column(1), pa.array(got, pa.binary()), kept.column(2), kept.column(3)], names=["path", "content", "size", "mtime_ms"])


def scan_files(spark: SparkSession, root: str, excludes: list[str] | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, content, size, mtime_ms): files below ``root`` by relative POSIX path, without excluded and oversized ones.

    Paths and lengths are listed and filtered first, so no excluded file is opened; files that cannot be read are passed over. A
    root with a scheme other than ``file`` is read by Spark's own source, which filters by length before it reads.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(base)
    local = "://" not in base or base.startswith("file:")
    base = re.sub("^file:/+", "/", base)
    path = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(path, "^file:/+", "/")
    rel = F.substring(path, len(base) + 2, 1 << 30)
    found = raw.where(F.col("length") <= max_bytes).withColumn("_rel", rel)
    found = found.where(~F.col("_rel").rlike(exclusion_pattern(excludes if excludes is not None else DEFAULT_EXCLUDES)))
    mtime = F.unix_millis("modificationTime").cast("double").alias("mtime_ms")
    if not local:
        return found.select(F.col("_rel").alias("path"), "content", F.col("length").alias("size"), mtime)
    listed = found.select(path.alias("at"), F.col("_rel").alias("path"), F.col("length").alias("size"), mtime)
    return listed.mapInArrow(_read_local, "path string, content binary, size bigint, mtime_ms double")


def snapshot(scanned: DataFrame) -> DataFrame:
    """(path, hash, size, mtime_ms, language) of a scan."""
    return scanned.select("path", F.sha1("content").alias("hash"), "size", "mtime_ms", detect_language(F.col("path")).alias("language"))


def readable(scanned: DataFrame) -> DataFrame:
    """(path, language, text): code and text assets decoded, other assets with an empty text."""
    ext = extension(F.col("path"))
    text = F.when(is_asset(F.col("path")) & ~ext.isin(*TEXT_ASSETS), "").otherwise(F.decode("content", "UTF-8"))
    return scanned.select("path", detect_language(F.col("path")).alias("language"), text.alias("text"))
