"""The stored tables as versioned parquet folders: what is written stands beside its last version, then is named current.

Tables of files are divided into buckets by the hash of the path, and a change of some files writes the buckets of these files alone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "files": "path string, hash string, size bigint, mtime_ms double, language string",
    "nodes": "id string, kind string, name string, file_path string, language string, start_line int, end_line int, signature string, snippet string, meta string",
    "edges": "id string, kind string, from_id string, to_id string, confidence double, file_path string",
    "embeddings": "node_id string, dim int, vec array<float>, text_hash string, signature string",
    "call_sites": "file_path string, caller_id string, callee_name string, receiver string, line int",
    "ranks": "node_id string, rank double",
}
SCHEMAS["documents"] = SCHEMAS["edges"]

#: The tables in buckets, and the column of the path that decides.
PATHS = {"files": "path", "nodes": "file_path", "edges": "file_path", "call_sites": "file_path"}
BUCKETS = 64


def bucket_of(path):
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


class Store:
    """Tables below one folder, of any file system that Spark reads; a reader keeps the version it began with until the next one is
    written twice over. Driver and executors must share the folder.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._at(self.path).getFileSystem(self._conf).mkdirs(self._at(self.path))
        self._meta = f"{self.path}/meta.json"

    def _at(self, path: str):
        # a path without scheme is one of the driver's own file system, as it always was
        return self._hadoop.Path(path if "://" in path or path.startswith("file:") else f"file:{path}")

    def meta(self) -> dict:
        at = self._at(self._meta)
        fs = at.getFileSystem(self._conf)
        if not fs.exists(at):
            return {}
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return {}
        finally:
            stream.close()

    def set_meta(self, **values) -> None:
        """Change some values; the file is replaced in one step, so a reader sees the old or the new one."""
        part, at = self._at(f"{self._meta}.{uuid.uuid4().hex}"), self._at(self._meta)
        stream = part.getFileSystem(self._conf).create(part, True)
        stream.write(bytearray(json.dumps(self.meta() | values).encode()))
        stream.close()
        rename = getattr(self._hadoop, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self._hadoop.FileContext.getFileContext(at.toUri(), self._conf).rename(part, at, how)

    def _folder(self, name: str) -> str:
        return self._at(f"{self.path}/{name}").toString()

    def buckets(self, files: DataFrame) -> set[int]:
        """The buckets of ``files`` (path), BUCKETS at most."""
        return {r["b"] for r in files.select(bucket_of(F.col("path")).alias("b")).distinct().collect()}

    def read(self, name: str, only: set[int] | None = None) -> DataFrame:
        """A table, or its buckets in ``only``."""
        at = self.meta().get("tables", {}).get(name, {})
        folders = [self._folder(x) for b, x in sorted(at.items()) if only is None or int(b) in only]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMAS[name])

    def _put(self, name: str, df: DataFrame) -> dict[str, str]:
        """Write ``df`` below a new folder: bucket to folder."""
        new = f"{name}-{uuid.uuid4().hex[:12]}"
        cols = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        if name not in PATHS:
            df.select(*cols).write.option("compression", "zstd").parquet(self._folder(new))
            return {"0": new}
        # each bucket's rows together, in files of a size that adaptive execution sees fit
        rows = df.select(*cols, bucket_of(F.col(PATHS[name])).alias("bucket"))
        rows = self.spark.sql("SELECT /*+ REBALANCE(bucket) */ * FROM {rows}", rows=rows)
        rows.write.partitionBy("bucket").option("compression", "zstd").parquet(self._folder(new))
        at = self._at(f"{self.path}/{new}")
        found = [x.getPath().getName() for x in at.getFileSystem(self._conf).listStatus(at)]
        return {x.partition("=")[2]: f"{new}/{x}" for x in found if x.startswith("bucket=")}

    def write(self, only: dict[str, set[int]] | None = None, **tables: DataFrame) -> None:
        """Write each table, or the buckets of it that ``only`` names, and switch to all of them at once.

        Where only some buckets are written, the rows given must be those of these buckets.
        """
        meta = self.meta()
        before, dropped = meta.get("tables", {}), meta.get("drop") or []
        now, stale = dict(before), []
        for name, df in tables.items():
            old = before.get(name, {})
            gone = set(old) if not only or name not in only else {str(b) for b in only[name]} & set(old)
            now[name] = {b: x for b, x in old.items() if b not in gone} | self._put(name, df)
            stale += [old[b] for b in gone]
        self.set_meta(tables=now, drop=stale)
        for folder in dropped:
            at = self._at(f"{self.path}/{folder}")
            at.getFileSystem(self._conf).delete(at, True)
