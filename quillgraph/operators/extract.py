"""Symbols, imports, call sites, routes and assets out of source texts, as relations.

Texts are parsed in Arrow batches by ``operators.reader``; routes and assets are expressions of the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import node_id
from ..session import materialise
from ..sources.scan import TEXT_ASSETS, asset_kind, detect_language, extension, is_asset
from .reader import parse_text

# routes, in the JVM ------------------------------------------------------------------------------------------------------

#: The objects whose methods declare routes, those methods, the methods of decorators, the words of annotations.
ROUTE_OBJECTS = "app router api server route"
ROUTE_METHODS = "get post put patch delete options head all"
DECORATOR_METHODS = "get post put patch delete route"
ANNOTATIONS = "Get Post Put Patch Delete Request"
#: The words before the name of a handler on a following line.
HANDLER_WORDS = "def function fn"


def _any(words: str) -> str:
    return words.replace(" ", "|")


def _quoted(quotes: str) -> str:
    return f"[{quotes}]([^{quotes}]+)[{quotes}]"


#: An object's method with a path, a decorator with a path, an annotation with a path; method and path are the groups.
ROUTE_PATTERNS = (
    rf"\b(?:{_any(ROUTE_OBJECTS)})\.({_any(ROUTE_METHODS)})\s*\(\s*" + _quoted("'\"`"),
    rf"@\w+\.({_any(DECORATOR_METHODS)})\s*\(\s*" + _quoted("'\"`"),
    rf"@({_any(ANNOTATIONS)})Mapping\s*\(\s*(?:value\s*=\s*)?" + _quoted("'\""),
)


def _handler(line, below: list):
    """The last name of the line's last argument, else the first function declared on the lines below."""
    argument = F.regexp_extract(F.rtrim(line), r",\s*([^\s,()]+)\s*\)?\s*;?$", 1)
    last = F.substring_index(argument, ".", -1)
    named = F.when(argument.rlike(r"^[\p{Alpha}_$][\w$.]*$") & (last != ""), last)
    declared = [F.nullif(F.regexp_extract(b, rf"(?:{_any(HANDLER_WORDS)})\s+([\p{{Alpha}}_$][\w$]*)", 1), F.lit("")) for b in below]
    return F.coalesce(named, *declared)


def route_lines(texts: DataFrame) -> DataFrame:
    """(path, line, name, method, route, handler, signature) of every route in ``texts`` (path, text).

    The handler is the last name before the closing bracket, without its object, or the first function named on the three lines
    below. Lines without a route are dropped before the window, but for the three that follow one.
    """
    lines = texts.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "text"))
    below = [F.lead("text", i).over(Window.partitionBy("path").orderBy("pos")) for i in (1, 2, 3)]
    some = "|".join(f"(?:{p})" for p in ROUTE_PATTERNS)
    # only files that hold a route at all go into the window
    with_routes = texts.where(F.col("text").rlike(some)).select("path")
    near = lines.join(with_routes, "path", "left_semi").select("path", "pos", "text", *[b.alias(f"b{i}") for i, b in enumerate(below)])
    handler = _handler(F.col("text"), [F.col(f"b{i}") for i in range(3)])
    found = F.array(*[F.struct(F.upper(F.regexp_extract("text", p, 1)).alias("method"), F.regexp_extract("text", p, 2).alias("route")) for p in ROUTE_PATTERNS])
    hits = near.where(F.col("text").rlike(some)).select("path", (F.col("pos") + 1).alias("line"), handler.alias("handler"), F.substring(F.trim("text"), 1, 200).alias("signature"), F.inline(found))
    return hits.where("method <> ''").select("path", "line", F.concat_ws(" ", "method", "route").alias("name"), "method", "route", "handler", "signature")


def route_nodes(texts: DataFrame) -> DataFrame:
    r = route_lines(texts)
    meta = F.to_json(F.struct("method", F.col("route").alias("path"), F.col("handler").alias("handlerName")))
    kind = F.lit("route")
    return r.select(
        node_id(F.col("path"), kind, F.col("name"), F.col("line")).alias("id"), kind.alias("kind"), "name", F.col("path").alias("file_path"), detect_language(F.col("path")).alias("language"),
        F.col("line").alias("start_line"), F.col("line").alias("end_line"), "signature", F.lit(None).cast("string").alias("snippet"), meta.alias("meta"),
    )


def asset_nodes(texts: DataFrame) -> DataFrame:
    """Asset files of ``texts`` as nodes: name and path alike, a preview of 4000 characters for text assets."""
    path, kind = F.col("path"), F.lit("asset")
    preview = F.when(extension(path).isin(*TEXT_ASSETS), F.substring("text", 1, 4000))
    return texts.where(is_asset(path)).select(
        node_id(path, kind, path, F.lit(0)).alias("id"), kind.alias("kind"), path.alias("name"), path.alias("file_path"), detect_language(path).alias("language"), F.lit(1).alias("start_line"),
        F.size(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("end_line"), F.concat(F.lit("["), asset_kind(path), F.lit("] "), path).alias("signature"), preview.alias("snippet"),
        F.to_json(F.struct(asset_kind(path).alias("assetKind"))).alias("meta"),
    )


_NODE = "id:string,kind:string,name:string,file_path:string,language:string,start_line:int,end_line:int,signature:string,snippet:string,meta:string"
_EDGE = "id:string,kind:string,from_id:string,to_id:string,confidence:double,file_path:string"
_SITE = "file_path:string,caller_id:string,callee_name:string,receiver:string,line:int"


def _struct(spec: str) -> pa.StructType:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    return pa.struct([(n, kinds[t]) for n, t in (x.split(":") for x in spec.split(","))])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.list_(_struct(s)) for s in (_NODE, _EDGE, _SITE)]
    for b in batches:
        cols: list[list] = [[], [], []]
        for path, language, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            p = parse_text(path, language, text or "")
            for col, spec, rows in zip(cols, (_NODE, _EDGE, _SITE), (p.nodes, p.edges, p.sites)):
                names = [x.split(":")[0] for x in spec.split(",")]
                col.append([dict(zip(names, r)) for r in rows])
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["path", "nodes", "edges", "call_sites"])


def parse_files(texts: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges and call_sites of ``texts`` (path, text): assets as name-only nodes, code by its reader, routes by line. Null
    paths are left out, a null text is an empty one, ids that occur twice are kept once.

    Every file is parsed once, into a stage that the three relations read. Rows are spread over the tasks first, since a few
    splits may hold most of the code, and a text is some hundred times dearer to parse than to move.
    """
    known = texts.where(F.col("path").isNotNull()).select("path", F.coalesce("text", F.lit("")).alias("text"))
    code = known.where(~is_asset(F.col("path")))
    spread = code.select("path", detect_language(F.col("path")).alias("language"), "text").repartition("path")
    parsed = materialise(spread.mapInArrow(_parse, f"path string, nodes array<struct<{_NODE}>>, edges array<struct<{_EDGE}>>, call_sites array<struct<{_SITE}>>"))
    routes = route_nodes(code)
    nodes = parsed.select(F.inline("nodes")).unionByName(routes).unionByName(asset_nodes(known)).dropDuplicates(["id"])
    held = routes.select(node_id(F.col("file_path"), F.lit("file"), F.col("file_path"), F.lit(0)).alias("from_id"), F.col("id").alias("to_id"), "file_path")
    contains = held.select(F.substring(F.sha1(F.concat(F.lit("contains"), "from_id", "to_id", F.char(F.lit(0)))), 1, 20).alias("id"), F.lit("contains").alias("kind"), "from_id", "to_id", F.lit(1.0).alias("confidence"), "file_path")
    edges = parsed.select(F.inline("edges")).unionByName(contains).dropDuplicates(["id"])
    return {"nodes": nodes, "edges": edges, "call_sites": parsed.select(F.inline("call_sites"))}


def with_parent(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("parent", F.get_json_object("meta", "$.parent"))
