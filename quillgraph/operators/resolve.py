"""Cross-file resolution: imports to files, call sites to symbols by a priority cascade, handlers, supertypes, assets.

The cascade never joins call sites with all symbols of a name. Symbols are summarised first, by (file, name), by
(file, name, parent), by qualified name and by name, each summary holding a count and at most three targets; a heavy name
such as ``get`` costs one row on that side, and call sites are reduced to distinct (caller, callee, receiver) before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.ids import documents_edge_id, edge_id
from ..session import materialise
from .skew import salted_left_join
from .tables import META, order_key

#: What an import specifier may leave out, in the order tried.
SUFFIXES = ["", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".kt", ".rb", ".php", ".cs", ".swift", ".scala"]


def _normal_path(path: Column) -> Column:
    """POSIX normalisation of a relative path: empty and ``.`` parts dropped, ``x/..`` folded."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    fold = lambda acc, p: F.when(
        (p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    ).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast(ArrayType(StringType())), fold), "/")


def import_candidates(file_path: Column, spec: Column) -> Column:
    """The paths a specifier may mean, in the order tried."""
    directory = F.when(file_path.contains("/"), F.regexp_replace(file_path, r"/[^/]*$", "")).otherwise(F.lit(""))
    every = F.array(*map(F.lit, SUFFIXES))
    some = F.array(*map(F.lit, SUFFIXES[1:]))
    relative = _normal_path(F.concat_ws("/", directory, spec))
    dotted = F.replace(spec, F.lit("."), F.lit("/"))
    add = lambda base, suffixes: F.transform(suffixes, lambda s: F.concat(base, s))
    return (
        F.when(spec.startswith("."), F.concat(add(relative, every), add(F.concat(relative, F.lit("/index")), some)))
        .when(spec.contains("/"), add(_normal_path(spec), every))
        .when(spec.contains("."), F.concat(add(dotted, every), add(_normal_path(F.concat_ws("/", directory, dotted)), every)))
        .otherwise(F.concat(add(relative, some), add(spec, some)))
    )


def resolve_imports(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, spec, target): each import with the first candidate path that is a file; unresolved ones left out."""
    specs = nodes.where("kind = 'import'").select("file_path", F.col("name").alias("spec")).distinct()
    tried = specs.select("file_path", "spec", F.posexplode(import_candidates(F.col("file_path"), F.col("spec"))).alias("nth", "path"))
    hits = tried.join(files.select("path").distinct(), "path")
    return hits.groupBy("file_path", "spec").agg(F.min(F.struct("nth", "path"))["path"].alias("target"))


def _in_files(funcs: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, firsts): the number of symbols and the ids of the first three by line and id. The keys name a file among others,
    so a group is no larger than what one file declares."""
    firsts = F.transform(F.slice(F.array_sort(F.collect_list(order_key())), 1, 3), lambda s: s["id"])
    return funcs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), firsts.alias("firsts"))


def _named(funcs: DataFrame) -> DataFrame:
    """(name, n, first, firsts): the symbols of each name in all files, counted; the first one, and all of them where they are at most
    three (else null). Names like ``get`` are counted and dropped before anything is brought together."""
    counted = funcs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(order_key())["id"].alias("first"))
    rare = counted.where("n <= 3").select("name")
    listed = funcs.join(rare, "name", "left_semi").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(order_key())), lambda s: s["id"]).alias("firsts"))
    return counted.join(listed, "name", "left")


def receiver_type(text: Column, receiver: Column) -> Column:
    """The type a receiver has by the caller's text: assigned ``new T``, declared ``T receiver =``, or ``receiver: T``.

    Fixed values: the three expressions, since what they find decides a tier.
    """
    name = r"([A-Za-z_$][\w$]*)"
    escaped = F.regexp_replace(receiver, r"([.*+?^${}()|\[\]\\])", r"\\$1")

    def hit(before: str, after: str) -> Column:
        pattern = F.concat(F.lit(before), escaped, F.lit(after))
        return F.call_function("regexp_extract", text, pattern, F.lit(1))

    found = [
        hit(r"\b", rf"\s*(?::\s*[A-Za-z_$][\w$]*)?\s*=\s*new\s+{name}"),
        hit(rf"\b{name}\s+", r"\s*="),
        hit(r"\b", rf"\s*:\s*{name}"),
    ]
    return F.coalesce(*[F.when(t.rlike("^[A-Z]"), t) for t in found])


def resolve_calls(sites: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, kind, from_id, to_id, confidence, file_path, tier): the call edges of ``sites``.

    The first tier that holds for a call site gives its targets: own class through this or self (1.0), the receiver's class
    (0.95), its inferred class (0.95), the only symbol of the file (0.95) or of the caller's class in it, up to three of the
    file (0.5), the only one of the imported files (0.9), up to three of them (0.6), the only one at all (0.8), two or three
    (0.4). Calls of oneself are dropped afterwards; of equal edges the one with the highest confidence stays.
    """
    funcs = nodes.where(F.col("kind").isin("function", "method")).select("id", "name", "file_path", "start_line", "parent")
    classes = nodes.where(F.col("kind").isin("class", "interface")).select(F.col("name").alias("receiver")).distinct()
    qualified = funcs.where("parent IS NOT NULL").groupBy(F.col("parent").alias("cls"), F.col("name").alias("callee")).agg(F.max(order_key())["id"].alias("target"))
    text = F.concat(F.coalesce("signature", F.lit("")), F.lit("\n"), F.coalesce("snippet", F.lit("")))
    callers = nodes.select(F.col("id").alias("caller"), F.col("file_path").alias("caller_file"), F.col("parent").alias("caller_class"), text.alias("text"))
    calls = sites.where("callee_name IS NOT NULL AND caller_id IS NOT NULL").select(F.col("caller_id").alias("caller"), F.col("callee_name").alias("callee"), "receiver").distinct()
    inferred = F.when(F.col("receiver").isNotNull(), receiver_type(F.col("text"), F.col("receiver")))
    calls = calls.join(callers, "caller").withColumn("inferred", inferred).drop("text")

    def by_class(cls: str, alias: str) -> DataFrame:
        return qualified.select(F.col("cls").alias(cls), "callee", F.col("target").alias(alias))

    in_file = _in_files(funcs, "file_path", "name")
    in_class = funcs.groupBy("file_path", "name", "parent").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("in_class")).where("n = 1").drop("n")
    named = _named(funcs).select(F.col("name").alias("callee"), F.col("n").alias("n_all"), F.col("firsts").alias("f_all"))
    reached = resolve_imports(nodes, files).select("file_path", "target").distinct()
    imported = (
        reached.join(in_file.select(F.col("file_path").alias("target"), F.col("name").alias("callee"), "n", "firsts"), "target")
        .groupBy(F.col("file_path").alias("caller_file"), "callee")
        .agg(F.sum("n").alias("n_imp"), F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("target", "firsts"))), lambda s: s["firsts"])), 1, 3).alias("f_imp"))
    )
    # a callee may be hot, so its join is salted; the joins on a class leave out the calls that have none, which otherwise all
    # meet under the null key
    calls = materialise(calls.withColumn("site", F.xxhash64("caller", "callee", F.coalesce("receiver", F.lit("\0")))))
    wide = salted_left_join(calls, named, "callee", salt_by=F.col("site")).where("n_all IS NOT NULL")
    typed = calls.where("receiver IS NOT NULL").select("receiver").distinct().join(classes, "receiver", "left_semi")
    t1 = calls.where("receiver IN ('this', 'self') AND caller_class IS NOT NULL").join(by_class("caller_class", "t1"), ["caller_class", "callee"])
    t2 = calls.join(typed, "receiver", "left_semi").join(by_class("receiver", "t2"), ["receiver", "callee"])
    t3 = calls.where("inferred IS NOT NULL").join(by_class("inferred", "t3"), ["inferred", "callee"])
    once = ["caller", "callee", "receiver"]
    no = F.lit(None).cast("string")
    by_type = (
        t1.select(*once, "t1", no.alias("t2"), no.alias("t3"))
        .unionByName(t2.select(*once, no.alias("t1"), "t2", no.alias("t3")))
        .unionByName(t3.select(*once, no.alias("t1"), no.alias("t2"), "t3"))
        .groupBy(*once).agg(*[F.max(t).alias(t) for t in ("t1", "t2", "t3")])
    )
    here = in_file.select(F.col("file_path").alias("caller_file"), F.col("name").alias("callee"), F.col("n").alias("n_file"), F.col("firsts").alias("f_file"))
    wide = wide.join(by_type, once, "left").join(here, ["caller_file", "callee"], "left").join(imported, ["caller_file", "callee"], "left")
    inc = in_class.select(F.col("file_path").alias("_f"), F.col("name").alias("_n"), F.col("parent").alias("_p"), "in_class")
    wide = wide.join(inc, (F.col("caller_file") == F.col("_f")) & (F.col("callee") == F.col("_n")) & F.col("caller_class").eqNullSafe(F.col("_p")), "left")
    tiers = [
        ("1", F.col("t1").isNotNull(), F.array("t1"), 1.0),
        ("2", F.col("t2").isNotNull(), F.array("t2"), 0.95),
        ("3", F.col("t3").isNotNull(), F.array("t3"), 0.95),
        ("4a", F.col("n_file") == 1, F.col("f_file"), 0.95),
        ("4b", (F.col("n_file") > 1) & F.col("in_class").isNotNull(), F.array("in_class"), 0.95),
        ("4c", F.col("n_file") > 1, F.col("f_file"), 0.5),
        ("5a", F.col("n_imp") == 1, F.col("f_imp"), 0.9),
        ("5b", F.col("n_imp") > 1, F.col("f_imp"), 0.6),
        ("6a", F.col("n_all") == 1, F.col("f_all"), 0.8),
        ("6b", F.col("n_all") <= 3, F.col("f_all"), 0.4),
    ]
    pick = F.lit(None).cast("struct<tier:string,targets:array<string>,confidence:double>")
    for name, when, targets, conf in reversed(tiers):
        pick = F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("tier"), targets.alias("targets"), F.lit(conf).alias("confidence"))).otherwise(pick)
    chosen = wide.withColumn("pick", pick).where("pick IS NOT NULL")
    edges = chosen.select(F.col("caller").alias("from_id"), F.explode("pick.targets").alias("to_id"), "pick.confidence", "pick.tier", F.col("caller_file").alias("file_path")).where("from_id <> to_id")
    best = edges.groupBy("from_id", "to_id").agg(F.max(F.struct("confidence", "tier", "file_path")).alias("b"))
    kind = F.lit("calls")
    return best.select(edge_id(kind, F.col("from_id"), F.col("to_id")).alias("id"), kind.alias("kind"), "from_id", "to_id", "b.confidence", "b.file_path", "b.tier")


def resolve_handlers(nodes: DataFrame) -> DataFrame:
    """(id, kind, from_id, to_id, confidence, file_path): routes to the function their handler names: the only one in the file
    (0.95), the only one at all (0.85), else the first, of the file if it has any (0.5)."""
    wanted = nodes.where("kind = 'route'").select(F.col("id").alias("from_id"), "file_path", F.from_json("meta", META)["handlerName"].alias("name")).where("name IS NOT NULL")
    funcs = nodes.where(F.col("kind").isin("function", "method")).select("id", "name", "file_path", "start_line")
    here = funcs.groupBy("file_path", "name").agg(F.count(F.lit(1)).alias("n_here"), F.min(order_key())["id"].alias("here"))
    named = funcs.groupBy("name").agg(F.count(F.lit(1)).alias("n_all"), F.min(order_key())["id"].alias("first"))
    joined = wanted.join(named, "name").join(here, ["file_path", "name"], "left")
    conf = F.when(F.col("n_here") == 1, 0.95).when(F.col("n_all") == 1, 0.85).otherwise(0.5)
    kind = F.lit("handles")
    out = joined.select(kind.alias("kind"), "from_id", F.coalesce("here", "first").alias("to_id"), conf.alias("confidence"), "file_path")
    return out.select(edge_id(kind, F.col("from_id"), F.col("to_id")).alias("id"), "*")


def resolve_supers(nodes: DataFrame) -> DataFrame:
    """(id, kind, from_id, to_id, confidence, file_path): types to their named supertypes, implements where that is an interface;
    0.95 for a name only one type has, else 0.6 for the first. A type isn't its own supertype."""
    types = nodes.where(F.col("kind").isin("class", "interface"))
    names = types.select(F.col("id").alias("from_id"), "file_path", F.explode(F.from_json("meta", META)["supers"]).alias("name")).distinct()
    target = types.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order_key().alias("ord"), "kind")).alias("t"))
    kind = F.when(F.col("t.kind") == "interface", "implements").otherwise("extends")
    out = names.join(target, "name").select(
        kind.alias("kind"), "from_id", F.col("t.ord.id").alias("to_id"), F.when(F.col("n") == 1, 0.95).otherwise(0.6).alias("confidence"), "file_path"
    ).where("from_id <> to_id")
    return out.select(edge_id(F.col("kind"), F.col("from_id"), F.col("to_id")).alias("id"), "*").dropDuplicates(["id"])


#: The kinds of edges that resolution makes.
RESOLVED = ("calls", "handles", "extends", "implements")


def resolve_all(sites: DataFrame, nodes: DataFrame, files: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """All resolved edges, or those of the files of ``only`` (file_path), whose ``sites`` then suffice."""
    rest = resolve_handlers(nodes).unionByName(resolve_supers(nodes))
    if only is not None:
        rest = rest.join(only, "file_path", "left_semi").select(*rest.columns)
    return resolve_calls(sites, nodes, files).drop("tier").unionByName(rest)


def affected_files(changed: DataFrame, before: DataFrame, after: DataFrame, sites: DataFrame) -> DataFrame:
    """(path): the changed files, those whose calls, receivers, handlers or supertypes name a symbol that they had or have, and those
    with an import that may mean one of them."""
    changed = changed.select("path").distinct()
    names = before.select("name", "file_path").unionByName(after.select("name", "file_path")).join(changed.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select("name").distinct()
    meta = F.from_json("meta", META)
    users = (
        sites.select(F.explode(F.array("callee_name", "receiver")).alias("name"), F.col("file_path").alias("path"))
        .unionByName(after.where("kind = 'route'").select(meta["handlerName"].alias("name"), F.col("file_path").alias("path")))
        .unionByName(after.select(F.explode(meta["supers"]).alias("name"), F.col("file_path").alias("path")))
    )
    specs = after.where("kind = 'import'").select("file_path", F.col("name").alias("spec")).distinct()
    tried = specs.select(F.col("file_path").alias("importer"), F.explode(import_candidates(F.col("file_path"), F.col("spec"))).alias("path"))
    importers = tried.join(changed, "path", "left_semi").select(F.col("importer").alias("path"))
    return users.join(names, "name", "left_semi").select("path").union(changed).union(importers).distinct()


def resolve_incremental(stored: DataFrame, affected: DataFrame, after: DataFrame, sites: DataFrame, files: DataFrame) -> DataFrame:
    """``stored`` with the resolved edges of the ``affected`` files (path) computed anew; equal to resolving everything."""
    hit = affected.withColumnRenamed("path", "file_path")
    resolved = F.col("kind").isin(*RESOLVED)
    keep = stored.where(~resolved).unionByName(stored.where(resolved).join(hit, "file_path", "left_anti").select(*stored.columns))
    fresh = resolve_all(sites.join(hit, "file_path", "left_semi"), after, files, hit)
    return keep.unionByName(fresh.select(*stored.columns))


def link_assets(assets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, kind, from_id, to_id, confidence, file_path): assets (id, file_path, text) to every node that bears the exact name of a
    symbol the text mentions as a word in any case; names of more than three letters, one spelling for each word."""
    words = F.filter(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9_]+")), lambda w: F.length(w) > 3)
    mention = assets.select(F.col("id").alias("from_id"), "file_path", F.explode(words).alias("word"))
    symbols = nodes.where(F.col("kind").isin("function", "method", "class", "interface") & (F.length("name") > 3))
    spelling = symbols.groupBy(F.lower("name").alias("word")).agg(F.max_by("name", order_key()).alias("name"))
    target = nodes.select("name", F.col("id").alias("to_id"))
    linked = mention.join(spelling, "word").join(target, "name").where("from_id <> to_id").select("from_id", "to_id", "file_path").distinct()
    return linked.select(
        documents_edge_id(F.col("from_id"), F.col("to_id")).alias("id"), F.lit("documents").alias("kind"), "from_id", "to_id", F.lit(0.7).alias("confidence"), "file_path"
    )
