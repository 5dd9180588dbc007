"""Files nobody wrote by hand: generated, compiled, bundled, minified, vendored, or data under a code extension."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folders that hold other people's code, one folder for each library below them.
VENDOR_DIRS = (
    "node_modules vendor _vendor vendors third_party third-party thirdparty 3rdparty external extern deps godeps _workspace upstream "
    "bower_components jspm_packages site-packages pods carthage"
).split()

#: Folders that generators and bundlers write to.
OUTPUT_DIRS = "generated __generated__ _generated gen generated-sources generated-src autogen".split()

#: Endings of names that tools give to their output, lockfiles among them.
OUTPUT_NAMES = (
    r"[.\-_]min\.(js|mjs|cjs|css)$", r"[.\-]bundle\.(js|mjs)$", r"[.\-]chunk\.js$", r"\.map$", r"\.pb\.(go|ts|js|cc|h|py)$", r"_pb2(_grpc)?\.pyi?$",
    r"_pb\.(js|ts)$", r"\.pb\.gw\.go$", r"_(string|easyjson|ffjson)\.go$", r"^mock_.*\.go$", r"bindata\.go$", r"^buildconfig\.java$", r"\.freezed\.dart$", r"\.(gen|generated|codegen|g)\.[a-z]+$", r"_(generated|gen|bindgen)\.(py|go|rs|java|js|ts)$", r"^zz_generated\.",
    r"(outerclass|grpc)\.java$", r"\.designer\.cs$", r"^(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|cargo\.lock|go\.sum|composer\.lock)$",
)

#: What starts a notice, found by one automaton; the expression beside it tells a notice from prose about one.
NOTICES: list[tuple[str, str, str]] = [
    ("code generated", "generated", r"code generated (by|from|with) .*do not (edit|modify)"),
    ("generated by", "generated", r"(file|code|module|source|class)\b.{0,30}\b(is|was|has been)?\s*(auto\w*[ -]?)?generated by"),
    ("automatically generated", "generated", r"(file|code|module|source|class)\b.{0,30} automatically generated|^\W*automatically generated"),
    ("autogenerated", "generated", r"^\W*autogenerated\b|autogenerated (file|code)|file is autogenerated"),
    ("auto-generated", "generated", r"<auto-generated|auto-generated (file|code|by)|(file|code) (is|was) auto-generated"),
    ("@generated", "generated", r"^\W*@generated\s*($|by\b|from\b|signedsource)"),
    ("generated from", "generated", r"^\W*generated from .*(edit|do not|regenerate)|(file|code) (is|was)? ?generated from"),
    ("output of", "generated", r"(is|are) the output of .*(regenerate|never|do not)"),
    ("do not modify", "generated", r"do not modify\W+(emitted|generated|produced)"),
    ("emitted from", "generated", r"^\W*(do not .*)?emitted from .* by "),
    ("will be overwritten", "generated", r"changes .*will be (overwritten|lost)"),
    ("vendored copy", "vendored", r"vendored copy of"),
    ("from upstream", "vendored", r"(copied|taken|imported|vendored)\b.{0,20} from upstream"),
    ("used under the", "vendored", r"(\(c\)|copyright|imported|copied|taken)\W.*used under the .*licen[sc]e"),
    ("imported from", "vendored", r"^\W*imported from (the |a )?(release|tarball|archive|distribution)\b"),
    ("@license", "vendored", r"@license\b.*\(c\)|@license\b.*authors"),
    ("@preserve", "vendored", r"@preserve\b.*\(c\)"),
]

#: What compilers and bundlers leave in their output, strings written as ``s`` and comments removed.
COMPILED = [
    r"\bvar __\w+ = \(this && this\.__\w+\) \|\|", r"\b__webpack_(require|modules|exports)__", r"^\s*exports\.\w+ = (exports\.\w+ = )*void 0;",
    r"^\s*Object\.defineProperty\(exports, s\b", r"\bparcelRequire\b", r"\bSystem\.register\(\[",
]
_SOURCE_MAP = re.compile(r"^//[#@] sourceMappingURL=\S+\s*\Z", re.M)

_LITERAL = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`|-?\b\d[\w.]*|[\[\](){},:;=]')
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')
_COMMENT_START = re.compile(r"\s*(//|#|/?\*|--|<!--|\"\"\"|''')")
_BLOCK = re.compile(r"/\*.*?\*/", re.S)
_LINE_COMMENT = {"py": re.compile(r"(?m)^\s*#.*$")}
_SLASHES = re.compile(r"(?m)^\s*//.*$")
_MARKS = re.compile(r"^(//+!?|#+|/\*+!?|\*+|--|<!--|\"\"\"|\'\'\')\s*")

_QUOTES = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_SLASHED = r"//[^\n]*|(?P<block>/\*.*?\*/)|"
#: What can span lines in a language, ``block`` comments and ``text`` in strings; the rest is there to be skipped.
_SPANNING = {
    kind: re.compile(rx, re.S)
    for kind, rx in {
        "py": r"#[^\n]*|(?<=[^\s])[ \t]*[rRbBuUfFtT]{0,2}(?P<text>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?''')|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|" + _QUOTES,
        "java": _SLASHED + r"(?P<text>\"\"\"(?:[^\\]|\\.)*?\"\"\")|" + _QUOTES,
        "rs": _SLASHED + r"(?P<text>\br(?P<n>#*)\".*?\"(?P=n)|\"(?:[^\"\\]|\\.)*\")|'(?:[^'\\\n]|\\[^\n']+|\\')'",
        "go": _SLASHED + r"(?P<text>`[^`]*`)|" + _QUOTES,
        "": _SLASHED + r"(?P<text>`(?:[^`\\]|\\.)*`)|" + _QUOTES,
    }.items()
}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, (phrase, _, _) in enumerate(NOTICES):
        a.add_word(phrase, i)
    a.make_automaton()
    return a, [(kind, re.compile(rx)) for _, kind, rx in NOTICES], [re.compile(x, re.M) for x in COMPILED]


@lru_cache(maxsize=1)
def _hints() -> tuple[str, ...]:
    """A word of each phrase; a text without any of them holds no notice, however its white space is laid out."""
    return tuple({max(phrase.split(), key=len) for phrase, _, _ in NOTICES})


def _spanning(text: str, ext: str) -> list[tuple[int, int, str]]:
    """(from, to, block or text) of the comments and strings that span lines."""
    found = _SPANNING.get(ext, _SPANNING[""]).finditer(text)
    spans = ((*m.span(kind), kind) for m in found for kind in ("block", "text") if m.groupdict().get(kind))
    return [x for x in spans if "\n" in text[x[0] : x[1]]]


def notice(text: str, ext: str = "") -> str | None:
    """The kind of the first notice in the comments, wherever it stands; each comment line is taken with white space evened
    and letters lowered. Lines of a string that spans lines are no comments, whatever they begin with."""
    low = text.lower()
    if not any(h in low for h in _hints()):
        return None
    automaton, kinds, _ = _automaton()
    blocks, spans, end = "/*" in text, None, 0
    for line in text.split("\n"):
        begin, end = end, end + len(line) + 1
        marked = _COMMENT_START.match(line)
        if not marked and not blocks:
            continue
        flat = _MARKS.sub("", re.sub(r"\s+([>;:.,])", r"\1", " ".join(line.lower().split())))
        for _, i in automaton.iter(flat):
            kind, rx = kinds[i]
            if rx.search(flat):
                spans = _spanning(text, ext) if spans is None else spans
                at = begin + len(line) - len(line.lstrip())
                within = next((k for a, z, k in spans if a < at < z), None)
                if within != "text" if marked else within == "block":
                    return kind
    return None


def shape(text: str, ext: str) -> str | None:
    """compiled, data, table or minified, by the form of the text alone; None where it looks hand-written."""
    _, _, compiled = _automaton()
    code = _LINE_COMMENT.get(ext, _SLASHES).sub("", _BLOCK.sub("", text))
    bare = _STRING.sub("s", code)
    if _SOURCE_MAP.search(text) or any(rx.search(bare) for rx in compiled):
        return "compiled"
    solid = "".join(code.split())
    if len(solid) < 200:
        return None
    literals = _LITERAL.findall(code)
    held = sum(len("".join(x.split())) for x in literals)
    strings = _STRING.findall(code)
    if held >= 0.8 * len(solid) or max(map(len, strings), default=0) >= 0.6 * len(solid):
        return "data"
    lines = [x for x in code.splitlines() if x.strip()]
    forms = Counter(re.sub(r"\d+", "0", _STRING.sub("s", x.strip())) for x in lines)
    if len(lines) >= 20 and forms.most_common(1)[0][1] >= 0.7 * len(lines):
        return "table"
    if ext in ("js", "mjs", "cjs", "jsx", "ts", "tsx", "mts", "css"):
        gaps = sum(c.isspace() for c in bare)
        if len(bare) >= 200 and gaps <= 0.05 * len(bare) and len(bare) >= 100 * max(1, len(lines)):
            return "minified"
    return None


def _judge(shapes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said, formed = [], []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = (text or "").lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
                ext = path.rpartition(".")[2].lower()
                said.append(notice(text, ext))
                formed.append(shape(text, ext) if shapes else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string()), pa.array(formed, pa.string())], names=["path", "notice", "shape"])

    return run


def by_path(path):
    """vendored or generated by the place and the name alone, else null."""
    low = F.lower(path)
    dirs = F.split(low, "/")
    # a vendor folder has a library's folder below it; one that holds files alone is somebody's own
    libs = F.slice(dirs, 1, F.greatest(F.size(dirs) - 2, F.lit(0)))
    own = F.slice(dirs, 1, F.greatest(F.size(dirs) - 1, F.lit(0)))
    name = F.element_at(dirs, -1)
    vendored = F.arrays_overlap(libs, F.array(*map(F.lit, VENDOR_DIRS)))
    generated = F.arrays_overlap(own, F.array(*map(F.lit, OUTPUT_DIRS))) | name.rlike("|".join(OUTPUT_NAMES))
    return F.when(vendored, "vendored").when(generated, "generated")


def known_copies(texts: DataFrame, known: DataFrame, words: int = 5, least: float = 0.6) -> DataFrame:
    """(path, lib_id, kept): files that keep at least ``least`` of the distinct ``words``-word runs of a known library file.

    ``least`` allows for the small changes of an unmarked copy; what is added around it doesn't matter. Runs that many
    files share are joined like any other; the side of the known files is broadcast if its size allows.
    """

    def runs(df, id_col, text_col):
        w = df.select(id_col, F.regexp_extract_all(F.col(text_col), F.lit(r"[\w$]+"), F.lit(0)).alias("w")).where(F.size("w") >= words)
        at = F.when(F.size("w") >= words, F.sequence(F.lit(1), F.size("w") - (words - 1)))
        return w.select(id_col, F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice("w", i, words)))).alias("runs"))

    # the outer form, since for the inner one the optimizer derives a filter that computes the runs once more
    library = runs(known, "lib_id", "content").select("lib_id", F.size("runs").alias("of"), F.explode_outer("runs").alias("run"))
    mine = runs(texts, "path", "content").select("path", F.explode_outer("runs").alias("run"))
    return (
        mine.join(library, "run")
        .groupBy("path", "lib_id")
        .agg((F.count(F.lit(1)) / F.first("of")).alias("kept"))
        .where(F.col("kept") >= least)
    )


def _listed(files: DataFrame) -> DataFrame:
    """(path, language, size, place): every path that may be a case, as it was last scanned."""
    return (
        files.where(F.col("path").isNotNull() & ~F.lower("path").rlike(r"\.(md|mdx|markdown)$"))
        .groupBy("path")
        .agg(F.max_by(F.struct("language", "size"), F.struct("indexed_at", "size")).alias("f"))
        .select("path", "f.language", "f.size", by_path(F.col("path")).alias("place"))
    )


def _judged(texts: DataFrame, shapes: bool) -> DataFrame:
    return texts.select("path", "content").where(F.col("path").isNotNull()).mapInArrow(_judge(shapes), "path string, notice string, shape string")


def noticed_files(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, language, size, reason) of the files that the automaton over comments and the path rules find by themselves; reason is
    vendored or generated. Rows, nulls and Markdown as in ``classify_files``."""
    return (
        _listed(files).join(_judged(texts, shapes=False), "path", "left")
        .withColumn("reason", F.coalesce("place", "notice")).where(F.col("reason").isNotNull())
        .groupBy("path", "language", "size").agg(F.min("reason").alias("reason"))
    )


def classify_files(files: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """(path, language, size, reason) of every file that isn't hand-written; the first reason that holds of: vendored,
    generated (place or name), vendored, generated (notice), copied, compiled, data, table, minified.

    A path listed several times counts once (last scan). Files without text are judged by their path; Markdown never is a
    case. Null paths are left out.
    """
    copied = known_copies(texts, known).groupBy("path").agg(F.lit("copied").alias("copied"))
    return (
        _listed(files).join(_judged(texts, shapes=True), "path", "left")
        .join(copied, "path", "left")
        .select("path", "language", "size", F.coalesce("place", "notice", "copied", "shape").alias("reason"))
        .where(F.col("reason").isNotNull())
        .groupBy("path", "language", "size").agg(F.min("reason").alias("reason"))
    )
