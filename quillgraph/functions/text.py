"""Text measures and features as built-in expressions."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate(text: Column) -> Column:
    """ceil((1.3 * words + chars / 4) / 2), words being runs without white space; 0 for null and empty texts."""
    words = F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1)))
    est = F.ceil((F.lit(1.3) * words + F.length(text) / 4) / 2)
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(est).cast("int")


def search_terms(text: Column, unicode: bool = True) -> Column:
    """Lower-cased terms of letters and digits; underscores and all other signs separate."""
    pattern = r"[\p{L}\p{N}]+" if unicode else r"[a-z0-9]+"
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def query_terms(query: str) -> list[list[str]]:
    """The phrases of a query: white-space words of more than one character, each the list of its terms."""
    import re

    words = re.sub(r"[^\w\s]", " ", query.lower()).split()
    return [t for w in words if len(w) > 1 and (t := re.findall(r"[^\W_]+", w))]


def embedding_text(name: Column, signature: Column, snippet: Column) -> Column:
    blank = F.lit("")
    return F.substring(F.concat_ws("\n", F.coalesce(name, blank), F.coalesce(signature, blank), F.coalesce(snippet, blank)), 1, 2000)


def embedding_tokens(text: Column, split_camel: bool = False) -> Column:
    t = F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2") if split_camel else text
    t = F.regexp_replace(F.regexp_replace(F.lower(t), r"[_\-.]", " "), r"[^a-z0-9_\s]", " ")
    return F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 1)


def fnv1a(feature: Column) -> Column:
    """32-bit FNV-1a of an ASCII string as a non-negative bigint."""
    codes = F.transform(F.filter(F.split(feature, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), step)


def hashed_features(text: Column, dim: int) -> Column:
    """array<struct<i int, w double>>: each token with weight 1 and each of its character trigrams with 0.5, signed and
    placed by FNV-1a."""
    tokens = embedding_tokens(text)
    grams = lambda t: F.when(
        F.length(t) > 2, F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.struct(F.substring(t, i, F.lit(3)).alias("f"), F.lit(0.5).alias("w")))
    ).otherwise(F.array().cast("array<struct<f:string,w:double>>"))
    features = F.flatten(F.transform(tokens, lambda t: F.concat(F.array(F.struct(t.alias("f"), F.lit(1.0).alias("w"))), grams(t))))

    def place(x: Column) -> Column:
        h = fnv1a(x["f"])
        size = F.when(h >= 2147483648, F.lit(4294967296) - h).otherwise(h)
        return F.struct((size % dim).cast("int").alias("i"), F.when(h % 2 == 0, x["w"]).otherwise(-x["w"]).alias("w"))

    return F.transform(features, place)


def local_embedding(text: Column, dim: int = 256) -> Column:
    """The text's hashed features as a unit ``array<float>``; zeros for a text without tokens. Vectorised in Arrow batches."""
    return _embedder(dim)(text)


@lru_cache(maxsize=8)
def _embedder(dim: int):
    import numpy as np

    def embed(texts: pd.Series) -> pd.Series:
        import re

        memo: dict[str, tuple[int, int]] = {}

        def place(f: str) -> tuple[int, int]:
            if f not in memo:
                h = 2166136261
                for c in f.encode("ascii", "ignore"):
                    h = ((h ^ c) * 16777619) & 0xFFFFFFFF
                memo[f] = ((4294967296 - h if h >= 2147483648 else h) % dim, 1 if h % 2 == 0 else -1)
            return memo[f]

        out = []
        for t in texts:
            vec = np.zeros(dim, dtype=np.float32)
            low = re.sub(r"[^a-z0-9_\s]", " ", re.sub(r"[_\-.]", " ", (t or "").lower()))
            for tok in low.split():
                if len(tok) > 1:
                    for f, w in [(tok, 1.0), *((tok[i : i + 3], 0.5) for i in range(len(tok) - 2))]:
                        i, sign = place(f)
                        vec[i] += np.float32(w * sign)
            norm = float(np.sqrt((vec.astype(np.float64) ** 2).sum()))
            out.append((vec / norm if norm else vec).tolist())
        return pd.Series(out)

    return F.pandas_udf(embed, "array<float>")


def cosine(a: Column, b: Column) -> Column:
    """Dot product over the shorter length; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def porter_stem(word: str) -> str:
    """The Porter stemmer (1980), for lower-case ASCII words; others come back as they are."""
    import re

    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    form = lambda s: "".join("v" if c in "aeiou" or (c == "y" and i and s[i - 1] not in "aeiou") else "c" for i, c in enumerate(s))
    measure = lambda s: len(re.findall("v+c+", form(s)))
    has_vowel = lambda s: "v" in form(s)
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and form(s)[-1] == "c"
    cvc = lambda s: form(s)[-3:] == "cvc" and s[-1] not in "wxy"
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    elif (w.endswith("ed") and has_vowel(w[:-2])) or (w.endswith("ing") and has_vowel(w[:-3])):
        w = w[:-2] if w.endswith("ed") else w[:-3]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif measure(w) == 1 and cvc(w):
            w += "e"
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for old, new in table:
            if w.endswith(old):
                w = w[: -len(old)] + new if measure(w[: -len(old)]) > 0 else w
                break
    for old in _STEP4:
        if w.endswith(old):
            stem = w[: -len(old)]
            if measure(stem) > 1 and (old != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if double(w) and w.endswith("l") and measure(w) > 1 else w


#: The suffix tables of Porter's algorithm, the longest match of a table first.
_STEP2 = [("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"),
          ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"),
          ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("ator", "ate"), ("eli", "e")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic ou".split()


def stem(term: Column) -> Column:
    """Porter stem; meant for a column of distinct terms."""
    return F.pandas_udf(lambda s: s.map(porter_stem), "string")(term)


def stem_all(terms: Column) -> Column:
    """The Porter stems of a list of terms; each different term of a batch is stemmed once."""

    def run(lists: pd.Series) -> pd.Series:
        memo: dict[str, str] = {}
        out = []
        for terms in lists:
            out.append([memo[t] if t in memo else memo.setdefault(t, porter_stem(t)) for t in terms])
        return pd.Series(out)

    return F.pandas_udf(run, "array<string>")(terms)
