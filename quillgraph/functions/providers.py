"""Embedding providers: something that turns a text column into a column of unit vectors."""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import local_embedding


class Provider(Protocol):
    dim: int
    signature: str

    def embed(self, text: Column) -> Column: ...


@dataclass(frozen=True)
class LocalProvider:
    dim: int = 256

    @property
    def signature(self) -> str:
        return f"local:{self.dim}"

    def embed(self, text: Column) -> Column:
        return local_embedding(text, self.dim)


@dataclass(frozen=True)
class SentenceModelProvider:
    """A sentence-transformer model, loaded once in each Python worker; needs that library and the model's files."""

    model: str
    dim: int = 384

    @property
    def signature(self) -> str:
        return f"sentence:{self.model}:{self.dim}"

    def available(self) -> bool:
        try:
            import sentence_transformers  # noqa: F401
        except ImportError:
            return False
        return True

    def embed(self, text: Column) -> Column:
        name = self.model

        def run(batches):
            from sentence_transformers import SentenceTransformer

            model = SentenceTransformer(name)
            for s in batches:
                yield pd.Series([v.tolist() for v in model.encode(s.fillna("").tolist(), batch_size=32, normalize_embeddings=True)])

        run.__annotations__ = {"batches": "Iterator[pd.Series]", "return": "Iterator[pd.Series]"}
        return F.pandas_udf(run, "array<float>", F.PandasUDFType.SCALAR_ITER)(text)


@dataclass(frozen=True)
class HttpProvider:
    """A model server that answers ``{"embedding": [...]}`` to ``{"model", "prompt"}``; vectors are made unit length again."""

    url: str
    model: str
    dim: int = 768

    @property
    def signature(self) -> str:
        return f"http:{self.model}:{self.dim}"

    def available(self) -> bool:
        import urllib.request

        try:
            with urllib.request.urlopen(self.url, timeout=2):
                return True
        except OSError:
            return False

    def embed(self, text: Column) -> Column:
        url, model, dim = self.url, self.model, self.dim

        def ask(texts: pd.Series) -> pd.Series:
            import json
            import urllib.request

            out = []
            for t in texts:
                body = json.dumps({"model": model, "prompt": t or ""}).encode()
                req = urllib.request.Request(url, body, {"Content-Type": "application/json"})
                with urllib.request.urlopen(req, timeout=60) as r:
                    v = json.load(r)["embedding"][:dim]
                norm = sum(x * x for x in v) ** 0.5
                out.append([x / norm for x in v] if norm else v)
            return pd.Series(out)

        return F.pandas_udf(ask, "array<float>")(text)


def choose(preferred: str = "local", dim: int = 256) -> Provider:
    """The environment's choice before ``preferred``; a provider that isn't available gives way to the local one."""
    name = os.environ.get("QUILLGRAPH_EMBEDDINGS", preferred)
    provider: Provider | None = None
    if name == "sentence":
        provider = SentenceModelProvider(os.environ.get("QUILLGRAPH_MODEL", "all-MiniLM-L6-v2"))
    elif name == "http":
        provider = HttpProvider(os.environ.get("QUILLGRAPH_MODEL_URL", "http://localhost:11434/api/embeddings"), os.environ.get("QUILLGRAPH_MODEL", "nomic-embed-text"))
    return provider if provider is not None and provider.available() else LocalProvider(dim)
