"""Settings: overrides before the file's values before defaults."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace

from .sources.scan import DEFAULT_EXCLUDES, MAX_FILE_BYTES

CONFIG_NAME = "quillgraph.config.json"


@dataclass(frozen=True)
class Config:
    root: str
    state: str = ""
    exclude: tuple[str, ...] = tuple(DEFAULT_EXCLUDES)
    max_file_bytes: int = MAX_FILE_BYTES
    embedding_dim: int = 256
    token_budget: int = 8000
    embeddings: str = "local"
    viewer: str = "inline"
    mode: str = "auto"
    parsing: str = "auto"


def load_file(root: str) -> dict:
    """The settings file of ``root``; a missing or unreadable one has no values."""
    try:
        with open(os.path.join(root, CONFIG_NAME), encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def resolve(root: str, **overrides) -> Config:
    """The settings of ``root``; the place of the state comes from overrides alone. Unknown names in the file are passed over."""
    root = os.path.abspath(root)
    known = {f.name for f in fields(Config)} - {"root", "state"}
    values = {k: v for k, v in load_file(root).items() if k in known} | {k: v for k, v in overrides.items() if v is not None}
    if "exclude" in values:
        values["exclude"] = tuple(values["exclude"])
    cfg = replace(Config(root=root), **values)
    return cfg if cfg.state else replace(cfg, state=os.path.join(root, ".quillgraph"))


#: Numbers of files from which a tree counts as big, and from which it is parsed by workers.
BIG_TREE, MANY_FILES = 2_500, 1_500


def effective_modes(cfg: Config, n_files: int) -> dict[str, str]:
    """What the settings come to for a tree of ``n_files``: ``mode`` (single or monorepo) and ``parsing`` (inline or workers). For
    information only: Spark's tasks are the workers, at any size."""
    big = cfg.mode == "monorepo" or (cfg.mode == "auto" and n_files > BIG_TREE)
    parsing = cfg.parsing if cfg.parsing != "auto" else "workers" if n_files > MANY_FILES else "inline"
    return {"mode": "monorepo" if big else "single", "parsing": parsing}
