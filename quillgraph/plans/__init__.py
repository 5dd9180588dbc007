"""Named queries, grouped by topic."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["integrity_queries", "graph_queries", "search_queries", "source_queries", "relation_queries"]


def all_registries() -> list:
    return [import_module(f"{__name__}.{m}").registry for m in _MODULES]
