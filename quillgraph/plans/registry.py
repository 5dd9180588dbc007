"""A registry of named queries: a Spark callable and, where SQL can express it, the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, QueryFn] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
        def keep(fn: QueryFn) -> QueryFn:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return keep
