"""The list of named queries, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    """Named queries and their check SQL."""

    queries: dict[str, QueryFn] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
        def wrap(fn: QueryFn) -> QueryFn:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return wrap
