"""Queries on a model of tables with declared joins.

A column may be named by a path of joins, ``customer.nation.n_name``; each path
becomes one chain of left joins, however often it is used. Aggregates imply the
grouping: all other selected expressions are the keys.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

_AGGREGATE = re.compile(r"\b(count|sum|avg|min|max|any_value|median|stddev|count_if|max_by|min_by)\s*\(", re.I)
_STRING = re.compile(r"'(?:[^']|'')*'")
_PATH = re.compile(r"\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+")


@dataclass
class _Table:
    frame: DataFrame
    one: Mapping[str, tuple[str, Mapping[str, str]]] = field(default_factory=dict)
    many: Mapping[str, tuple[str, Mapping[str, str]]] = field(default_factory=dict)


class Model:
    """Named tables with ``one`` joins, that must not fan out, and ``many`` joins."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: dict[str, _Table] = {}

    def add(self, name: str, frame: DataFrame, one: Mapping | None = None, many: Mapping | None = None) -> None:
        self.tables[name] = _Table(frame, one or {}, many or {})

    def check_one(self, table: str, join: str) -> bool:
        """Whether a ``one`` join really finds at most one row."""
        target, keys = self.tables[table].one[join]
        return self.tables[target].frame.groupBy(*keys.values()).count().where("count > 1").isEmpty()

    def query(
        self,
        source: str | DataFrame,
        select: Mapping[str, str],
        where: str | None = None,
        order_by: list[str] | None = None,
        limit: int | None = None,
        base: str | None = None,
    ) -> DataFrame:
        """Run one query; ``source`` is a table or the result of another query
        whose joins are those of table ``base``."""
        root = base if base is not None else source if isinstance(source, str) else None
        frame = self.tables[source].frame if isinstance(source, str) else source
        state: dict[str, str] = {}

        def place(path: str) -> str:
            """Join along ``path`` and give the column's name afterwards."""
            nonlocal frame
            *steps, column = path.split(".")
            at, prefix = root, ""
            for step in steps:
                if at is None:
                    raise ValueError(f"{path}: the source declares no joins")
                known = self.tables[at]
                if step not in known.one and step not in known.many:
                    raise ValueError(f"{path}: {at} has no join {step}")
                target, keys = {**known.many, **known.one}[step]
                here = f"{prefix}{step}__"
                if here not in state:
                    other = self.tables[target].frame
                    other = other.select(*[F.col(c).alias(here + c) for c in other.columns])
                    cond = F.lit(True)
                    for left, right in keys.items():
                        cond = cond & (frame[prefix + left] == other[here + right])
                    frame = frame.join(other, cond, "left")
                    state[here] = target
                at, prefix = target, here
            return f"`{prefix}{column}`"

        def resolve(text: str) -> str:
            kept: list[str] = []

            def hide(m: re.Match) -> str:
                kept.append(m.group())
                return f"\x00{len(kept) - 1}\x00"

            bare = _PATH.sub(lambda m: place(m.group()), _STRING.sub(hide, text))
            return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m.group(1))], bare)

        condition = resolve(where) if where else None
        columns = {name: resolve(text) for name, text in select.items()}
        if condition:
            frame = frame.where(condition)
        aggregates = {n: e for n, e in columns.items() if _AGGREGATE.search(e)}
        if aggregates:
            keys = [F.expr(e).alias(n) for n, e in columns.items() if n not in aggregates]
            frame = frame.groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in aggregates.items()]).select(*columns)
        else:
            frame = frame.select(*[F.expr(e).alias(n) for n, e in columns.items()])
        if order_by:
            frame = frame.orderBy(*[F.expr(o[1:]).desc_nulls_last() if o[0] == "-" else F.expr(o).asc_nulls_last() for o in order_by])
        return frame.limit(limit) if limit is not None else frame
