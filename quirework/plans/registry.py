"""Named queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a function under its own name."""

    def add(fn: QueryFn) -> QueryFn:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.strip()
        return fn

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to six digits for a stable comparison of floating results."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col, 6)
    return out.alias(name or c) if (name or isinstance(c, str)) else out
