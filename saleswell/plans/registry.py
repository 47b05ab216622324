"""Named queries over the canonical feeds, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from saleswell.sources.sample import Feeds, oracle


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Feeds], DataFrame]
    sql: str | None
    source: str | None = None  # the SQL as written, over the views


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(feeds) -> DataFrame`` under ``name``; ``sql`` may use the views."""

    def wrap(fn: Callable[[Feeds], DataFrame]) -> Callable[[Feeds], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(name, fn, oracle(sql) if sql else None, sql)
        return fn

    return wrap


def sql_round(expr: str, digits: int = 2) -> str:
    """SQL twin of :func:`saleswell.functions.numeric.round_half_up`."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"


def sql_ratio(num: str, den: str, scale: float | None = None, digits: int | None = 2) -> str:
    """SQL twin of :func:`saleswell.functions.numeric.ratio`."""
    value = f"(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0))"
    if scale is not None:
        value = f"({value} * {float(scale)})"
    return value if digits is None else sql_round(value, digits)
