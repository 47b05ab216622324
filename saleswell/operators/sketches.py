"""Distinct counts that merge: sketches stored by day, any range in one pass over a few rows a day.

Exact counts stay the default of every report.  A sketch answers ranges of days without the raw
events: it is a fixed few kilobytes, combines on the map side and has a known error, so a range over years costs
one row a day however many users there were.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: log2 of a sketch's buckets; the relative standard error is 0.83 / sqrt(2^LG_K).
LG_K = 14


def error_bound(lg_k: int = LG_K, sigmas: float = 4.0) -> float:
    """Relative error that an estimate exceeds with odds of about one in 16,000 (at four standard errors)."""
    return sigmas * 0.83 / 2 ** (lg_k / 2)


def daily(df: DataFrame, day: str, key: str, by: Sequence[str] = (), lg_k: int = LG_K) -> DataFrame:
    """``day, by..., sketch``; rows without a key count for nothing."""
    return df.groupBy(day, *by).agg(F.hll_sketch_agg(F.col(key), F.lit(lg_k)).alias("sketch"))


def merged(sketches: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    """One sketch for each group of rows."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimate(name: str = "distinct") -> Column:
    return F.hll_sketch_estimate("sketch").alias(name)


def distinct_between(sketches: DataFrame, day: str, start: dt.date, end: dt.date, by: Sequence[str] = ()) -> DataFrame:
    """Estimated distinct keys of a closed range of days, for each group."""
    inside = sketches.where(F.col(day).between(F.lit(start), F.lit(end)))
    return merged(inside, by).select(*by, estimate())
