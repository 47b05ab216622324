"""Data-quality checks over a SKU-day fact; each gives ``check_name, value, passed``."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from saleswell.functions.numeric import ratio, round_half_up


def _row(name: str, value, passed) -> list:
    return [F.lit(name).alias("check_name"), value.cast("double").alias("value"), passed.alias("passed")]


def skip_rows(raw: DataFrame, key: str, numbers: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to load, ``numbers`` as double, and the rows left out with a ``reason``: ``empty``, ``no key`` or ``not a number``.

    One pass decides both: every row is in exactly one of the two.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    empty = functools.reduce(lambda a, b: a & b, [blank(c) for c in raw.columns])
    unread = functools.reduce(lambda a, b: a | b, [F.col(c).try_cast("double").isNull() for c in numbers], F.lit(False))
    reason = F.when(empty, "empty").when(blank(key), "no key").when(unread, "not a number")
    marked = raw.withColumn("reason", reason)
    kept = marked.where("reason is null").drop("reason")
    return kept.withColumns({c: F.col(c).try_cast("double") for c in numbers}), marked.where("reason is not null")


def partition_present(fact: DataFrame, day: dt.date, column: str = "business_date") -> DataFrame:
    n = fact.where(F.col(column) == F.lit(day)).agg(F.count("*").alias("n"))
    return n.select(*_row("partition_present", F.col("n"), F.col("n") > 0))


def volume_per_sku(fact: DataFrame, tolerance: float = 0.2, day: str = "business_date", sku: str = "msku") -> DataFrame:
    """Rows per day against distinct SKUs per day; ``passed`` when within tolerance."""
    daily = fact.groupBy(day).agg(F.count("*").alias("rows"), F.countDistinct(sku).alias("skus"))
    return daily.withColumn("passed", F.abs(F.col("rows") - F.col("skus")) <= F.col("skus") * F.lit(tolerance))


def non_zero_totals(fact: DataFrame) -> DataFrame:
    s = fact.agg(F.sum("units").alias("u"), F.sum("net_sales").alias("n"))
    return s.select(F.inline(F.array(
        F.struct(*_row("units_positive", F.col("u"), F.coalesce(F.col("u") > 0, F.lit(False)))),
        F.struct(*_row("net_sales_positive", F.col("n"), F.coalesce(F.col("n") > 0, F.lit(False)))),
    )))


def key_rate(fact: DataFrame, key: str = "msku", minimum: float = 0.99) -> DataFrame:
    """Share of rows with a key; must exceed ``minimum``."""
    s = fact.agg(F.count(key).alias("k"), F.count("*").alias("n"))
    share = ratio(F.col("k"), F.col("n"), digits=6)
    return s.select(*_row("key_rate", share, F.coalesce(share > minimum, F.lit(False))))


def uniqueness(fact: DataFrame, keys: Sequence[str] = ("business_date", "msku")) -> DataFrame:
    dup = fact.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n"))
    return dup.select(*_row("unique_key", F.col("n"), F.col("n") == 0))


def duplicate_keys(fact: DataFrame, keys: Sequence[str]) -> DataFrame:
    return fact.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def hard_checks(fact: DataFrame, day: dt.date) -> DataFrame:
    parts = [partition_present(fact, day), non_zero_totals(fact), key_rate(fact), uniqueness(fact)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drift(fact: DataFrame, days: int = 14, sales_band: float = 0.5, fee_jump: float = 1.5) -> DataFrame:
    """Daily net sales against the median of the ``days`` before, and the fee ratio's jump.

    Facts reduce to one row per day first; each day is then sent to the days
    that look back on it (a fixed fan-out), so the median is an ordinary
    grouped aggregate with at most ``days`` values.
    """
    daily = fact.groupBy("business_date").agg(
        F.sum("net_sales").alias("net"), F.sum("fees").alias("fees"), F.sum("ad_spend").alias("ads")
    )
    daily = daily.withColumn("fee_ratio", ratio(F.abs("fees"), F.col("net"), digits=6))
    row = F.struct("net", "fee_ratio", "ads")
    spread = daily.select(
        row.alias("r"), F.explode(F.sequence(F.lit(0), F.lit(days))).alias("lag"), "business_date"
    ).select(F.date_add("business_date", F.col("lag")).alias("business_date"), "r", "lag")
    past = F.col("lag") > 0
    g = spread.groupBy("business_date").agg(
        F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("own"),
        F.median(F.when(past, F.col("r.net").cast("double"))).alias("median_net"),
        F.median(F.when(past, F.col("r.fee_ratio"))).alias("median_fee_ratio"),
        F.count_if(past).alias("past_days"),
    ).where(F.col("own").isNotNull())
    net = F.col("own.net").cast("double")
    return g.select(
        "business_date", net.alias("net_sales"), round_half_up(F.col("median_net"), 2).alias("median_net"), "past_days",
        F.col("own.fee_ratio").alias("fee_ratio"), round_half_up(F.col("median_fee_ratio"), 6).alias("median_fee_ratio"),
        F.coalesce(F.abs(net - F.col("median_net")) > F.abs("median_net") * F.lit(sales_band), F.lit(False)).alias("sales_alert"),
        F.coalesce(F.col("own.fee_ratio") > F.col("median_fee_ratio") * F.lit(fee_jump), F.lit(False)).alias("fee_alert"),
    )


def ad_budget(fact: DataFrame, budget: float) -> DataFrame:
    daily = fact.groupBy("business_date").agg(F.sum("ad_spend").cast("double").alias("ad_spend"))
    return daily.withColumn("over_budget", F.col("ad_spend") > F.lit(float(budget)))


def require_rows(df: DataFrame, minimum: int, label: str) -> None:
    """Stop a reconciliation early on an input that is too small; reads at most ``minimum`` rows."""
    found = df.select(F.lit(1)).limit(minimum).count()
    if found < minimum:
        raise ValueError(f"{label}: {found} rows, at least {minimum} required")


def require_columns(df: DataFrame, columns: Sequence[str], allow_partial: bool = False) -> list[str]:
    missing = [c for c in columns if c not in df.columns]
    if missing and not allow_partial:
        raise ValueError(f"required columns missing: {missing}; found: {df.columns}")
    return missing


def require_below(count: int, limit: int, label: str, allow_partial: bool = False) -> None:
    """A result as large as its limit was probably cut off."""
    if count >= limit and not allow_partial:
        raise ValueError(f"{label}: {count} rows reach the limit of {limit}")
