"""Period selection and comparison over a mart.

A mart has one row per bucket (and optional entity key), so its size is bounded
by the calendar; the ordered windows below run on that, never on facts.  Windows
over the whole mart (one task) are for marts without an entity key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from saleswell.functions.calendar import bucket_end, overlaps, range_bounds, week_monday

YEAR_OFFSET = 364  # fixed value: 52 whole weeks, so weekdays line up
INCOMPLETE_RANGES = ("ytd", "mtd", "qtd")


def in_range(mart: DataFrame, lower: dt.date, upper: dt.date, grain: str = "week", day: str = "bucket_start") -> DataFrame:
    """Buckets that intersect the range, even when they only touch it."""
    return mart.where(overlaps(F.col(day), bucket_end(F.col(day), grain), lower, upper))


def trim_incomplete_week(
    mart: DataFrame, range_name: str, as_of: dt.date, grain: str = "week", day: str = "bucket_start"
) -> DataFrame:
    """Headline ranges leave out the running week.

    At day grain every day from Monday on goes; at week grain only a newest
    bucket that starts on that Monday (a bucket split at a month start stays).
    """
    if range_name not in INCOMPLETE_RANGES:
        return mart
    monday = F.lit(week_monday(as_of))
    if grain == "day":
        return mart.where(F.col(day) < monday)
    newest = F.max(day).over(Window.partitionBy(F.lit(0)))
    return (
        mart.withColumn("_newest", newest)
        .where((F.col(day) != monday) | (F.col("_newest") != monday))
        .drop("_newest")
    )


def headline(mart: DataFrame, range_name: str, as_of: dt.date, grain: str = "week", custom=None) -> DataFrame:
    lower, upper = range_bounds(range_name, as_of, custom)
    return trim_incomplete_week(in_range(mart, lower, upper, grain), range_name, as_of, grain)


def fact_days(range_name: str, as_of: dt.date, custom=None, tolerance: int = 3, offset: int = YEAR_OFFSET) -> tuple[dt.date, dt.date]:
    """Days that a headline and its prior year need, with whole weekly buckets at both ends.

    A bucket that touches the range begins up to six days before it; its partner
    begins up to ``offset + tolerance`` days earlier.  Older, partial buckets match nothing.
    """
    lower, upper = range_bounds(range_name, as_of, custom)
    return lower - dt.timedelta(days=6 + offset + tolerance), upper + dt.timedelta(days=6)


def _spread(pair: str, prefix: str, metrics: Sequence[str]) -> list[Column]:
    return [F.col(f"{pair}.{m}").alias(f"{prefix}_{m}") for m in metrics]


def prior_year(
    mart: DataFrame,
    metrics: Sequence[str],
    day: str = "bucket_start",
    keys: Sequence[str] = (),
    tolerance: int = 3,
    pick: str = "latest",
    offset: int = YEAR_OFFSET,
) -> DataFrame:
    """Pair every bucket with one about a year before it.

    Candidates lie within ``tolerance`` days of the target day.  ``latest``
    takes the newest candidate, which at day grain is not the exact day;
    ``nearest`` the closest.  Each row is emitted once for itself and once per
    offset, so a single equi-grouping replaces a range join and the mart is
    read once.  Unmatched buckets keep a NULL ``prior_day``.
    """
    if pick not in ("latest", "nearest"):
        raise ValueError(f"pick must be latest or nearest: {pick!r}")
    row = F.struct(F.col(day).alias("_day"), *metrics)
    role = lambda target, own, gap: F.struct(
        target.alias("target"), F.lit(own).alias("own"), F.lit(gap).alias("gap")
    )
    roles = [role(F.col(day), True, 0)] + [
        role(F.date_add(day, offset + k), False, abs(k)) for k in range(-tolerance, tolerance + 1)
    ]
    spread = mart.select(*keys, row.alias("row"), F.explode(F.array(*roles)).alias("role")).select(
        *keys, "row", "role.*"
    )
    rank = F.struct(-F.col("gap"), F.col("row._day")) if pick == "nearest" else F.struct(F.col("row._day"))
    pairs = spread.groupBy(*keys, "target").agg(
        F.max_by(F.when(F.col("own"), F.col("row")), F.when(F.col("own"), F.col("row._day"))).alias("cur"),
        F.max_by(F.when(~F.col("own"), F.col("row")), F.when(~F.col("own"), rank)).alias("prev"),
    )
    return pairs.where(F.col("cur").isNotNull()).select(
        *keys,
        F.col("target").alias(day),
        F.col("prev._day").alias("prior_day"),
        *_spread("cur", "cur", metrics),
        *_spread("prev", "prev", metrics),
    )


def prior_period(
    mart: DataFrame, selected: Column, metrics: Sequence[str], day: str = "bucket_start"
) -> DataFrame:
    """Pair the selected (contiguous) buckets with as many buckets right before them.

    Positional: the i-th newest selected bucket meets the i-th newest earlier
    one, wherever it falls in the calendar.
    """
    by_day = Window.partitionBy(F.lit(0)).orderBy(F.desc(day))
    ranked = mart.select(F.col(day), *metrics, selected.alias("_sel")).withColumns(
        {
            "_pos": F.row_number().over(by_day),
            "_n": F.count_if("_sel").over(Window.partitionBy(F.lit(0))),
        }
    )
    row = F.struct(F.col(day).alias("_day"), *metrics)
    own = F.when(F.col("_sel"), F.struct(F.col("_pos").alias("slot"), F.lit(True).alias("own")))
    back = F.struct((F.col("_pos") - F.col("_n")).alias("slot"), F.lit(False).alias("own"))
    spread = ranked.select(row.alias("row"), F.explode(F.array_compact(F.array(own, back))).alias("r")).select("row", "r.*")
    pairs = spread.groupBy("slot").agg(
        F.max(F.when(F.col("own"), F.col("row"))).alias("cur"), F.max(F.when(~F.col("own"), F.col("row"))).alias("prev")
    )
    return pairs.where(F.col("cur").isNotNull()).select(
        F.col("cur._day").alias(day),
        F.col("prev._day").alias("prior_day"),
        *_spread("cur", "cur", metrics),
        *_spread("prev", "prev", metrics),
    )


def with_previous(mart: DataFrame, metrics: Sequence[str], day: str = "bucket_start") -> DataFrame:
    """Previous row's values by position (week over week)."""
    w = Window.partitionBy(F.lit(0)).orderBy(day)
    return mart.withColumns({f"prev_{m}": F.lag(m).over(w) for m in metrics})


def trailing_sum(mart: DataFrame, metrics: Sequence[str], order: str, rows: int = 12) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(-(rows - 1), 0)
    exact = lambda m: F.sum(F.col(m).cast("decimal(28,2)")).over(w).cast("double")
    return mart.withColumns({f"t{rows}_{m}": exact(m) for m in metrics})
