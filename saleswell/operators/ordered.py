"""Ordered per-key computations that survive hot keys.

A window over a key runs in one task, so a key with a third of all rows would
stall the job.  These helpers cut each key into blocks (any column that never
decreases along the order, such as the day), reduce the blocks first, carry
block totals forward over the small block table, and only then work inside a
block.  Results are exact whatever the blocks are; finer blocks spread better.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_rows(df: DataFrame, order: Sequence[str | Column], limit: int | None) -> DataFrame:
    """The first ``limit`` rows of an order (all, unsorted, for ``None``); the number is taken as given."""
    if limit is None:
        return df
    if limit < 1:
        raise ValueError(f"limit must be at least 1: {limit}")
    return df.orderBy(*order).limit(limit)


def by_shuffle(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the data: never collected for a broadcast.

    Before it runs, Spark knows only the size of a table's compressed files, which can be a small part of what its rows
    take, all the more where a view makes several rows of one.
    """
    return df.hint("merge")


def spread_nulls(key: Column, kind: str, salt: Column, ways: int = 4096) -> Column:
    """A join key whose NULLs become many values that no dimension holds, so they don't meet in one partition.

    Mask the joined columns where the key is NULL: the stand-ins are only unlikely, not impossible.
    """
    way = F.pmod(F.xxhash64(salt), F.lit(ways))
    stand_in = F.concat(F.lit("\x00"), way.cast("string")) if kind == "string" else F.lit(-(1 << 62)) - way
    return F.coalesce(key, stand_in)


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], block: Column, name: str = "rn") -> DataFrame:
    """Exact ``row_number`` per key; ``order`` must be unique within a key."""
    tagged = _tagged(df, keys, block)
    sizes = tagged.groupBy("_key").agg(F.count("*").alias("_n")).select("_key", "_key.*", "_n")
    starts = sizes.select("_key", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_key").orderBy(*order)
    return _placed(tagged, starts, keys).withColumn(name, F.col("_start") + F.row_number().over(inner)).select(*df.columns, name)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], block: Column, value: str, name: str
) -> DataFrame:
    """Exact running sum per key, the current row included."""
    tagged = _tagged(df, keys, block)
    totals = tagged.groupBy("_key").agg(F.sum(value).alias("_t")).select("_key", "_key.*", "_t")
    starts = totals.select("_key", F.coalesce(F.sum("_t").over(_before(keys)), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _placed(tagged, starts, keys).withColumn(name, F.col("_start") + F.sum(value).over(inner)).select(*df.columns, name)


def _tagged(df: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    """Keys and block as one struct: never NULL and equal where its parts are, NULL parts too.

    So totals, join and window of a block all ask for the same dealing of the rows, and they are shuffled for it once.
    """
    return df.withColumn("_key", F.struct(*keys, block.alias("_block"))).drop(*keys)


def _placed(tagged: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    # Rows without a block have no place in the order: they count before all others, but get no value of their own.
    return tagged.where(F.col("_key._block").isNotNull()).join(starts, "_key").withColumns({k: F.col(f"_key.{k}") for k in keys})


def _join_blocks(tagged: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = tagged["_block"] == starts["_b"]
    for k in keys:
        on = on & tagged[k].eqNullSafe(starts[f"_k_{k}"])
    return tagged.join(starts, on).drop("_b", *[f"_k_{k}" for k in keys])


def replay(
    df: DataFrame, keys: Sequence[str], order: str, block: Column, delta: str = "delta", set_to: str = "set_to"
) -> DataFrame:
    """Running balance where a row either adds ``delta`` or, if ``set_to`` is not NULL, sets the value.

    A set at running sum ``s`` shifts everything after it by ``set_to - s``, so
    both kinds reduce to sums and a last value, block by block.
    """
    tagged = df.withColumn("_block", block).withColumn("_d", F.when(F.col(set_to).isNotNull(), F.lit(0.0)).otherwise(F.col(delta)))
    inner = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("_s", F.sum("_d").over(inner)).withColumn(
        "_shift", F.last(F.when(F.col(set_to).isNotNull(), F.col(set_to) - F.col("_s")), ignorenulls=True).over(inner)
    )
    blocks = local.groupBy(*keys, "_block").agg(
        F.sum("_d").alias("_t"), F.max_by("_shift", order).alias("_last")
    )
    prior = _before(keys)
    running = blocks.withColumn("_base", F.coalesce(F.sum("_t").over(prior), F.lit(0.0)))
    # The shift of a block's last set, measured from the key's start.
    running = running.withColumn("_abs", F.col("_last") - F.col("_base"))
    starts = running.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), "_base",
        F.coalesce(F.last("_abs", ignorenulls=True).over(prior), F.lit(0.0)).alias("_carry"),
    )
    joined = _join_blocks(local, starts, keys)
    inside = F.col("_s") + F.col("_shift")
    carried = F.col("_base") + F.col("_s") + F.col("_carry")
    return joined.withColumn("balance", F.coalesce(inside, carried)).drop("_block", "_d", "_s", "_shift", "_base", "_carry")
