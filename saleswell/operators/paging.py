"""Pages of a large ordered result, by a rank index.

The result is written once in blocks of the order, each sorted, with a small table that
holds every block's first rank and size.  Any page, however deep, then reads the one or two
blocks that it lies in, and of a large block only the file pages that hold its places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BLOCK, PLACE, STOOD = "_block", "_place", "_stood"

#: A block is a task and a folder, both known to the driver: a longer result has larger blocks, not more.
MOST_BLOCKS = 512


def build(df: DataFrame, order: Sequence[Column | str], table: str, rows_per_block: int = 100_000) -> None:
    """Write the index.  Rows that the order leaves equal keep one order among all pages, by where they stood.

    Blocks have about ``rows_per_block`` rows, more where that would make over ``MOST_BLOCKS`` of them.
    """
    if rows_per_block < 1:
        raise ValueError(f"blocks need at least one row: {rows_per_block}")
    keys = [*order, F.col(STOOD)]
    blocks = min(max(1, -(-df.count() // rows_per_block)), MOST_BLOCKS)
    ranged = df.withColumn(STOOD, F.monotonically_increasing_id()).repartitionByRange(blocks, *keys).sortWithinPartitions(*keys)
    # The generated number holds the partition above bit 33 and the row's place in it below.
    number = ranged.drop(STOOD).withColumn(PLACE, F.monotonically_increasing_id())
    split = number.withColumn(BLOCK, F.shiftright(PLACE, 33)).withColumn(PLACE, F.col(PLACE) - F.shiftleft(BLOCK, 33))
    split.write.partitionBy(BLOCK).parquet(f"{table}/rows")
    written = df.sparkSession.read.schema(split.schema).parquet(f"{table}/rows")
    # One row a block: the running sum is over blocks, not rows.
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = written.groupBy(BLOCK).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sizes.coalesce(1).write.parquet(f"{table}/index")


def total(spark: SparkSession, table: str) -> int:
    return spark.read.parquet(f"{table}/index").agg(F.sum("n")).first()[0] or 0


def pages(spark: SparkSession, table: str, size: int) -> int:
    """Number of pages of that size."""
    if size < 1:
        raise ValueError(f"a page needs at least one row: {size}")
    return -(-total(spark, table) // size)


def page(spark: SparkSession, table: str, number: int, size: int) -> DataFrame:
    """The rows of a page (from 1) with their ``rank`` (from 1); none beyond the last page."""
    if number < 1 or size < 1:
        raise ValueError(f"page number and size start at 1: {number}, {size}")
    first = (number - 1) * size
    hits = spark.read.parquet(f"{table}/index").where((F.col("start") < first + size) & (F.col("start") + F.col("n") > first)).collect()
    rows = spark.read.parquet(f"{table}/rows")
    # Only blocks that the page meets are named: partition pruning leaves the other folders unread.
    rows = rows.where(F.col(BLOCK).isin([h[BLOCK] for h in hits])) if hits else rows.limit(0)
    # Places ascend in a file: a filter on them alone reaches its page index.
    inside = F.lit(not hits)
    for h in hits:
        inside = inside | F.col(PLACE).between(max(first - h["start"], 0), first + size - 1 - h["start"])
    rows = rows.where(inside)
    start = F.lit(0).cast("bigint")
    for h in hits:
        start = F.when(F.col(BLOCK) == h[BLOCK], F.lit(h["start"])).otherwise(start)
    ranked = rows.withColumn("rank", start + F.col(PLACE) + 1)
    return ranked.where(F.col("rank").between(first + 1, first + size)).drop(BLOCK, PLACE)
