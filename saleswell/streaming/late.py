"""Streams that keep their late rows.

A watermark drops what comes too late without a trace.  Here every micro-batch is written once, its
late rows in a folder beside the others, and the counts and the newest event time are observed in that same write.  A row
is late if it lies before the newest event time of the earlier batches less the delay, as for Spark's own watermark.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from saleswell.operators import maintenance, runs

MARK = "batch_id bigint, rows bigint, late_rows bigint, newest timestamp_ntz, watermark timestamp_ntz"


def marks(spark: SparkSession, target: str) -> DataFrame:
    """One row a batch: its rows, its late rows, its newest event time and the watermark that it was held to."""
    fs, path = maintenance._fs(spark, target)
    folder = f"{target}/marks"
    return spark.read.schema(MARK).option("recursiveFileLookup", True).parquet(folder) if fs.exists(path(folder)) else spark.createDataFrame([], MARK)


def split_late(stream: DataFrame, time: str, delay: dt.timedelta, target: str, checkpoint: str) -> None:
    """Run to the end of the input: rows under ``target/rows`` with a ``late`` flag, one mark a batch under ``target/marks``.

    A batch that is tried again overwrites its own folders and is held to the same watermark.  Rows without an event time are on time.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = marks(spark, target).where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        watermark = None if newest is None else newest - delay
        late = F.lit(False) if watermark is None else F.coalesce(F.col(time) < F.lit(watermark), F.lit(False))
        flagged = batch.withColumn("late", late)
        write = lambda df: df.write.mode("overwrite").partitionBy("late").parquet(f"{target}/rows/batch={batch_id}")
        seen = runs.measured(flagged, write, late_rows=F.count_if("late"), newest=F.max(F.col(time).cast("timestamp_ntz")))
        mark = spark.createDataFrame([(batch_id, seen["row_count"], seen["late_rows"], seen["newest"], watermark)], MARK)
        mark.coalesce(1).write.mode("overwrite").parquet(f"{target}/marks/{batch_id:010d}")

    query = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read(spark: SparkSession, target: str, late: bool | None = None) -> DataFrame:
    """The rows of all batches, or only the late ones or the others."""
    rows = spark.read.parquet(f"{target}/rows").withColumn("late", F.col("late").cast("boolean"))  # folder names are read as text
    return rows if late is None else rows.where(F.col("late") == late)
