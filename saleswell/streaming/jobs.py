"""Sources, sinks and runs of the streaming jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from saleswell.operators import maintenance
from saleswell.session import work_folder
from saleswell.sources import invoices


def parquet_stream(spark: SparkSession, table: str, files_per_trigger: int | None = None) -> DataFrame:
    """The files of a table, a folder of parts or a single file, as a stream; the schema comes from what is there.

    ``files_per_trigger`` bounds a micro-batch; without it the whole history is one.
    """
    reader = spark.readStream.schema(spark.read.parquet(table).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if not maintenance.is_folder(spark, table):  # a stream watches folders: take the one file of its folder
        table, _, name = table.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(table)


def run_append(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Process what is there, append to a folder, stop.  Restart continues from the checkpoint."""
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_replace(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Complete-mode result, published whole after every batch (bounded by its windows)."""

    def swap(batch: DataFrame, _batch_id: int) -> None:
        maintenance.publish(batch, table, empty_input="keep")

    query = (
        stream.writeStream.outputMode("complete").foreachBatch(swap).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def once_appended(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream to the end of its input and read the output back."""
    spark = stream.sparkSession
    target = work_folder(spark, name)
    run_append(stream, f"{target}/out", f"{target}/ckpt")
    return spark.read.schema(stream.schema).parquet(f"{target}/out")


def once_complete(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    target = work_folder(spark, name)
    run_replace(stream, f"{target}/out", f"{target}/ckpt")
    return maintenance.read_table(spark, f"{target}/out")


# ------------------------------------------------------------------- invoices
def invoice_stream(spark: SparkSession, folder: str, archive: str | None = None, pattern: str = "*.md") -> DataFrame:
    """New invoice documents; read files may be moved to ``archive`` by the source itself."""
    reader = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    raw = reader.load(folder)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return raw.select(name.alias("file_name"), F.col("value").alias("content")).where(F.col("file_name") != "README.md")


def ingest_invoices(documents: DataFrame, headers: str, lines: str, checkpoint: str) -> None:
    """Parse each new document into header and line tables, once per batch."""

    def load(batch: DataFrame, batch_id: int) -> None:
        blocks = invoices.split_orders(batch)
        # A batch folder is overwritten when the batch is retried, so no row doubles.
        invoices.parse_headers(blocks).write.mode("overwrite").parquet(f"{headers}/batch={batch_id}")
        invoices.parse_lines(blocks).write.mode("overwrite").parquet(f"{lines}/batch={batch_id}")

    query = documents.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def status_snapshots(
    changes: DataFrame, target: str, checkpoint: str, stamp: Callable[[], str] = lambda: uuid.uuid4().hex
) -> None:
    """Append the queue's status counts after every batch of status changes."""
    counts = changes.groupBy("qb_status").agg(F.count("*").alias("events"))

    def snapshot(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("taken_at", F.lit(stamp())).write.mode("overwrite").json(f"{target}/batch={batch_id}")

    query = (
        counts.writeStream.outputMode("complete").foreachBatch(snapshot).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
