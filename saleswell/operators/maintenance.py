"""Table maintenance: window and key reloads, upserts, purges, safe replacement.

No transactional table format is assumed.  The transforms give the new content
of a table; :func:`publish` writes it beside the old one, checks it and moves a
small pointer file, so readers see either version and never a mix.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def replace_window(existing: DataFrame, new: DataFrame, day: str, start: dt.date, end: dt.date) -> DataFrame:
    """Drop the whole date range, even days the new rows lack, then add the new rows."""
    outside = ~F.col(day).between(F.lit(start), F.lit(end)) | F.col(day).isNull()
    return existing.where(outside).unionByName(new)


def replace_keys(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop every row whose key appears in the new rows, then add them."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def refresh_dimension(new: DataFrame, target_schema) -> DataFrame:
    """New content under the target's columns: missing ones NULL, extra ones appended."""
    have = set(new.columns)
    kept = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target_schema]
    extra = [c for c in new.columns if c not in {f.name for f in target_schema}]
    return new.select(*kept, *extra)


def upsert(target: DataFrame, source: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Merge by key with ``change`` = inserted, updated or kept.

    The last source row of a key wins, found by a combinable ``max_by``.
    """
    cols = [c for c in source.columns if c not in (key, ordinal)]
    clean = source.withColumn(key, F.trim(key)).where(F.col(key) != "")
    last = clean.groupBy(key).agg(F.max_by(F.struct(*cols), ordinal).alias("_new"))
    old = target.select(key, F.struct(*[c for c in target.columns if c != key]).alias("_old"))
    both = old.join(last, key, "full_outer")
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").otherwise("updated")
    merged = [
        (F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")) if c in cols else F.col(f"_old.{c}")).alias(c)
        for c in target.columns
        if c != key
    ]
    return both.select(key, *merged, change.alias("change"))


def upsert_counts(upserted: DataFrame) -> DataFrame:
    return upserted.groupBy("change").agg(F.count("*").alias("n"))


def purge_closure(
    parts: DataFrame, locations: DataFrame, balances: DataFrame, events: DataFrame, lines: DataFrame,
    sku_prefix: str = "", location_prefix: str = "", created_by: str = "",
) -> dict[str, DataFrame]:
    """Keys of everything a purge selector reaches, per table.

    A line selected by SKU or location selects its event, and an event selects
    all its lines.
    """
    if not (sku_prefix or location_prefix or created_by):
        raise ValueError("at least one selector is required")
    none = F.lit(False)
    p = parts.where(F.col("sku").startswith(sku_prefix) if sku_prefix else none).select("sku")
    loc = locations.where(F.col("code").startswith(location_prefix) if location_prefix else none).select("location_id")
    by_sku = lines.where(F.col("sku").startswith(sku_prefix) if sku_prefix else none).select("event_id")
    places = F.array_compact(F.array("location_id", "from_location_id", "to_location_id"))
    spread = lines.select("event_id", F.explode(places).alias("location_id"))
    by_place = spread.join(loc, "location_id", "left_semi").select("event_id")
    by_author = events.where(F.coalesce("created_by", F.lit("")) == created_by if created_by else none).select("event_id")
    e = by_sku.unionByName(by_place).unionByName(by_author).distinct()
    all_lines = lines.join(e, "event_id", "left_semi").select("line_id")
    b = balances.join(p, "sku", "left_semi").unionByName(balances.join(loc, "location_id", "left_semi")).select("sku", "location_id").distinct()
    return {"parts": p, "locations": loc, "balances": b, "events": e, "lines": all_lines}


def purge_counts(closure: dict[str, DataFrame]) -> DataFrame:
    """Dry run: rows each table would lose."""
    frames = [df.agg(F.count("*").alias("matched")).select(F.lit(name).alias("table_name"), "matched") for name, df in closure.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def purge(table: DataFrame, reached: DataFrame) -> DataFrame:
    return table.join(reached, reached.columns, "left_anti")


# ------------------------------------------------------------------------ sinks
def land_raw(raw: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Bronze copy, gzip JSON lines under run and document folders."""
    raw.write.mode("append").partitionBy(*partitions).option("compression", "gzip").json(path)


def write_fact(df: DataFrame, path: str, day: str, sort: Sequence[str], mode: str = "overwrite", files_per_day: int = 8) -> None:
    """Date-partitioned fact, rows clustered by the usual filter keys inside files; a day is dealt to at most ``files_per_day`` tasks."""
    if files_per_day < 1:
        raise ValueError(f"files_per_day must be positive: {files_per_day}")
    spread = df.repartition(F.col(day), F.pmod(F.hash(*sort), F.lit(files_per_day)))
    spread.sortWithinPartitions(day, *sort).write.mode(mode).partitionBy(day).parquet(path)


def bucket_count(rows: int, rows_per_bucket: int = 1_000_000, least: int = 1) -> int:
    """Buckets for a table of so many rows: a bucket is sorted and joined by one task, so it must not grow with the table."""
    if rows < 0 or rows_per_bucket < 1 or least < 1:
        raise ValueError(f"rows from 0, rows a bucket and buckets from 1: {rows}, {rows_per_bucket}, {least}")
    return max(least, -(-rows // rows_per_bucket))


def write_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int, sort: Sequence[str] = ()) -> DataFrame:
    """An external table in ``buckets`` hash buckets of ``keys``, sorted in each; tables alike in both join and group by them without a shuffle."""
    if buckets < 1 or not keys:
        raise ValueError("at least one key and one bucket are needed")
    tagged = df.repartition(buckets, *keys)  # one file a bucket, however many tasks write
    tagged.write.bucketBy(buckets, *keys).sortBy(*(sort or keys)).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def append_evolving(df: DataFrame, path: str) -> None:
    """Append that may bring new columns; read it back with :func:`read_evolving`."""
    df.write.mode("append").parquet(path)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def log_run(spark: SparkSession, path: str, run_date: dt.date, status: str, row_count: int, started: dt.datetime,
            finished: dt.datetime, query_id: str = "", document_id: str = "", error: str | None = None) -> None:
    """Append one run record, the error whole."""
    row = (run_date, status, query_id, document_id, row_count, started, finished, error)
    schema = ("run_date date, status string, query_id string, document_id string, row_count long, "
              "started_at timestamp, finished_at timestamp, error string")
    spark.createDataFrame([row], schema).write.mode("append").parquet(path)


def export_report(df: DataFrame, path: str, columns: Sequence[str], single_file: bool = False) -> None:
    """CSV with a stable column order and a header even without rows.

    Pass ``single_file`` only for reports a person reads (a top list, a
    summary); large exports stay in parts.
    """
    out = df.select(*columns)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").option("header", True).csv(path)


# ------------------------------------------------------------- safe replacement
POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, of = _fs(spark, path)
    return fs.getFileStatus(of(path)).isDirectory()


def create_exclusively(spark: SparkSession, target: str, text: str) -> bool:
    """Write a small file that does not exist yet; False if it does.  It appears whole or not at all, and of two writers one gets True.

    Needs a file system whose rename refuses an existing target at once (HDFS and the like) or local disks.
    """
    fs, path = _fs(spark, target)
    jvm, final = spark.sparkContext._jvm, path(target)
    fs.mkdirs(final.getParent())
    aside = path(final.getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    try:
        if fs.getScheme() != "file":
            return not fs.exists(final) and fs.rename(aside, final)
        of = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
        try:  # a local rename would replace the target; a link never does
            jvm.java.nio.file.Files.createLink(of(final), of(aside))
        except Exception:
            if not fs.exists(final):
                raise
            return False
        return True
    finally:
        fs.delete(aside, False)


def read_small(spark: SparkSession, target: str) -> str:
    fs, path = _fs(spark, target)
    stream = fs.open(path(target))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _pointer(spark: SparkSession, table: str) -> tuple[int, str | None]:
    """Number and content of the newest pointer."""
    fs, path = _fs(spark, table)
    folder = path(f"{table}/{POINTER}")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    newest = max((int(n) for n in names if n.isdigit()), default=0)
    return newest, read_small(spark, f"{table}/{POINTER}/{newest:010d}") if newest else None


def current_version(spark: SparkSession, table: str) -> str | None:
    return _pointer(spark, table)[1]


def read_table(spark: SparkSession, table: str) -> DataFrame:
    version = current_version(spark, table)
    if version is None:
        raise FileNotFoundError(f"no published version of {table}")
    return spark.read.parquet(f"{table}/{version}")


def publish(
    df: DataFrame, table: str, checks: Callable[[DataFrame], DataFrame] | None = None, partition_by: Sequence[str] = (),
    empty_input: str = "skip",
) -> str | None:
    """Write a new version, check what was written, then switch readers over.

    ``checks`` returns ``check_name, passed``.  A failed check leaves the old
    version current; an empty result is skipped, refused (``fail``) or published
    (``keep``).  What is not published is removed.  If the pointer moved since the call began, the publish is refused.
    """
    if empty_input not in ("skip", "fail", "keep"):
        raise ValueError(f"empty_input must be skip, fail or keep: {empty_input!r}")
    spark = df.sparkSession
    seen = current_version(spark, table)
    version = f"v={uuid.uuid4().hex}"
    target = f"{table}/{version}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(target)
    written = spark.read.schema(df.schema).parquet(target)
    try:
        if empty_input != "keep" and not written.head(1):
            if empty_input == "fail":
                raise ValueError(f"refusing to publish an empty {table}")
            _remove(spark, target)
            return None
        if checks is not None:
            failed = [r.check_name for r in checks(written).where(~F.col("passed")).select("check_name").collect()]
            if failed:
                raise ValueError(f"checks failed for {table}: {failed}")
        move_pointer(spark, table, seen, version)
    except Exception:
        _remove(spark, target)
        raise
    return version


def move_pointer(spark: SparkSession, table: str, seen: str | None, version: str) -> None:
    """Make ``version`` current, unless another writer has moved the pointer from ``seen`` meanwhile.

    Pointers are numbered files, and the next number is created exclusively: of two publishers that saw the same
    version one succeeds.  Readers take the newest whole pointer.
    """
    number, now = _pointer(spark, table)
    if now != seen or not create_exclusively(spark, f"{table}/{POINTER}/{number + 1:010d}", version):
        raise RuntimeError(f"{table} was published by another writer")


def _remove(spark: SparkSession, target: str) -> None:
    fs, path = _fs(spark, target)
    fs.delete(path(target), True)
