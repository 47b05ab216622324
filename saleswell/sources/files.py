"""Readers for landed files.

Reads are schema-first.  The only driver-side work is metadata: column names and the newest file's name.
"""

from __future__ import annotations

import csv
import datetime as dt
import functools
import io
import itertools
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from saleswell.functions.calendar import try_date
from saleswell.session import cut_lineage

ENCODINGS = ("utf-8", "windows-1252", "iso-8859-1")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, gzip included; fields outside the schema are dropped."""
    return spark.read.schema(schema).json(path)


def load_jsonl_inferred(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Exploratory staging load: infer the schema, replace the target."""
    spark.read.json(path).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text with a header; dashes in names become underscores."""
    df = (
        spark.read.option("sep", "\t").option("header", True).option("mode", "PERMISSIVE")
        .option("quote", "\u0000").csv(path)
    )
    return df.toDF(*[c.strip().replace("-", "_") for c in df.columns])


@functools.cache
def _windows_marks() -> tuple[str, str]:
    """The bytes that windows-1252 reads otherwise than Latin-1: as Latin-1 characters, and their meaning."""
    codes = [c for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", "ignore")]
    return "".join(map(chr, codes)), "".join(bytes([c]).decode("cp1252") for c in codes)


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8", multiline: bool = False) -> DataFrame:
    """CSV with a header, all strings, byte-order mark removed from the first name.

    ``multiline`` allows line breaks inside quotes, at the price of unsplittable files.
    """
    # Spark reads no Windows code page; its bytes are Latin-1 but for one range of marks.
    windows = encoding == ENCODINGS[1]
    df = (
        spark.read.option("header", True).option("encoding", "iso-8859-1" if windows else encoding).option("escape", '"')
        .option("multiLine", multiline).csv(path)
    )
    if windows:
        codes, marks = _windows_marks()
        df = df.withColumns({c: F.translate(f"`{c}`", codes, marks) for c in df.columns})
    return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])


# ------------------------------------------------- files of several encodings and headers
#: Bytes that windows-1252 leaves undefined, as Latin-1 characters.
_UNDEFINED = "[\u0081\u008d\u008f\u0090\u009d]"


def _lines(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    """Lines as bytes, with their file and the start of their block.  Files are split like any text, none is held whole."""
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path).select(
        F.col("value").cast("binary").alias("raw"), F.is_valid_utf8("value").alias("utf8"),
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
    )


def file_profiles(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``path, encoding, head``: per file the first encoding that decodes all its lines, and its first two lines as bytes.

    One scan and one aggregate that combines on the map side.  A file's first two lines are neighbours in its first block, so
    one has an even number there and one an odd number: the least of each are the two.
    """
    lines = _lines(spark, path, pattern).withColumn("id", F.monotonically_increasing_id())
    first = lambda odd: F.min(F.when((F.col("at") == 0) & (F.col("id") % 2 == odd), F.struct("id", "raw")))
    windows = ~F.decode("raw", "ISO-8859-1").rlike(_UNDEFINED)
    found = lines.groupBy("path").agg(F.bool_and("utf8").alias("utf8"), F.bool_and(windows).alias("windows"), F.array_sort(F.array_compact(F.array(first(0), first(1)))).alias("head"))
    encoding = F.when(F.col("utf8"), ENCODINGS[0]).when(F.col("windows"), ENCODINGS[1]).otherwise(ENCODINGS[2])
    return found.select("path", encoding.alias("encoding"), F.col("head.raw").alias("head"))


def decoded(raw: Column, encoding: Column) -> Column:
    """Text of bytes in one of :data:`ENCODINGS`, row by row."""
    latin = F.decode(raw, "ISO-8859-1")
    codes, marks = _windows_marks()
    return F.when(encoding == ENCODINGS[0], F.decode(raw, "UTF-8")).when(encoding == ENCODINGS[1], F.translate(latin, codes, marks)).otherwise(latin)


def detect_encoding(spark: SparkSession, path: str) -> str:
    """First encoding that decodes every file below a path; the last one decodes anything."""
    worst = functools.reduce(lambda a, e: F.when(F.col("encoding") == e, ENCODINGS.index(e)).otherwise(a), ENCODINGS[1:], F.lit(0))
    return ENCODINGS[file_profiles(spark, path).agg(F.max(worst)).first()[0] or 0]


def read_csv_any_encoding(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """CSV files with a header line, each in its own encoding and with its own columns; all strings, columns united by name."""
    return _read_headed(spark, path, pattern, 1)


def _cells(text: str) -> list[str]:
    return next(csv.reader(io.StringIO(text)), [])


def _names(head: list[bytes], encoding: str, rows: int) -> list[str]:
    """Column names from a file's header lines; none if the file is too short."""
    codec = {"windows-1252": "cp1252"}.get(encoding, encoding)
    cells = [_cells(bytes(line).decode(codec).removeprefix("\ufeff")) for line in head[:rows]]
    if len(cells) < rows:
        return []
    return flatten_headers(*cells) if rows == 2 else [c.strip() or f"col_{i}" for i, c in enumerate(cells[0])]


def file_layouts(spark: SparkSession, path: str, pattern: str | None, rows: int) -> DataFrame:
    """``path, encoding, head, names`` of the files that have their header lines, computed once."""

    def run(frames):
        for frame in frames:
            frame["names"] = [_names(list(h), e, rows) for h, e in zip(frame["head"], frame["encoding"])]
            yield frame

    profiles = file_profiles(spark, path, pattern)
    named = profiles.mapInPandas(run, "path string, encoding string, head array<binary>, names array<string>")
    return cut_lineage(named.where(F.size("names") > 0))


def _read_headed(spark: SparkSession, path: str, pattern: str | None, rows: int) -> DataFrame:
    """Rows of files with ``rows`` header lines, and ``_file``.

    Layouts stay a table that joins the lines by their file; only the distinct column names, and the largest number of columns, reach
    the driver.  Of columns that a file names alike the first counts.  Rows of a split file carry no position, so header lines are
    told apart by content.  Rows without any value are dropped.
    """
    layouts = file_layouts(spark, path, pattern, rows)
    names = sorted(r[0] for r in layouts.select(F.explode("names")).distinct().collect())
    if not names:
        raise FileNotFoundError(f"no {pattern or 'file'} with {rows} header lines under {path}")
    width = layouts.agg(F.max(F.size("names"))).first()[0]
    places = F.transform(F.array(*map(F.lit, names)), lambda n: F.array_position("names", n).cast("int"))
    known = layouts.select("path", "encoding", F.slice("head", 1, rows).alias("head"), places.alias("places"))
    lines = _lines(spark, path, pattern).select("path", "raw").join(known, "path").where(~F.array_contains("head", F.col("raw")))
    schema = ", ".join(f"c{i} string" for i in range(width))
    parsed = lines.select("path", "places", F.from_csv(decoded(F.col("raw"), F.col("encoding")), schema, {"escape": '"'}).alias("r"))
    cells = parsed.select("path", "places", F.array(*[F.nullif(F.trim(f"r.c{i}"), F.lit("")) for i in range(width)]).alias("cells"))
    file = F.replace(F.element_at(F.split("path", "/"), -1), F.lit("%20"), F.lit(" "))
    value = lambda k: F.get("cells", F.get("places", F.lit(k)) - 1)
    return cells.where(F.exists("cells", lambda c: c.isNotNull())).select(*[value(k).alias(n) for k, n in enumerate(names)], file.alias("_file"))


# ----------------------------------------------------------- two-row header CSV
def normalize_name(name: str | None) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9]", "_", name or "")).strip("_").lower()


def flatten_headers(top: Sequence[str | None], bottom: Sequence[str | None]) -> list[str]:
    """Column names of a two-row header: the category carried to the right, joined to the metric.

    Columns before any category belong to "Info"; a column without a metric is named by its own
    category cell, and one without either by its position.
    """
    own = [(cell or "").strip() for cell in top]
    metrics = [(cell or "").strip() for cell in itertools.islice(itertools.chain(bottom, itertools.repeat("")), len(own))]
    carried = itertools.accumulate(own, lambda before, cell: cell or before, initial="Info")
    next(carried)
    labels = [f"{category}_{metric}" if metric else cell for category, metric, cell in zip(carried, metrics, own)]
    return [normalize_name(label) or f"col_{i}" for i, label in enumerate(labels)]


def read_reports(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Every matching two-header report under a folder, recursively, whatever its columns and encoding.

    Columns are united by name.  Values stay text (:func:`numeric_columns` types them), all-blank rows are dropped, and a
    file whose name carries no period gives no rows.
    """
    rows = _read_headed(spark, path, pattern, 2)
    start, end = report_period(F.col("_file"))
    out = rows.select("*", start.alias("report_start_date"), end.alias("report_end_date"), F.col("_file").alias("source_file"))
    return out.drop("_file").where(F.col("report_start_date").isNotNull())


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def report_period(name: Column) -> tuple[Column, Column]:
    """Start and end date in a file name: ``1-15-26 to 1-21-26`` or with underscores."""
    out = []
    for group in (1, 2):
        dashed = F.regexp_extract(name, r"(\d{1,2}-\d{1,2}-\d{2}) to (\d{1,2}-\d{1,2}-\d{2})", group)
        lined = F.regexp_extract(name, r"(\d{1,2}_\d{1,2}_\d{2})_to_(\d{1,2}_\d{1,2}_\d{2})", group)
        text = F.coalesce(F.nullif(dashed, F.lit("")), F.replace(F.nullif(lined, F.lit("")), F.lit("_"), F.lit("-")))
        out.append(try_date(text, "M-d-yy"))
    return out[0], out[1]


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str:
    """Newest matching file by modification time; content is never read."""
    found = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        .agg(F.max_by("path", "modificationTime").alias("path")).first()
    )
    if found.path is None:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return found.path


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.md", skip: Sequence[str] = ("README.md",)) -> DataFrame:
    """Whole text files, one row each: ``file_name, content``."""
    df = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return df.select(name.alias("file_name"), F.col("value").alias("content")).where(~F.col("file_name").isin(*skip))


def read_audit_tail(lines: DataFrame, schema: str, time_column: str, limit: int) -> DataFrame:
    """Newest entries of a JSON-lines log; malformed lines are skipped, entries of one time follow by their content."""
    if limit < 0:
        raise ValueError(f"limit must not be negative: {limit}")
    parsed = lines.select(F.from_json("value", schema).alias("e")).where(F.col(f"e.{time_column}").isNotNull())
    return parsed.orderBy(F.desc(f"e.{time_column}"), F.to_json("e")).select("e.*").limit(limit)


def created_since(manifest: DataFrame, since: dt.datetime, column: str = "created_time") -> DataFrame:
    """Report manifest entries not older than ``since``; entries without a time stay."""
    return manifest.where(F.col(column).isNull() | (F.col(column) >= F.lit(since)))
