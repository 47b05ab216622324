"""Tables as numbered manifests of partition folders.

A version is one small file that names, for every partition, the folders that hold its
rows.  A change writes folders for the partitions it touches and a next manifest
that repeats the entries of all others, so a reload of a week rewrites a week, and an
upsert of some keys rewrites their buckets, however large the table is.

Partitions are days or months of a date column (:func:`by_date`) or hash buckets of key
columns (:func:`by_bucket`).  Rows without a date form a partition of their own, which no window touches.

The next number is claimed by creating its file exclusively: of two writers one wins.  The
other starts again from the winner's version if that left its partitions alone, and gives
up with :class:`Conflict` if not.  Readers hold one manifest and never see a mix.  See :func:`maintenance.create_exclusively`
for the file systems that this holds on.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from saleswell.operators import maintenance

PART = "_part"
NONE = "none"


class Conflict(RuntimeError):
    """Another writer changed the same partitions first."""


@dataclass(frozen=True)
class Layout:
    """How rows are dealt to partitions: ``day`` or ``month`` of one column, or ``bucket`` of several."""

    kind: str
    columns: tuple[str, ...]
    buckets: int = 0

    def part(self) -> Column:
        if self.kind == "bucket":
            return F.pmod(F.xxhash64(*self.columns), F.lit(self.buckets)).cast("string")
        pattern = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}[self.kind]
        return F.coalesce(F.date_format(self.columns[0], pattern), F.lit(NONE))

    def covers(self, part: str, start: dt.date, end: dt.date) -> bool:
        """Whether a date partition meets the closed range."""
        if part == NONE:
            return False
        cut = 10 if self.kind == "day" else 7
        return start.isoformat()[:cut] <= part <= end.isoformat()[:cut]


def by_date(column: str, grain: str = "day") -> Layout:
    if grain not in ("day", "month"):
        raise ValueError(f"grain must be day or month: {grain!r}")
    return Layout(grain, (column,))


def by_bucket(keys: Sequence[str], buckets: int) -> Layout:
    if buckets < 1 or not keys:
        raise ValueError("at least one key and one bucket are needed")
    return Layout("bucket", tuple(keys), buckets)


@dataclass(frozen=True)
class Version:
    table: str
    number: int
    layout: Layout
    schema: T.StructType
    entries: tuple[tuple[str, str], ...]  # (partition, folder below the table)

    def folders(self, parts: Callable[[str], bool] = lambda _: True) -> list[str]:
        return [f"{self.table}/{folder}" for part, folder in self.entries if parts(part)]

    def parts(self) -> set[str]:
        return {part for part, _ in self.entries}

    def of(self, parts: set[str]) -> set[tuple[str, str]]:
        return {e for e in self.entries if e[0] in parts}


# --------------------------------------------------------------------- manifests
def _file(table: str, number: int) -> str:
    return f"{table}/versions/v{number:010d}.json"


def versions(spark: SparkSession, table: str) -> list[int]:
    fs, path = maintenance._fs(spark, table)
    folder = path(f"{table}/versions")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[1:11]) for n in names if n.startswith("v") and n.endswith(".json"))


def load(spark: SparkSession, table: str, number: int | None = None) -> Version:
    """One version, the newest for ``None``."""
    known = versions(spark, table)
    if not known or number is not None and number not in known:
        raise FileNotFoundError(f"{table} has no version {number or ''}".rstrip())
    number = known[-1] if number is None else number
    data = json.loads(maintenance.read_small(spark, _file(table, number)))
    kind, columns, buckets = data["layout"]
    return Version(table, number, Layout(kind, tuple(columns), buckets), T.StructType.fromJson(data["schema"]), tuple(map(tuple, data["entries"])))


def claim(spark: SparkSession, version: Version) -> bool:
    """Make ``version`` the next one; False if its number is taken.  The file appears whole or not at all."""
    layout = version.layout
    data = json.dumps({"layout": [layout.kind, layout.columns, layout.buckets], "schema": version.schema.jsonValue(), "entries": version.entries})
    return maintenance.create_exclusively(spark, _file(version.table, version.number), data)


def _write(df: DataFrame, table: str, layout: Layout, sort: Sequence[str]) -> tuple[str, list[tuple[str, str]]]:
    """Write rows below a folder of their own; its name and the entries for its partitions."""
    spark, folder = df.sparkSession, f"data/{uuid.uuid4().hex}"
    tagged = df.withColumn(PART, layout.part())
    # A rebalance splits partitions that hold much and puts small ones together.
    tagged.hint("rebalance", F.col(PART)).sortWithinPartitions(PART, *sort).write.partitionBy(PART).parquet(f"{table}/{folder}")
    fs, path = maintenance._fs(spark, table)
    names = [s.getPath().getName() for s in fs.listStatus(path(f"{table}/{folder}")) if s.isDirectory()]
    return folder, sorted((n.split("=", 1)[1], f"{folder}/{n}") for n in names if n.startswith(f"{PART}="))


def _read(spark: SparkSession, version: Version, parts: Callable[[str], bool] = lambda _: True) -> DataFrame:
    folders = version.folders(parts)
    return spark.read.schema(version.schema).parquet(*folders) if folders else spark.createDataFrame([], version.schema)


def _checked(written: DataFrame, table: str, checks: Callable[[DataFrame], DataFrame] | None) -> None:
    if checks is not None:
        failed = [r.check_name for r in checks(written).where(~F.col("passed")).select("check_name").collect()]
        if failed:
            raise ValueError(f"checks failed for {table}: {failed}")


def _commit(
    base: Version, df: DataFrame, touched: Callable[[str], bool], sort: Sequence[str], checks: Callable[[DataFrame], DataFrame] | None,
) -> Version:
    """Write ``df`` and claim the next number, in which it stands for the touched partitions.

    A partition that ``df`` has but the change does not touch keeps its folders beside the new one.
    """
    spark = df.sparkSession
    folder, added = _write(df.select(*base.schema.names), base.table, base.layout, sort)
    mine = {part for part, _ in added}
    try:
        _checked(_read(spark, replace(base, entries=tuple(added))), base.table, checks)
        seen = base
        while True:
            kept = tuple(e for e in seen.entries if not touched(e[0]))
            after = replace(seen, number=seen.number + 1, entries=kept + tuple(added))
            if claim(spark, after):
                return after
            newest = load(spark, base.table)
            theirs = {p for p in newest.parts() | base.parts() if touched(p)} | mine
            if newest.of(theirs) != base.of(theirs) or newest.schema != base.schema:
                raise Conflict(f"{base.table}: version {newest.number} changed the same partitions")
            seen = newest
    except Exception:
        maintenance._remove(spark, f"{base.table}/{folder}")
        raise


# ------------------------------------------------------------------------ writing
def create(df: DataFrame, table: str, layout: Layout, sort: Sequence[str] = (), checks: Callable[[DataFrame], DataFrame] | None = None) -> Version:
    """Version 1 of a new table."""
    base = Version(table, 0, layout, df.schema, ())
    if versions(df.sparkSession, table):
        raise Conflict(f"{table} exists")
    return _commit(base, df, lambda _: True, sort, checks)


def reload_window(
    table: str, new: DataFrame, start: dt.date, end: dt.date, sort: Sequence[str] = (), checks: Callable[[DataFrame], DataFrame] | None = None,
    base: Version | None = None,
) -> Version:
    """Replace the closed date range by the new rows, even days they lack; new rows outside it are added.

    Only partitions that meet the range are read (at month grain, for their rows outside it) and rewritten.
    """
    spark = new.sparkSession
    base = base or load(spark, table)
    if base.layout.kind == "bucket":
        raise ValueError(f"{table} has no date partitions")
    if start > end:
        raise ValueError(f"start {start} after end {end}")
    touched = lambda part: base.layout.covers(part, start, end)
    day = F.col(base.layout.columns[0]).cast("date")
    rows = new.select(*base.schema.names)
    if base.layout.kind == "month":
        rows = _read(spark, base, touched).where(~day.between(F.lit(start), F.lit(end))).unionByName(rows)
    return _commit(base, rows, touched, sort, checks)


def _touched_buckets(base: Version, changes: DataFrame) -> set[str]:
    """The buckets that the changes reach: at most as many names as the table has buckets."""
    if base.layout.kind != "bucket":
        raise ValueError(f"{base.table} has no key buckets")
    return {r[0] for r in changes.select(base.layout.part().alias(PART)).distinct().collect()}


def reload_keys(table: str, new: DataFrame, sort: Sequence[str] = (), base: Version | None = None) -> Version:
    """Replace every row whose key appears in the new rows; buckets without such keys are neither read nor written."""
    base = base or load(new.sparkSession, table)
    parts = _touched_buckets(base, new)
    old = _read(new.sparkSession, base, parts.__contains__)
    rows = maintenance.replace_keys(old, new.select(*base.schema.names), base.layout.columns)
    return _commit(base, rows, parts.__contains__, sort, None)


def upsert_buckets(table: str, source: DataFrame, ordinal: str, sort: Sequence[str] = (), base: Version | None = None) -> Version:
    """Merge changed rows by the table's one key, the last by ``ordinal`` winning; only buckets of changed keys are rewritten."""
    base = base or load(source.sparkSession, table)
    (key,) = base.layout.columns
    clean = source.withColumn(key, F.trim(key))
    parts = _touched_buckets(base, clean.where(F.col(key) != ""))
    merged = maintenance.upsert(_read(source.sparkSession, base, parts.__contains__), clean, key, ordinal)
    return _commit(base, merged.drop("change"), parts.__contains__, sort, None)


# ------------------------------------------------------------------------ reading
def read(spark: SparkSession, table: str, number: int | None = None) -> DataFrame:
    """A version whole."""
    return _read(spark, load(spark, table, number))


def read_window(spark: SparkSession, table: str, start: dt.date, end: dt.date, number: int | None = None) -> DataFrame:
    """The rows of a closed date range; folders of other partitions are not even listed."""
    version = load(spark, table, number)
    day = F.col(version.layout.columns[0]).cast("date")
    return _read(spark, version, lambda p: version.layout.covers(p, start, end)).where(day.between(F.lit(start), F.lit(end)))


def read_keys(spark: SparkSession, table: str, keys: DataFrame, number: int | None = None) -> DataFrame:
    """The rows of the given keys, from their buckets only."""
    version = load(spark, table, number)
    parts = _touched_buckets(version, keys)
    return _read(spark, version, parts.__contains__).join(keys.select(*version.layout.columns).distinct(), list(version.layout.columns), "left_semi")


def vacuum(spark: SparkSession, table: str, keep: int = 2) -> list[str]:
    """Forget all but the newest ``keep`` versions and remove the folders that no kept one names.

    Not safe beside a writer: what it has written is named by no version yet.
    """
    if keep < 1:
        raise ValueError(f"at least one version stays: {keep}")
    known = versions(spark, table)
    fs, path = maintenance._fs(spark, table)
    named = {"/".join(folder.split("/")[:3]) for n in known[-keep:] for _, folder in load(spark, table, n).entries}
    for n in known[:-keep]:
        fs.delete(path(_file(table, n)), False)
    gone = []
    for run in fs.listStatus(path(f"{table}/data")):
        for part in fs.listStatus(run.getPath()):
            name = f"data/{run.getPath().getName()}/{part.getPath().getName()}"
            if part.isDirectory() and name not in named:
                fs.delete(part.getPath(), True)
                gone.append(name)
    return sorted(gone)
