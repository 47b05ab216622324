"""Helpers shared by the operators of this subpackage.

Words are runs of bytes other than space and ``\\x09``-``\\x0D``; ``bytes.split()``
cuts at exactly these.  Work on whole columns of numbers inside a task travels
between tasks as *parcels*: one row per (shard, batch) with the shard's part of
each array packed into one binary cell.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from saleswell.session import cut_lineage, work_folder

SPACE = re.compile(rb"[\x20\x09-\x0d]")
PARCEL = "shard long, parcel binary"
#: A-Z in lower case; every ASCII character other than letters and digits a space.
TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, survives lost executors."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, df: DataFrame) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def word_chunks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size, in order."""
    at = 0
    while len(data) - at > size and (m := SPACE.search(data, at + size)):
        yield data[at : m.start()].split()
        at = m.start()
    yield data[at:].split()


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name``, the row's place (from 1) in the whole order.

    Rows are dealt by ranges of the order, and a row's place is the number of rows in
    earlier ranges and before it in its own.  Rows that the order leaves equal are
    told apart by where they stood, so equal rows are split too.
    """
    stood, part = free_name("__stood", df), free_name("__part", df)
    keys = [*order, F.col(stood)]
    ranged = df.withColumn(stood, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = store(ranged.drop(stood).withColumn(name, F.monotonically_increasing_id()).withColumn(part, F.shiftright(name, 33)), "numbered")
    before = Window.orderBy(F.col(part)).rowsBetween(Window.unboundedPreceding, -1)
    start = placed.groupBy(part).agg(F.count("*").alias("n")).select(F.col(part), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(free_name("__start", df)))
    place = F.col(name) - F.shiftleft(F.col(part), 33) + F.col(start.columns[1]) + 1
    return placed.join(start, part).withColumn(name, place).select(*df.columns, name)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads what is equal in few bits over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of any lengths in one cell."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], dtype=np.int64).tobytes()
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(cell, kinds: list) -> list[np.ndarray]:
    buf = memoryview(cell)
    n = np.frombuffer(buf, np.int64, 1 + len(kinds))[1:]
    at, out = 8 * (1 + len(kinds)), []
    for k, kind in zip(n.tolist(), kinds):
        size = np.dtype(kind).itemsize
        out.append(np.frombuffer(buf, np.uint8, k * size, at).view(kind) if (at % 8 == 0) else np.frombuffer(bytes(buf[at : at + k * size]), kind))
        at += k * size
    return out


def parcels(shard: np.ndarray, arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of PARCEL: the entries of each shard that occurs."""
    if len(shard) == 0:
        return
    order = np.argsort(shard, kind="stable")
    s = shard[order]
    cuts = np.flatnonzero(np.diff(s)) + 1
    first, last = [0, *cuts.tolist()], [*cuts.tolist(), len(s)]
    sorted_arrays = [a[order] for a in arrays]
    cells = [pack([a[i:j] for a in sorted_arrays]) for i, j in zip(first, last)]
    yield parcel_batch(s[first].astype(np.int64), cells)


def parcel_batch(shards: np.ndarray, cells: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(cells, pa.binary())], names=["shard", "parcel"])


def gather(column, kinds: list) -> list[np.ndarray]:
    """All parcels of a shard, joined."""
    parts = [unpack(x.as_buffer(), kinds) for x in column if x.is_valid]
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, k) for i, k in enumerate(kinds)]


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the edges a-b among n nodes of one task."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Alternates two contractions until nothing changes.  Large star: each node
    hands its larger neighbours to its smallest one; small star: each node
    hands itself and its smaller neighbours to the smallest.  Minima are combined before the
    shuffle and joined back, so a node with very many edges is
    split by the skew join and is never gathered in one task.
    """
    e = cut_lineage(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = cut_lineage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
