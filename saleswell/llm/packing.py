"""Conflict-constrained best-fit packing of texts into bins of bounded length.

Pieces (texts, or the parts of a text longer than a bin) are dealt to shards by
a salted hash, so that no source or group of copies fills a shard; a shard holds a
bounded amount of text.  In a shard the pieces go, longest first, into bins kept
in the order of their residual space.  A bin carries two bitmaps, of the
sources and of the duplicate clusters it holds.  The search starts at the successor of the
piece's length among the residuals and goes on upwards until a bin accepts the
piece: the tightest bin without a conflict.  None: a new bin.

A bin holds no two texts of one cluster, and of one source at most PER_SOURCE
pieces (one bit for each).  By default a text's cluster is the hash of its lower-cased words.

Length is counted in words.  Null, empty and blank texts have length 0 and get no
bin (null).  A null source is a source of its own.  Rows are told apart by position, so
repeated rows and ids are all packed.  Cutting a long text keeps every character:
its parts joined give the text back.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from saleswell.llm.common import byte_texts, slices, word_chunks

CAPACITY, PER_SOURCE = 2048, 4
#: Bytes of text in a shard, about.
SHARD_BYTES = 1 << 20
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def best_fit(length: list[int], source: list[int], cluster: list[int], capacity: int, per_source: int = PER_SOURCE) -> list[int]:
    """Bin of each piece.  ``source`` and ``cluster`` are small numbers; cluster -1 conflicts with nothing."""
    free: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    place = [-1] * len(length)
    lane = (1 << per_source) - 1
    for i in sorted(range(len(length)), key=lambda k: (-length[k], k)):
        shift, mine = source[i] * per_source, (1 << cluster[i] if cluster[i] >= 0 else 0)
        at = bisect_left(free, (length[i], -1))
        while at < len(free):
            b = free[at][1]
            if not clusters[b] & mine and (sources[b] >> shift) & lane != lane:
                break
            at += 1
        if at < len(free):
            left, b = free.pop(at)
        else:
            left, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        held = (sources[b] >> shift) & lane
        sources[b] |= (held + 1) << shift  # 0, 1, 11, 111: the lowest unset bit
        clusters[b] |= mine
        place[i] = b
        if left > length[i]:
            insort(free, (left - length[i], b))
    return place


def cut(data: bytes, capacity: int) -> list[tuple[int, bytes]]:
    """Parts of at most ``capacity`` words with their lengths; joined they are the text."""
    n = sum(map(len, word_chunks(data)))
    if n <= capacity:
        return [(n, data)]
    parts, begin, k = [], 0, 0
    for m in WORD.finditer(data):
        if k == capacity:
            parts.append((k, data[begin : m.start()]))
            begin, k = m.start(), 0
        k += 1
    return [*parts, (k, data[begin:])]


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, with_text: bool = False, cluster: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, piece, n_pieces, n_words, bin_id, bin_words, position (from 0), offset (words before it), [text].

    ``bin_id`` is shard-bin; a text without words has a null bin.  ``cluster`` names a column of duplicate groups (null: none).
    """
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit("\x00null"))).alias("source"),
        *([F.when(F.col(cluster).isNotNull(), F.xxhash64(F.col(cluster).cast("string"))).alias("cluster")] if cluster else []),
    )

    def pieces(batches):
        seq = 0
        for batch in slices(batches, "text", 4 << 20):
            out = {k: [] for k in ("shard", "doc_id", "piece", "n_pieces", "n_words", "source", "cluster", "text")}
            own = batch.column("cluster").to_pylist() if cluster else None
            for k, (doc, data, src) in enumerate(zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text")), batch.column("source").to_pylist())):
                parts = cut(data, capacity)
                h = xxhash.xxh64()
                for words in word_chunks(data.lower()):
                    h.update(b" ".join(words) + b" ")
                code = own[k] if own is not None else h.intdigest() >> 1
                for j, (n, part) in enumerate(parts):
                    seq += 1
                    # The salt is the row's place in its batch stream and its content: copies, repeated rows and hot sources spread evenly.
                    salt = xxhash.xxh64_intdigest(f"{doc}:{j}:{code}".encode(), seq)
                    for key, v in zip(out, (salt % shards, doc, j, len(parts), n, src, code, part if with_text else None)):
                        out[key].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), kinds)], names=list(out))

    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("n_words", "ascending"), ("cluster", "ascending")])
        n = np.asarray(t.column("n_words"))
        shard = t.column("shard")[0].as_py()
        has = np.flatnonzero(n > 0)
        _, src = np.unique(np.asarray(t.column("source"))[has], return_inverse=True)
        code = np.where(t.column("cluster").is_valid().to_numpy()[has], t.column("cluster").fill_null(0).to_numpy()[has], np.arange(len(has)))
        _, group, size = np.unique(code, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(size > 1)  # a cluster with one piece here conflicts with nothing
        number = np.full(len(size), -1)
        number[shared] = np.arange(len(shared))
        bins = np.full(len(n), -1)
        bins[has] = best_fit(n[has].tolist(), src.tolist(), number[group].tolist(), capacity, per_source)
        order = np.lexsort((np.arange(len(n)), -n, bins))
        b = bins[order]
        start = np.concatenate([[True], b[1:] != b[:-1]]) if len(b) else np.empty(0, bool)
        first = np.maximum.accumulate(np.where(start, np.arange(len(b)), 0))
        before = np.cumsum(n[order]) - n[order]
        position, offset = np.empty(len(n), np.int32), np.empty(len(n), np.int64)
        position[order], offset[order] = np.arange(len(b)) - first, before - before[first]
        fill = np.bincount(bins[has], n[has], minlength=1).astype(np.int64)
        none = bins < 0
        cols = {
            "doc_id": t.column("doc_id"), "piece": t.column("piece"), "n_pieces": t.column("n_pieces"), "n_words": t.column("n_words"),
            "bin_id": pa.array([None if x < 0 else f"{shard}-{x}" for x in bins.tolist()], pa.string()),
            "bin_words": pa.array(fill[np.maximum(bins, 0)], mask=none), "position": pa.array(position, mask=none), "offset": pa.array(offset, mask=none),
        }
        if with_text:
            cols["text"] = t.column("text").cast(pa.string())
        return pa.table(cols)

    schema = "doc_id long, piece int, n_pieces int, n_words long, bin_id string, bin_words long, position int, offset long"
    parts = rows.mapInArrow(pieces, "shard long, doc_id long, piece int, n_pieces int, n_words long, source long, cluster long, text binary")
    return parts.groupBy("shard").applyInArrow(place, schema + (", text string" if with_text else ""))
