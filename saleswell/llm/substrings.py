"""Exact removal of repeated 50-word passages by recompression.

A text is parsed in rounds.  The first names runs of one token; each round then
names pairs: a hash bit puts every symbol left or right, and a left symbol
followed by a right one becomes one symbol.  A name is a 64-bit hash of what it
stands for, so all tasks agree on it without an exchange and equal
passages get equal symbols, except near their ends, where what stands outside
may have joined in.

That margin is known exactly: for every window of 50 words the rounds also carry
the first and the last boundary that no outside text can change.  The core
between them depends on the window's words alone.  A window is filed under one symbol
of its core, the one of least hash at the highest level where the core has
CORE symbols (level 0 always has 50): equal windows are filed alike, wherever they
stand.  In a shuffle by symbol, symbols that two documents share reveal possible repeats,
and the windows filed there are verified by their own hashes (64 bits beside the symbol's 64).
Heavy symbols, found by counts beforehand, are dealt by symbol and window hash, so none is bound to one task.

Before the shuffle, windows that repeat within a batch are settled: all but those of the smallest
doc_id are known to be repeats.  A passage thus leaves a batch once, however many
documents share it.  Very long texts are parsed in overlapping parts, which by construction file
their windows as the whole would.

Null and blank texts have no words.  Rows with a null doc_id lose nothing and cause no removal.  Rows that repeat a doc_id are
the same document (neither removes from the other) and are answered one by one.  Extra columns are kept by the filter and ignored by the report.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from saleswell.llm.common import PARCEL, byte_texts, free_name, gather, mix, pack, parcel_batch, parcels, slices, store, word_chunks

WINDOW = 50
ROUNDS, CORE = 5, 3
#: Bytes of text filed in one shard, about.
SHARD_BYTES = 3 << 20
BATCH_BYTES = 2 << 20
#: A symbol with this many windows for each byte of a shard is heavy, about half of a shard's windows.
HEAVY = 1 / 12
#: Words parsed at once; longer texts overlap by a window less one word.
PART = 1 << 19
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SEGMENT = [np.uint64, np.int64, np.int64, np.int64, np.uint16, np.uint64]
_RANGE = [np.int64, np.int64, np.int64, np.int64]


def token_names(data: bytes) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    parts = [np.fromiter(map(digest, words), np.uint64, len(words)) for words in word_chunks(data)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _window_hashes(names: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of the windows that start at ``at``."""
    n = len(names)
    power = np.cumprod(np.full(n, _BASE, np.uint64))
    inverse = np.cumprod(np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(names) * power, dtype=np.uint64)])
    return mix((total[at + window] - total[at]) * inverse[at])


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first:last] for each (non-empty) range, by tables of doubling reach."""
    out = np.empty(len(first), np.uint64)
    size = last - first
    reach, row, todo = 1, values, np.ones(len(first), bool)
    while todo.any():
        now = todo & (size < 2 * reach)
        out[now] = np.minimum(row[first[now]], row[last[now] - reach])
        todo &= ~now
        if todo.any():
            row = np.minimum(row[:-reach], row[reach:])
            reach *= 2
    return out


def filing_symbols(names: np.ndarray, opens: np.ndarray, at: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS, core: int = CORE) -> np.ndarray:
    """The symbol under which each window is filed.

    names: token names of texts laid end to end; opens: whether a token opens a
    text; at: where the windows start (each within one text).
    """
    first, last = at.astype(np.int32), (at + window).astype(np.int32)
    levels = [(names, first, last)]
    for r in range(rounds + 1):
        m = len(names)
        if r == 0:  # runs; the run at either end may go on outside
            starts = opens.copy()
            starts[1:] |= names[1:] != names[:-1]
            new = np.cumsum(starts, dtype=np.int32) - 1
            first, last = new[first] + 1, new[last - 1]
            where = np.flatnonzero(starts)
            length = np.diff(np.append(where, m)).astype(np.uint64)
            merged = np.where(length > 1, mix(names[where] ^ mix(length)), names[where])
        else:  # pairs; a right symbol at the beginning and a left one at the end may have a partner outside
            right = (mix(names + np.uint64(r)) & np.uint64(1)).astype(bool)
            starts = np.ones(m, bool)
            starts[1:] = opens[1:] | ~right[1:] | right[:-1]
            new = np.concatenate([np.cumsum(starts, dtype=np.int32) - 1, np.array([starts.sum()], np.int32)])
            f, g = np.minimum(first, m - 1), np.maximum(last - 1, 0)
            first, last = new[np.minimum(first + right[f], m)], new[np.maximum(last - ~right[g], 0)]
            where = np.flatnonzero(starts)
            merged = names[where]
            pair = np.diff(np.append(where, m)) == 2
            left = where[pair]
            merged[pair] = mix(names[left] * np.uint64(3) + mix(names[left + 1] + np.uint64(r)))
        names, opens = merged, opens[where]
        levels.append((names, first, last))
    out = np.empty(len(at), np.uint64)
    open_ = np.arange(len(at))
    for level in range(rounds + 1, -1, -1):
        names, first, last = levels[level]
        size = last[open_] - first[open_]
        now = size >= (core if level else 1)
        if now.any():
            k = open_[now]
            out[k] = mix(_least(mix(names ^ np.uint64(0xA5A5)), first[k], last[k]) + np.uint64(level))
        open_ = open_[~now]
    return out


def _ranges(doc: np.ndarray, text: np.ndarray, start: np.ndarray, window: int) -> list[np.ndarray]:
    """Unions (doc, text, begin, end) of the windows at ``start``."""
    order = np.lexsort((start, text, doc))
    doc, text, start = doc[order], text[order], start[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (start[1:] > start[:-1] + window)
    where = np.flatnonzero(fresh)
    end = (start + window)[np.append(where[1:], len(doc)) - 1] if len(doc) else start
    return [doc[where], text[where], start[where], end]


def _above_least(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller doc holds the same (a, b)."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    where = np.flatnonzero(fresh)
    least = np.minimum.reduceat(doc[order], where) if len(a) else doc
    out = np.empty(len(a), bool)
    out[order] = doc[order] > np.repeat(least, np.diff(np.append(where, len(a))))
    return out


def shard_of(symbol: np.ndarray, verify: np.ndarray, shards: int, heavy: np.ndarray) -> np.ndarray:
    """Shards of windows: by their symbol, for ``heavy`` (sorted) symbols by symbol and window hash; equal windows meet."""
    out = (symbol % np.uint64(shards)).astype(np.int64)
    if len(heavy):
        some = np.flatnonzero(heavy[np.minimum(np.searchsorted(heavy, symbol), len(heavy) - 1)] == symbol)
        out[some] = (mix(symbol[some] ^ mix(verify[some])) % np.uint64(shards)).astype(np.int64)
    return out


def heavy_symbols(rows: DataFrame, total: int, window: int, most: int) -> np.ndarray:
    """Sorted symbols under which ``most`` windows or more are filed (and some with half as many).

    A slice of text tells the symbols with at least its share of ``most`` / 2, so less than ``most`` / 2 of a symbol
    stay untold.  There are at most 2 / ``most`` as many such symbols as windows.
    """
    # Holds while slices have a quarter of BATCH_BYTES on average.
    least = max(1, most * BATCH_BYTES // (8 * max(total, BATCH_BYTES)))

    def count(batches):
        for batch in slices(batches, "text", BATCH_BYTES):
            names = [token_names(t) for t in byte_texts(batch.column("text"))]
            symbol = _laid(names, window)[0]
            key, n = np.unique(symbol, return_counts=True)
            told = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(key[told].view(np.int64)), pa.array(n[told], pa.int64())], names=["symbol", "n"])

    counts = store(rows.select("text").mapInArrow(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).where(f"n >= {-(-most // 2)}"), "heavy-symbols")
    return np.sort(np.array([r["symbol"] for r in counts.select("symbol").collect()], np.int64).view(np.uint64))


def _laid(names: list[np.ndarray], window: int) -> tuple[np.ndarray, ...]:
    """(symbol, verifying hash, text, start) of every window of the texts; long texts are parsed in overlapping parts."""
    size = np.array([len(x) for x in names], np.int64)
    begin = np.cumsum(size) - size
    parts = []  # (text, first word, words)
    for k, n in enumerate(size.tolist()):
        at = 0
        while n - at >= window:
            parts.append((k, at, min(PART, n - at)))
            if at + PART >= n:
                break
            at += PART - window + 1
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    all_names = np.concatenate(names)
    k, at, n = (np.array(x, np.int64) for x in zip(*parts))
    left, own = (lambda c: (np.cumsum(c) - c, np.cumsum(c)))(n)
    place = np.arange(own[-1]) - np.repeat(left, n) + np.repeat(begin[k] + at, n)
    flat = all_names[place]
    opens = np.zeros(len(flat), bool)
    opens[left] = True
    windows = n - window + 1
    step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    where = np.repeat(left, windows) + step
    verify = _window_hashes(flat, where, window)
    return filing_symbols(flat, opens, where, window), verify, np.repeat(k, windows), np.repeat(at, windows) + step


def _bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def repeated_ranges(docs: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, text_key, ranges: the word ranges to remove (pairs begin, end as int64 bytes), for documents with any."""
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(64, -(-total // shard_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").where("doc_id is not null and text is not null")

    heavy = docs.sparkSession.sparkContext.broadcast(heavy_symbols(rows, total, window, max(2, int(shard_bytes * HEAVY))))

    def file(docs_, keys, names):
        """Parcels of one batch: windows by symbol, and settled ranges by document (shards from ``shards`` on)."""
        symbol, verify, text, start = _laid(names, window)
        if len(symbol) == 0:
            return
        doc, key = docs_[text], keys[text]
        known = _above_least(symbol, verify, doc)
        if known.any():
            settled = _ranges(doc[known], key[known], start[known], window)
            yield from parcels(shards + _bucket(settled[0], shards), settled)
        keep = np.flatnonzero(~known)
        symbol, verify, text, start = symbol[keep], verify[keep], text[keep], start[keep]
        place = shard_of(symbol, verify, shards, heavy.value)
        fresh = np.ones(len(keep), bool)
        fresh[1:] = (place[1:] != place[:-1]) | (symbol[1:] != symbol[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
        seg = np.flatnonzero(fresh)
        length = np.diff(np.append(seg, len(keep)))
        while length.max(initial=0) > 65535:  # runs of one token in long texts
            extra = np.concatenate([np.arange(s + 65535, s + n, 65535) for s, n in zip(seg[length > 65535].tolist(), length[length > 65535].tolist())])
            seg = np.union1d(seg, extra)
            length = np.diff(np.append(seg, len(keep)))
        shard = place[seg]
        order = np.argsort(shard, kind="stable")
        shard, seg, length = shard[order], seg[order], length[order]
        at_window = np.concatenate([[0], np.cumsum(length)])
        pick = np.arange(at_window[-1]) - np.repeat(at_window[:-1], length) + np.repeat(seg, length)
        verify = verify[pick]
        cuts = np.flatnonzero(np.diff(shard)) + 1
        arrays = [symbol[seg], docs_[text[seg]], keys[text[seg]], start[seg], length.astype(np.uint16)]
        cells, ids = [], []
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
            cells.append(pack([*(x[i:j] for x in arrays), verify[at_window[i] : at_window[j]]]))
            ids.append(shard[i])
        yield parcel_batch(np.array(ids), cells)

    def parse(batches):
        for batch in slices(batches, "text", BATCH_BYTES):
            names = [token_names(t) for t in byte_texts(batch.column("text"))]
            yield from file(np.asarray(batch.column("doc_id")), np.asarray(batch.column("text_key")), names)

    def settle(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        if shard >= shards:
            return pa.table({"shard": pa.array([shard - shards] * t.num_rows, pa.int64()), "parcel": t.column("parcel")})
        symbol, doc, key, start, length, verify = gather(t.column("parcel"), _SEGMENT)
        length = length.astype(np.int64)
        again = np.flatnonzero(_above_least(np.repeat(symbol, length), verify, np.repeat(doc, length)))
        del symbol, verify
        own = np.repeat(np.arange(len(length), dtype=np.int32), length)[again]  # the segment of each window found
        start = start[own] + again - (np.cumsum(length) - length)[own]
        found = _ranges(doc[own], key[own], start, window)
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(list(parcels(_bucket(found[0], shards), found)), pa.schema([("shard", pa.int64()), ("parcel", pa.binary())]))

    def unite(t: pa.Table) -> pa.Table:
        doc, key, begin, end = gather(t.column("parcel"), _RANGE)
        order = np.lexsort((begin, key, doc))
        doc, key, begin, end = doc[order], key[order], begin[order], end[order]
        other = np.ones(len(doc), bool)
        other[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        where = np.flatnonzero(other)
        cells = [np.stack([begin[i:j], end[i:j]], axis=1).tobytes() for i, j in zip(where.tolist(), [*where[1:].tolist(), len(doc)])]
        return pa.table({"doc_id": pa.array(doc[where], pa.int64()), "text_key": pa.array(key[where], pa.int64()), "ranges": pa.array(cells, pa.binary())})

    filed = rows.mapInArrow(parse, PARCEL)
    settled = filed.groupBy("shard").applyInArrow(settle, PARCEL)
    return settled.groupBy("shard").applyInArrow(unite, "doc_id long, text_key long, ranges binary")


def removed_mask(n: int, cell: bytes | None) -> np.ndarray:
    """Which of n words the ranges cover."""
    step = np.zeros(n + 1, np.int64)
    if cell:
        r = np.frombuffer(cell, np.int64).reshape(-1, 2)
        np.add.at(step, r[:, 0], 1)
        np.add.at(step, r[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def _with_ranges(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a further column, of the returned name, for the ranges."""
    doc, key, ranges = (free_name(c, docs) for c in ("__id", "__key", "__ranges"))
    found = repeated_ranges(docs).withColumnsRenamed({"doc_id": doc, "text_key": key, "ranges": ranges})
    on = (docs["doc_id"].cast("long") == found[doc]) & (F.xxhash64(docs["text"]) == found[key])
    return docs.join(found, on, "left").drop(doc, key), ranges


def removal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) for every row."""

    rows, ranges = _with_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def run(batches):
        for batch in slices(batches, "text", 4 << 20):
            n_words, n_removed, sha = [], [], []
            for data, cell in zip(byte_texts(batch.column("text")), batch.column(ranges).to_pylist()):
                digest, at, gone = hashlib.sha256(), 0, 0
                mask = removed_mask(sum(map(len, word_chunks(data))), cell) if cell else None
                sep = b""
                for words in word_chunks(data):
                    kept = words if mask is None else [w for w, m in zip(words, mask[at : at + len(words)].tolist()) if not m]
                    at, gone = at + len(words), gone + len(words) - len(kept)
                    if kept:
                        digest.update(sep + b" ".join(kept))
                        sep = b" "
                n_words.append(at)
                n_removed.append(gone)
                sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_words(data: bytes, mask: np.ndarray) -> bytes:
    """The text without the masked words; untouched stretches keep their spacing."""
    out, begin, end = [], None, 0
    for m, gone in zip(WORD.finditer(data), mask.tolist()):
        if gone:
            if begin is not None:
                out.append(data[begin:end])
            begin = None
        else:
            begin = m.start() if begin is None else begin
            end = m.end()
    if begin is not None:
        out.append(data[begin:end])
    return b" ".join(out)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` (and ``n_chars``, where present, set anew); no row goes."""

    rows, ranges = _with_ranges(docs)

    def run(batches):
        for batch in slices(batches, "text", 4 << 20):
            text, col = batch.column("text").to_pylist(), batch.schema.get_field_index("text")
            for i, cell in enumerate(batch.column(ranges).to_pylist()):
                if cell:
                    data = text[i].encode()
                    text[i] = cut_words(data, removed_mask(sum(map(len, word_chunks(data))), cell)).decode()
            batch = batch.set_column(col, batch.schema.field(col), pa.array(text, batch.schema.field(col).type))
            yield batch.drop_columns([ranges])

    out = rows.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
