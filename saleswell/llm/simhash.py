"""SimHash near-duplicates by deletion-variant signatures.

A text is lower-cased (A-Z), cut into words and three-word shingles (repeats
count; fewer words: the whole sequence is the one shingle; none: fingerprint
zero).  A fingerprint bit is set when it is set in over half of the shingles'
XXH64 values (seed 42).

Two fingerprints within two bits differ by at most one bit in one of their two
halves.  Each distinct fingerprint therefore indexes, for both halves, the 32
variants of the half with one bit left out: equal variants meet in a shuffle and
are verified on all 64 bits.  Copies share a fingerprint and enter once.

Nulls and empty texts have fingerprint zero and link like any other.  A row with
a null doc_id keeps its fingerprint, is linked through nothing and has a null
component unless another row shares its fingerprint.  Repeated rows are returned
as often as they come.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from saleswell.llm.common import PARCEL, byte_texts, components, free_name, gather, local_labels, mix, parcels, slices, store, word_chunks

SHINGLE, BITS, SEED = 3, 2, 42
#: Variants per shard: bounds what one task holds.
PER_SHARD = 1 << 20
#: Runs of equal variants up to this length are compared pair by pair, longer ones by trying all near values.
SHORT_RUN = 64


def fingerprint(data: bytes) -> int:
    ones, n, tail = np.zeros(64, np.int64), 0, []
    for words in word_chunks(data.lower()):
        words = tail + words
        if len(words) < SHINGLE:
            tail = words
            continue
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = end - size
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(start[: 1 - SHINGLE].tolist(), end[SHINGLE - 1 :].tolist())], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
        tail = words[1 - SHINGLE :]
    if n == 0 and tail:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_key): fp is the fingerprint's 64 bits as a signed number."""

    def run(batches):
        for batch in slices(batches, "text", 8 << 20):
            fp = np.fromiter((fingerprint(t) for t in byte_texts(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64)), batch.column("text_key")], names=["doc_id", "fp", "text_key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, fp long, text_key long")


def _masks() -> np.ndarray:
    """All 64-bit numbers with one or two bits set."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    return np.concatenate([one, one[i] | one[j]])


def _near(fp: np.ndarray) -> np.ndarray:
    """Labels of the groups that sorted distinct fingerprints form by links; linear in their number."""
    a, b = [], []
    for mask in _masks():
        other = fp ^ mask
        at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
        hit = np.flatnonzero((fp[at] == other) & (other > fp))
        a.append(hit)
        b.append(at[hit])
    return local_labels(len(fp), np.concatenate(a), np.concatenate(b))


def _links(fp: np.ndarray, doc: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among entries whose variants are equal."""
    half, bit = tag >> 5, tag & 31
    part = np.where(half == 1, fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))
    key = (part & ~(np.uint64(1) << bit.astype(np.uint64))) | (tag.astype(np.uint64) << np.uint64(32))
    order = np.lexsort((fp, key))
    fp, doc, key = fp[order], doc[order], key[order]
    edge = np.flatnonzero(np.diff(key)) + 1
    first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
    size = last - first
    a, b = [], []
    short = np.repeat(size <= SHORT_RUN, size)
    for d in range(1, min(SHORT_RUN, int(size.max(initial=0)))):
        i = np.flatnonzero((key[:-d] == key[d:]) & short[:-d])
        if len(i) == 0:
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= BITS]
        a.append(doc[i])
        b.append(doc[i + d])
    for i, j in zip(first[size > SHORT_RUN].tolist(), last[size > SHORT_RUN].tolist()):
        label = _near(fp[i:j])
        a.append(doc[i:j])
        b.append(doc[i:j][label])
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pairs[:, 0], pairs[:, 1]


def near_links(distinct: DataFrame, shards: int) -> DataFrame:
    """Edges (a, b) of doc_ids over (fp, doc_id) with distinct fp; same groups as all pairs within two bits."""

    def index(batches):
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            doc = np.asarray(batch.column("doc_id"))
            for at in range(0, len(fp), 1 << 14):
                f, d = fp[at : at + (1 << 14)], doc[at : at + (1 << 14)]
                tag = np.tile(np.arange(64, dtype=np.uint8), len(f))
                f, d = np.repeat(f, 64), np.repeat(d, 64)
                part = np.where(tag >= 32, f >> np.uint64(32), f & np.uint64(0xFFFFFFFF))
                variant = (part & ~(np.uint64(1) << (tag & 31).astype(np.uint64))) | (tag.astype(np.uint64) << np.uint64(32))
                yield from parcels((mix(variant) % np.uint64(shards)).astype(np.int64), [f, d, tag])

    def verify(t: pa.Table) -> pa.Table:
        a, b = _links(*gather(t.column("parcel"), [np.uint64, np.int64, np.uint8]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return distinct.mapInArrow(index, PARCEL).groupBy("shard").applyInArrow(verify, "a long, b long")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, text_key (the text's hash), component_id (smallest doc_id reachable) for every row."""
    own = store(fingerprints(docs), "simhash")
    distinct = store(own.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    known = distinct.where("doc_id is not null")
    shards = max(32, -(-known.count() * 64 // PER_SHARD))
    near = components(near_links(known, shards))
    groups = known.join(near.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(F.col("fp"), F.coalesce("component", "doc_id").alias("component_id"))
    return own.join(groups, "fp", "left").select("doc_id", "fp", "text_key", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Keep of each group the row with the smallest doc_id; rows without doc_id stay.

    Of repeated rows one stays.  Of rows that share a doc_id, one stays for each group that it is the smallest in:
    different texts with different fingerprints are not lost to each other.
    """
    c, key = free_name("__component", docs), free_name("__key", docs)
    least = simhash_groups(docs).where("doc_id = component_id").groupBy("doc_id", "fp").agg(F.min("text_key").alias(key)).select(F.col("doc_id").alias(c), key).distinct()
    rows = docs.where("doc_id is not null").withColumn(key, F.xxhash64("text"))
    kept = rows.join(least, (rows["doc_id"] == least[c]) & (rows[key] == least[key]), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).drop(key).unionByName(docs.where("doc_id is null"))
