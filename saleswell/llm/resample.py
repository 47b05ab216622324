"""Importance resampling towards a target text collection, with bit-sliced weights.

Words are the maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
Features are the runs of one and two words, hashed into buckets (crc32).  A bucket's gain is
floor(1000 ln) of its smoothed frequency in the target over that in the documents.

A document's bucket counts become bit planes: plane k has a bit for each bucket whose
count has bit k set.  The gains become signed planes in the same way, once.  The sum of
gains over the features is then the sum over plane pairs of 2^(j+k) times the
number of bits that both planes have, exact in integers; the weight is its floored mean.

The draw is without replacement by the Gumbel trick: weight plus a noise that only
depends on the seed and doc_id; the highest scores among documents with enough words are drawn.

Null texts count as empty.  A document without words has no features and weight 0.  A row with a
null doc_id takes its noise from the seed alone and comes after equal scores with an id.  Repeated
rows are documents of their own; equal scores and ids rank by weight and features, rows equal in all in any order.
An empty table of documents gives no rows, an empty target gains against zero counts.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from saleswell.llm.common import TERMS, byte_texts, numbered, slices, store, word_chunks

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7


def features(data: bytes, buckets: int):
    """(number of words, buckets of the features that end in them), for bounded parts of a text."""
    last = None
    for words in word_chunks(data.translate(TERMS)):
        if not words:
            continue
        one = list(map(crc32, words))
        after = list(map(crc32, repeat(b" "), one))
        found = one + list(map(crc32, words[1:], after))
        if last is not None:
            found.append(crc32(words[0], last))
        last = after[-1]
        yield len(words), np.array(found, np.int64) % buckets


def bucket_totals(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of a whole collection in each bucket; the driver gets ``buckets`` numbers."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in byte_texts(batch.column("text")):
                for _, found in features(text, buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=object)
    for bucket, n in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain from its counts in the documents and in the target."""
    n, s, t = len(docs), float(docs.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(docs, target)], np.int64)


def planes(numbers: np.ndarray) -> np.ndarray:
    """Row k: bit k of each number, 64 to a word."""
    k = np.arange(max(1, int(numbers.max(initial=0)).bit_length()), dtype=np.int64)
    bits = (numbers[None, :] >> k[:, None] & 1).astype(np.uint8)
    bits = np.pad(bits, ((0, 0), (0, -len(numbers) % 64)))
    return np.packbits(bits, axis=1).view(np.uint64)


class GainPlanes:
    """Signed gains as bit planes: rows for the positive parts, then rows for the negative ones."""

    def __init__(self, gain: np.ndarray):
        plus, minus = planes(np.maximum(gain, 0)), planes(np.maximum(-gain, 0))
        self.planes = np.concatenate([plus, minus])
        self.value = np.array([1 << j for j in range(len(plus))] + [-(1 << j) for j in range(len(minus))], np.int64)

    def total(self, counts: np.ndarray) -> int:
        """Sum of counts times gains."""
        both = np.bitwise_count(planes(counts)[:, None, :] & self.planes[None, :, :]).sum(axis=2, dtype=np.int64)
        return sum(int(x) << k for k, x in enumerate(both @ self.value))


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    sliced, buckets = GainPlanes(gain), len(gain)

    def weigh(text: bytes):
        counts, n_words = np.zeros(buckets, np.int64), 0
        for n, found in features(text, buckets):
            n_words += n
            counts += np.bincount(found, minlength=buckets)
        n = max(0, 2 * n_words - 1)
        return n_words, n, sliced.total(counts) // n if n else 0

    def run(batches):
        for batch in slices(batches, "text", 8 << 20):
            rows = np.array([weigh(t) for t in byte_texts(batch.column("text"))], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, np.ascontiguousarray(rows.T))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Floored Gumbel noise times 1000 from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every document."""
    gain = gains(bucket_totals(docs), bucket_totals(target))
    scored = store(weights(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resample")
    long = scored.where(F.col("n_words") >= least_words)
    quota = percent * long.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("weight"), F.col("n_features")]
    ranked = numbered(long, order, "rank").withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
