"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, modulo two primes below 2^31, the sum of code point times base^position
over every prefix.  A span's hash is a difference of two entries, shifted to position 0, so any
two spans of any texts are compared at once, and the longest common extension of two places
is found by binary search over its length.

A fingerprint samples that array: the text's length and whole hash, and for up to 16 anchors
their position, the hash of the window that starts there, and the prefix entry.  Anchors
are the places whose window hashes are least, so edited copies choose mostly the same ones.
Anchors that two fingerprints share lie on diagonals (position in one less position in the other);
along a diagonal the prefix entries tell by binary search how far the texts stay equal.  Likeness is the share
of both texts that lies in spans found equal: 1 for equal texts, also for two empty ones.

Null texts are empty.  The next document is the one that follows by doc_id, a null id comes last,
rows that share an id follow by a hash of their text, equal rows in any order; the last is followed by
the first, a single document by itself.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from saleswell.llm.common import mix, slices, store

#: Two primes and a base for each; texts are hashed in blocks, so tables of powers stay this long.
PRIMES, BASES, BLOCK = (2147483647, 2147483629), (1103515249, 1664525113), 1 << 16
WIDTH, ANCHORS = 8, 16


@functools.cache
def powers(modulus: int, inverse: bool) -> np.ndarray:
    """base^k (or its inverse) for k up to a block."""
    p = PRIMES[modulus]
    base = pow(BASES[modulus], -1 if inverse else 1, p)
    out = np.ones(1, np.uint64)
    while len(out) < BLOCK:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), p)) % np.uint64(p)])
    return out


class Prefixes:
    """The prefix arrays of one text."""

    def __init__(self, text: str, kept: Prefixes | None = None, keep: int = 0):
        """Of ``text``, or of the first ``keep`` characters of ``kept`` followed by ``text``."""
        self.n = keep + len(text)
        self.sums = np.zeros((2, self.n + 1), np.uint32)
        if kept is not None:
            self.sums[:, : keep + 1] = kept.sums[:, : keep + 1]
        for a in range(0, len(text), BLOCK):
            code = np.frombuffer(text[a : a + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
            for m, p in enumerate(PRIMES):
                part = np.cumsum(code * powers(m, False)[: len(code)] % np.uint64(p)) % np.uint64(p)
                at = keep + a
                part = (part * np.uint64(pow(BASES[m], at, p)) + self.sums[m, at]) % np.uint64(p)
                self.sums[m, at + 1 : at + 1 + len(code)] = part

    def span(self, at: int, length: int) -> tuple[int, int]:
        """The hash of a span, wherever it lies."""
        return span_hash(at, self.sums[:, at].tolist(), self.sums[:, at + length].tolist())

    def equal(self, at: int, other: Prefixes, there: int, length: int) -> bool:
        return self.span(at, length) == other.span(there, length)

    def extension(self, at: int, other: Prefixes, there: int) -> int:
        """Characters that agree from two places on."""
        low, high = 0, min(self.n - at, other.n - there)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(at, other, there, mid) else (low, mid - 1)
        return low

    def windows(self, width: int) -> np.ndarray:
        """Mixed 64-bit hashes of all windows of a width."""
        n = self.n - width + 1
        out = np.empty(max(n, 0), np.uint64)
        for a in range(0, n, BLOCK):
            b = min(a + BLOCK, n)
            both = []
            for m, p in enumerate(PRIMES):
                apart = (self.sums[m, a + width : b + width].astype(np.uint64) + np.uint64(p) - self.sums[m, a:b]) % np.uint64(p)
                apart = apart * powers(m, True)[: b - a] % np.uint64(p)
                both.append(apart * np.uint64(pow(BASES[m], -a, p)) % np.uint64(p) if a else apart)
            out[a:b] = mix(both[0] | both[1] << np.uint64(32))
        return out


def span_hash(at: int, start: list[int], end: list[int]) -> tuple[int, int]:
    return tuple((e - s) * pow(b, -at, p) % p for s, e, b, p in zip(start, end, BASES, PRIMES))


def fingerprint(prefixes: Prefixes) -> bytes:
    """Numbers of four bytes: length and whole hash, then position, window hash and prefix entries of each anchor in order."""
    keys = prefixes.windows(WIDTH)
    first = np.arange(len(keys))
    if len(keys) > ANCHORS:
        # Repeats of a window may crowd the least keys: take in more until enough different ones are there.
        take = 4 * ANCHORS
        while True:
            first = np.argpartition(keys, take)[:take] if take < len(keys) else np.arange(len(keys))
            first = np.flatnonzero(keys <= keys[first].max())
            if take >= len(keys) or len(np.unique(keys[first])) >= ANCHORS:
                break
            take *= 4
    _, at = np.unique(keys[first], return_index=True)
    at = np.sort(first[at[:ANCHORS]])
    head = np.array([prefixes.n, *prefixes.sums[:, -1]], np.uint32)
    rows = np.stack([at.astype(np.uint32), (keys[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32), *prefixes.sums[:, at]], axis=1)
    return np.concatenate([head, rows.reshape(-1)]).astype(">u4").tobytes()


def likeness(one: bytes, two: bytes) -> float:
    """The share of two texts that their fingerprints find in equal spans, 0 to 1."""
    if one == two:
        return 1.0
    (n, *_), a = _read(one)
    (m, *_), b = _read(two)
    diagonals: dict[int, list[tuple[list[int], list[int]]]] = {}
    there = {x[1]: x for x in b[1:-1]}
    shared = [(x, there[x[1]]) for x in a[1:-1] if x[1] in there]
    for x, y in [(a[0], b[0]), *shared, (a[-1], b[-1])]:
        diagonals.setdefault(x[0] - y[0], []).append((x, y))
    found = [(x[0], y[0], WIDTH) for x, y in shared]
    for places in diagonals.values():
        i = 0
        while i < len(places) - 1:
            low, high = i, len(places) - 1  # the last place up to which the texts agree from place i
            while low < high:
                mid = (low + high + 1) // 2
                (x, y), (u, v) = places[i], places[mid]
                same = span_hash(x[0], x[2:], u[2:]) == span_hash(y[0], y[2:], v[2:])
                low, high = (mid, high) if same else (low, mid - 1)
            if low > i:
                found.append((places[i][0][0], places[i][1][0], places[low][0][0] - places[i][0][0]))
            i = max(low, i + 1)
    covered = _covered([(x, k) for x, _, k in found]) + _covered([(y, k) for _, y, k in found])
    return min(1.0, covered / (n + m))


def _read(print_: bytes) -> tuple[list[int], list[list[int]]]:
    """Head, and the anchors between the text's two ends, which are anchors too."""
    numbers = np.frombuffer(print_, ">u4").tolist()
    head, rest = numbers[:3], numbers[3:]
    return head, [[0, -1, 0, 0], *(rest[i : i + 4] for i in range(0, len(rest), 4)), [head[0], -2, *head[1:]]]


def _covered(spans: list[tuple[int, int]]) -> int:
    total = end = 0
    for at, length in sorted(spans):
        total += max(0, at + length - max(at, end))
        end = max(end, at + length)
    return total


class _Document:
    """A text, its prefix arrays and its fingerprint."""

    def __init__(self, doc_id, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.prefixes = Prefixes(self.text)
        self.print = fingerprint(self.prefixes)

    def beside(self, text: str, print_: bytes) -> tuple:
        """The row of this document whose next one has that text and fingerprint."""
        moved = len(self.text) // 4
        keep = len(self.text) - moved
        edited = self.text[:keep] + text[:moved]
        after = fingerprint(Prefixes(text[:moved], self.prefixes, keep))
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return self.doc_id, len(self.text), digest, self.print, after, likeness(self.print, after), likeness(self.print, print_)


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
#: kind 0: a finished row; 1: the first document of a range; 2: the last, whose next one lies in another range.
KINDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("kind", pa.int32()), ("part", pa.int64()), ("text", pa.string())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tagged = texts.withColumn("hash", F.xxhash64("text")).withColumn("stood", F.monotonically_increasing_id())
    order = [F.asc_nulls_last("doc_id"), F.col("hash"), F.col("stood")]
    ranged = tagged.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))

    def run(batches):
        last, part = None, 0
        for batch in slices(batches, "text", 8 << 20):
            out = []
            for doc_id, text, part in zip(*(c.to_pylist() for c in batch.columns)):
                here = _Document(doc_id, text)
                if last is None:
                    out.append((doc_id, None, None, here.print, None, None, None, 1, part, here.text))
                else:
                    out.append((*last.beside(here.text, here.print), 0, part, None))
                last = here
            yield _rows(out, KINDS)
        if last is not None:
            yield _rows([(last.doc_id, None, None, last.print, None, None, None, 2, part, last.text)], KINDS)

    made = store(ranged.mapInArrow(run, f"{ROW}, kind int, part long, text string"), "prints")
    first = made.where("kind = 1").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    # One row a range: its number and that of the range that follows, the first one after the last.
    parts = Window.orderBy("part")
    follows = first.select("part").withColumn("follows", F.lead("part").over(parts)).withColumn("least", F.first("part").over(parts))
    ends = made.where("kind = 2").select("doc_id", "text", "part").join(follows.select("part", F.coalesce("follows", "least").alias("follows")), "part")
    edges = ends.join(first.withColumnRenamed("part", "follows"), "follows").select("doc_id", "text", "next_text", "next_print")

    def finish(batches):
        schema = pa.schema(list(KINDS)[:7])
        for batch in batches:
            yield _rows([_Document(i, t).beside(u, p) for i, t, u, p in zip(*(c.to_pylist() for c in batch.columns))], schema)

    done = made.where("kind = 0").drop("kind", "part", "text").unionByName(edges.mapInArrow(finish, ROW))
    return done.withColumn("fingerprint", F.lower(F.hex("fingerprint"))).withColumn("edited_fingerprint", F.lower(F.hex("edited_fingerprint")))
