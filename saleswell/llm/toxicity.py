"""Toxicity by a counterfactually regularised linear classifier.

Features are the distinct words of a text and their first 5, 6 and 7 bytes.  A
bounded sample of labelled rows fits the model (one row an id, the least text of those that share it); the features are the
``size`` most associated with the label among those in LEAST_TEXTS sampled texts or more, chosen from counts over that sample, plus
every identity term.  The ridge is that of RIDGES with the least log loss in cross-validation by id inside the sample,
a Spark task for every ridge and fold; held-out labels are never read.  For each sampled text with identity terms a counterfactual twin
swaps each term for another of its group, and the loss adds the squared change of
the score between a text and its twin: a neutral mention of a group
then moves the score little, whatever company the term kept in the labels.

Scoring reads text only.  Nulls and empty texts have no features and score the
bias.  Labels that are null or not 0/1 are ignored; of several labels for a
doc_id the largest counts.  Without any labelled row every score is 0.  Rows with a null
doc_id are scored and not held out.  Extra columns are ignored (or kept by the filter).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from saleswell.llm.common import byte_texts, mix, slices, store, word_chunks

#: Bound of the labelled sample (rows with the smallest hashes of their ids).
SAMPLE = 20_000
FEATURES, LEAST_TEXTS = 4096, 4
RIDGES, FOLDS = (2e-3, 6e-4, 2e-4, 6e-5), 3
THRESHOLD = 0.3
HELD_OUT = (4, 2)
PREFIXES = (5, 6, 7)
EDGES = b".,;:!?\"'()[]{}*#$%&|"
#: Terms that name groups of people; each is swapped for the next of its row.
IDENTITY = tuple(
    tuple(row.encode().split())
    for row in (
        "women men", "woman man", "girls boys", "girl boy", "muslim christian jewish hindu buddhist atheist",
        "muslims christians jews hindus buddhists atheists", "black white asian latino", "gay straight lesbian bisexual transgender",
        "immigrants refugees foreigners citizens", "old young", "disabled deaf blind", "africans europeans americans mexicans chinese",
        "femmes hommes", "musulmans chrétiens juifs", "noirs blancs", "frauen männer", "muslime christen juden", "ausländer einheimische",
        "mujeres hombres", "musulmanes cristianos judíos", "negros blancos",
    )
)
SWAP = {term: row[(i + 1) % len(row)] for row in IDENTITY for i, term in enumerate(row)}


def features(data: bytes) -> tuple[set[bytes], set[bytes]]:
    """A text's features, and those of its twin with identity terms swapped."""
    words: set[bytes] = set()
    for chunk in word_chunks(data.lower()):
        words.update(chunk)
    words = {w.strip(EDGES) for w in words}
    words.discard(b"")
    own = _with_prefixes(words)
    named = words & SWAP.keys()
    return own, (_with_prefixes((words - named) | {SWAP[w] for w in named}) if named else own)


def _with_prefixes(words: set[bytes]) -> set[bytes]:
    out = set(words)
    for n in PREFIXES:
        out.update([b"\x01" + w[:n] for w in words if len(w) >= n])
    return out


@dataclass(frozen=True)
class Model:
    index: dict[bytes, int]
    weights: np.ndarray
    bias: float
    ridge: float = 0.0

    def score(self, data: bytes) -> float:
        hit = [self.index[f] for f in features(data)[0] & self.index.keys()]
        z = float(self.weights[np.sort(np.array(hit, np.int64))].sum()) + self.bias
        return 1 / (1 + float(np.exp(-np.clip(z, -500, 500))))


def fit(
    rows: list[np.ndarray], twins: list[np.ndarray], labels: np.ndarray, size: int, swap_weight: float, ridge: float, steps: int = 300
) -> tuple[np.ndarray, float]:
    """Weights and bias of the mean logistic loss + ridge / 2 * squared weights + swap_weight * mean squared score change over the twins; Adam at rate 0.1."""

    def sparse(parts):
        n = np.array([len(p) for p in parts], np.int64)
        return np.concatenate([*parts, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(parts)), n)

    (c, r), changed = sparse(rows), [i for i, (a, b) in enumerate(zip(rows, twins)) if a is not b and not np.array_equal(a, b)]
    (ca, ra), (cb, rb) = sparse([rows[i] for i in changed]), sparse([twins[i] for i in changed])
    n, m = len(rows), max(len(changed), 1)
    w, bias = np.zeros(size), float(np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5)))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = np.bincount(r, w[c], n) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        grad = np.bincount(c, err[r], size) + ridge * w
        if changed:
            gap = 2 * swap_weight * (np.bincount(ra, w[ca], len(changed)) - np.bincount(rb, w[cb], len(changed))) / m
            grad += np.bincount(ca, gap[ra], size) - np.bincount(cb, gap[rb], size)
        g = np.append(grad, err.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def log_loss(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, bias: float) -> float:
    """Summed logistic loss."""
    z = np.array([weights[r].sum() for r in rows]) + bias
    return float(np.logaddexp(0, np.where(labels == 1, -z, z)).sum())


def choose_ridge(spark: SparkSession, ids: np.ndarray, rows: list[np.ndarray], twins: list[np.ndarray], labels: np.ndarray, size: int, swap_weight: float) -> float:
    """The ridge with the least loss over the folds of the sample, ties to the larger; each (ridge, fold) is fitted by a task of its own."""
    fold = (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    share = spark.sparkContext.broadcast((fold, rows, twins, labels))

    def run(batches):
        fold, rows, twins, labels = share.value
        for batch in batches:
            for case in batch.column("id").to_pylist():
                r, out = case // FOLDS, case % FOLDS
                left, right = np.flatnonzero(fold != out), np.flatnonzero(fold == out)
                loss = 0.0
                if len(left) and len(right):
                    model = fit([rows[i] for i in left], [twins[i] for i in left], labels[left], size, swap_weight, RIDGES[r])
                    loss = log_loss([rows[i] for i in right], labels[right], *model)
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([out], pa.int32()), pa.array([loss])], names=["r", "fold", "loss"])

    cases = len(RIDGES) * FOLDS
    losses = spark.range(0, cases, 1, cases).mapInArrow(run, "r int, fold int, loss double").collect()
    total = [sum(x["loss"] for x in sorted(losses, key=lambda x: x["fold"]) if x["r"] == r) for r in range(len(RIDGES))]
    return RIDGES[int(np.argmin(total))]


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, swap_weight: float = 1.0, ridge: float | None = None, size: int = FEATURES
) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold; ``ridge=None`` chooses it inside that sample."""
    mod, out = HELD_OUT
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__toxic"))
        .where(f"__id is not null and __toxic in (0, 1) and crc32(cast(__id as string)) % {mod} <> {out}")
        .groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
        .orderBy(F.xxhash64("__id"), "__id").limit(sample)
    )
    # The sample's ids are bounded by `sample`, so they go to every task and the texts stay in place.
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(F.broadcast(chosen), "__id").groupBy("__id", "__toxic").agg(F.min("text").alias("text"))

    def extract(batches):
        for batch in slices(batches, "text", 4 << 20):
            found = [features(t) for t in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__toxic"), pa.array([sorted(a) for a, _ in found], pa.list_(pa.binary())), pa.array([sorted(b) if b is not a else None for a, b in found], pa.list_(pa.binary()))],
                names=["id", "toxic", "own", "twin"],
            )

    seen = store(rows.mapInArrow(extract, "id long, toxic int, own array<binary>, twin array<binary>"), "toxicity-sample")
    n = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n:
        return Model({}, np.zeros(0), -700.0)
    pos, neg = n.get(1, 0), n.get(0, 0)
    counts = seen.select(F.explode("own").alias("feature"), "toxic").groupBy("feature").agg(F.sum("toxic").alias("p"), F.count("*").alias("n"))
    rate = lambda part, whole: (part + 0.5) / (whole + 1.0)
    strength = F.col("n") * F.pow(F.log(rate(F.col("p"), pos)) - F.log(rate(F.col("n") - F.col("p"), neg)), 2)
    top = counts.where(f"n >= {LEAST_TEXTS}").orderBy(strength.desc(), "feature").limit(size).select("feature").collect()
    index = {bytes(r["feature"]): i for i, r in enumerate(top)}
    for term in sorted(SWAP):
        index.setdefault(term, len(index))
    share = docs.sparkSession.sparkContext.broadcast(index)

    def encode(batches):
        known = share.value
        for batch in batches:
            ids = lambda fs: np.array(sorted(known[f] for f in fs if f in known), np.int32).tobytes()
            own, twin = batch.column("own").to_pylist(), batch.column("twin").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("toxic"), pa.array([ids(x) for x in own], pa.binary()), pa.array([None if x is None else ids(x) for x in twin], pa.binary())],
                names=["id", "toxic", "own", "twin"],
            )

    sampled = sorted(seen.mapInArrow(encode, "id long, toxic int, own binary, twin binary").collect(), key=lambda r: r["id"])
    own = [np.frombuffer(r["own"], np.int32) for r in sampled]
    twin = [a if r["twin"] is None else np.frombuffer(r["twin"], np.int32) for a, r in zip(own, sampled)]
    y = np.array([r["toxic"] for r in sampled], float)
    if ridge is None:
        ridge = choose_ridge(docs.sparkSession, np.array([r["id"] for r in sampled], np.int64), own, twin, y, len(index), swap_weight)
    weights, bias = fit(own, twin, y, len(index), swap_weight, ridge)
    return Model(index, weights, bias, ridge)


def score(docs: DataFrame, model: Model, keep: float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; with ``keep``, instead the rows of ``docs`` that score below it."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    mod, out = HELD_OUT

    def scored(batch):
        return np.fromiter((share.value.score(t) for t in byte_texts(batch.column("text"))), float, batch.num_rows)

    def run(batches):
        for batch in slices(batches, "text", 4 << 20):
            s = scored(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    def clean(batches):
        for batch in slices(batches, "text", 4 << 20):
            yield batch.filter(pa.array(scored(batch) < keep))

    if keep is not None:
        return docs.mapInArrow(clean, docs.schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == out, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", "predicted")
