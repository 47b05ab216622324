"""Ranked lexical search by dense blocked matrix products.

Terms are the maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
An item's score for a document is the sum, over the item's different terms, of an integer weight
(from the number of documents with the term) times an integer impact below 10^6 (from the
term's occurrences and the document's length).

Items come in blocks of bounded vocabulary; each block is one counting and one scoring
pass over all documents.  In a task, a tile of items has a compact vocabulary of only its own
terms; the impacts of a tile of documents are laid out densely over it and multiplied with the
tile's weights in float64.  A product's columns are cut so that no sum reaches 2^53: it is
exact in whatever order the library adds, and the parts are added as 64-bit integers.
Each task keeps an item's k best by (score, smaller doc_id), so ties are never lost.

A document without terms has no score but is read; null texts are empty.  Rows with a null doc_id
count in all statistics but cannot be named, so they are not ranked.  Repeated documents are ranked each.
Rows that share an item_id are one item with all their terms, rows with a null item_id take no part.
Empty tables give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from saleswell.llm.common import TERMS, byte_texts, slices, word_chunks

K = 10
SCALE, LENGTH_SHARE = 1000, 90
#: Terms of a block of items: bounds what each task is sent.
BLOCK_TERMS = 1 << 16
ITEM_TILE, DOC_TILE, COLUMNS = 64, 512, 4096
EXACT = (1 << 53) - 1
RESULT = "item_id long, doc_id long, score long"


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the different terms of each item, sorted."""

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), byte_texts(batch.column("text"))):
                for words in word_chunks(text.translate(TERMS)):
                    terms = sorted(set(words))
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(terms), pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").mapInArrow(run, "item_id long, term binary")
    return rows.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def blocks(items: DataFrame, most: int):
    """Lists of (item_id, terms) with at most ``most`` terms together, one item at least."""
    block, n = [], 0
    for item, terms in item_terms(items).orderBy("item_id").toLocalIterator():
        if block and n + len(terms) > most:
            yield block
            block, n = [], 0
        block.append((item, [bytes(t) for t in terms]))
        n += len(terms)
    if block:
        yield block


def occurrences(data: bytes, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of terms, numbers of the vocabulary's terms in the text, their occurrences)."""
    n, found = 0, []
    for words in word_chunks(data.translate(TERMS)):
        n += len(words)
        found += [i for i in map(vocabulary.get, words) if i is not None]
    return n, *np.unique(np.array(found, np.int64), return_counts=True)


def statistics(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, list[int]]:
    """N, L and the vocabulary's document counts, over all documents."""
    size = len(vocabulary)

    def run(batches):
        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            for text in byte_texts(batch.column("text")):
                n, at, _ = occurrences(text, vocabulary)
                total[at] += 1
                total[size] += n > 0
                total[size + 1] += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2)), pa.array(total)], names=["at", "n"])

    out = [0] * (size + 2)
    for at, n in docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return out[size], out[size + 1], out[:size]


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class ItemTile:
    """Some items' weights over their own terms, cut into column ranges whose sums stay exact."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray):
        self.terms = np.unique(np.concatenate(terms)) if terms else np.empty(0, np.int64)
        self.matrix = np.zeros((len(terms), len(self.terms)))
        for i, t in enumerate(terms):
            self.matrix[i, np.searchsorted(self.terms, t)] = weights[t]
        self.cuts, room = [0], 0
        for j, w in enumerate(weights[self.terms].tolist()):
            if room + w * 10**6 > EXACT or j - self.cuts[-1] == COLUMNS:
                self.cuts.append(j)
                room = 0
            room += w * 10**6
        self.cuts.append(len(self.terms))

    def scores(self, n_docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """(item, document): exact sums for documents given by their entries."""
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        own = np.flatnonzero(self.terms[at] == term)
        doc, at, impact = doc[own], at[own], impact[own]
        total = np.zeros((len(self.matrix), n_docs), np.int64)
        for a, b in zip(self.cuts, self.cuts[1:]):
            here = (at >= a) & (at < b)
            dense = np.zeros((b - a, n_docs))
            dense[at[here] - a, doc[here]] = impact[here]
            total += (self.matrix[:, a:b] @ dense).astype(np.int64)
        return total


class Best:
    """The k best (score, smaller doc_id) of each item so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.score = [np.empty(0, np.int64) for _ in range(n_items)]
        self.doc = [np.empty(0, np.int64) for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)

    def add(self, first: int, scores: np.ndarray, docs: np.ndarray) -> None:
        reach = scores >= self.least[first : first + len(scores), None]
        for i in np.flatnonzero(reach.any(axis=1)).tolist():
            item = first + i
            score = np.concatenate([self.score[item], scores[i, reach[i]]])
            doc = np.concatenate([self.doc[item], docs[reach[i]]])
            order = np.lexsort((doc, -score))[: self.k]
            self.score[item], self.doc[item] = score[order], doc[order]
            if len(order) == self.k:
                self.least[item] = score[order[-1]]


def block_scores(docs: DataFrame, block: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """Each task's k best documents for the items of a block."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    n_docs, n_terms, df = statistics(docs, vocabulary)
    weights = np.array([weight(n_docs, x) for x in df], np.int64)
    ids = np.array([item for item, _ in block], np.int64)
    own = [np.array([vocabulary[t] for t in terms], np.int64) for _, terms in block]

    def run(batches):
        tiles = [(a, ItemTile(own[a : a + ITEM_TILE], weights)) for a in range(0, len(own), ITEM_TILE)]
        best = Best(len(ids), k)
        for batch in slices(batches, "text", 8 << 20):
            names, texts = np.asarray(batch.column("doc_id")), byte_texts(batch.column("text"))
            for a in range(0, len(texts), DOC_TILE):
                doc, term, impact = [], [], []
                for i, text in enumerate(texts[a : a + DOC_TILE]):
                    n, at, tf = occurrences(text, vocabulary)
                    if len(at):
                        m = 100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // n_terms
                        doc.append(np.full(len(at), i))
                        term.append(at)
                        impact.append(10**9 * tf // (SCALE * tf + 8 * m))
                if doc:
                    entries = np.concatenate(doc), np.concatenate(term), np.concatenate(impact)
                    for first, tile in tiles:
                        best.add(first, tile.scores(len(texts[a : a + DOC_TILE]), *entries), names[a : a + DOC_TILE])
        n = [len(s) for s in best.score]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate(best.doc)), pa.array(np.concatenate(best.score))], names=["item_id", "doc_id", "score"])

    return docs.where("doc_id is not null").mapInArrow(run, RESULT)


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k highest scores above 0, ties to smaller doc_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = docs.sparkSession.createDataFrame([], RESULT)
    for block in blocks(items, block_terms):
        found = found.unionByName(block_scores(texts, block, k))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
