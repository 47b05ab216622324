"""N-gram language model in an Elias-Fano trie.

Level 1 holds the training tokens in the order of their hashes; a token's id is its place
there.  Level k holds the n-grams of k tokens ordered by (place of their first k-1
tokens in level k-1, id of the last).  A level's shard is a file of flat arrays in the shared folder,
mapped into memory by whoever reads it:

* pointers: where each context's successors begin (monotone, Elias-Fano);
* successors: last token's id plus context x vocabulary, so that ids which only ascend within a
  context become one monotone Elias-Fano sequence; a query is a
  successor search within the context's range;
* counts, as running totals (monotone, Elias-Fano), and
* smoothed log10 probabilities in 8 bits, by a code book of quantiles for each shard.

Smoothing is p(w | ctx) = (c(ctx, w) + MU p(w | shorter ctx)) / (c(ctx) + MU), down to the
unigram (c + 1) / (N + V + 1), which unknown tokens share with count 0.  It needs a context's count but not its
number of successors, so shards may cut a context: an n-gram's shard follows from
the running count of its context plus its own place in it, which deals the training tokens out evenly
however often one token occurs.

Texts: A-Z lower-cased, words and one end token; null and blank texts have the end token only.  The first token's context is
a begin mark that is not counted.  A null doc_id is trained on.  Repeated rows count as often as they come.  An empty training set
has N = V = 0 and every token has probability 1.  Extra columns are ignored.

The folder must be a mounted path (file: scheme or a mount given as ``folder``).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from saleswell.llm.common import PARCEL, SPACE, byte_texts, mix, parcel_batch, slices
from saleswell.llm.eliasfano import EliasFano, encode
from saleswell.session import work_folder

ORDER, MU = 3, 16.0
HELD_OUT = (7, 2)
#: Bytes of text behind one shard of a level, about.
SHARD_BYTES = 8 << 20
#: Text counted or scored at once: n-grams that repeat in it are one entry and one question.
BATCH_BYTES = 8 << 20
U = np.uint64
END = U(xxhash.xxh3_64_intdigest(b"\x00end of text"))


#: A word of at most LONG bytes is named by a polynomial in BASE (modulo 2^64, 3 modulo 8) over a random number for each byte,
#: read off running sums over PIECE bytes at a time; a longer one by xxh3.
BASE, LONG, PIECE = 0x9E3779B97F4A7C13, 128, 1 << 18
_POWER, _INVERSE = (np.concatenate([np.ones(1, U), np.multiply.accumulate(np.full(PIECE + LONG, b, U))]) for b in (BASE, pow(BASE, -1, 1 << 64)))
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_IN_WORD = np.array([b not in b"\x20\x09\x0a\x0b\x0c\x0d" for b in range(256)]).view(np.int8)


def _named(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of at most PIECE + LONG bytes begin, and their 64-bit names."""
    raw = np.frombuffer(piece, np.uint8)
    edge = np.flatnonzero(np.diff(_IN_WORD[raw], prepend=np.int8(0), append=np.int8(0)))
    begin, end = edge[::2], edge[1::2]
    upto = np.zeros(len(raw) + 1, U)
    np.cumsum(_BYTE[raw] * _POWER[: len(raw)], out=upto[1:])
    name = mix((upto[end] - upto[begin]) * _INVERSE[begin] + (end - begin).astype(U))
    for i in np.flatnonzero(end - begin > LONG).tolist():
        name[i] = xxhash.xxh3_64_intdigest(piece[begin[i] : end[i]].lower())
    return begin, name


def _words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and their names."""
    begins, names, at = [np.empty(0, np.int64)], [np.empty(0, U)], 0
    while at < len(data):
        cut = min(at + PIECE, len(data))
        end = m.start() if (m := SPACE.search(data, cut)) else len(data)
        last = 1 + max(data.rfind(bytes([c]), at, cut) for c in b"\x20\x09\x0a\x0b\x0c\x0d")
        last = max(last, at)
        if end - last > LONG:  # a long word crosses the cut
            begin, name = _named(data[at:last])
            begin, name = np.append(begin, last - at), np.append(name, U(xxhash.xxh3_64_intdigest(data[last:end].lower())))
        else:
            begin, name = _named(data[at:end])
        begins.append(begin + at)
        names.append(name)
        at = end
    return np.concatenate(begins), np.concatenate(names)


def _write(path: str, arrays: list[np.ndarray]) -> None:
    """One file of 64-bit words: the number of arrays, their lengths, the arrays.  Appears whole or not at all."""
    temp = f"{path}.{uuid.uuid4().hex}"
    with open(temp, "wb") as f:
        np.array([len(arrays), *(len(a) for a in arrays)], U).tofile(f)
        for a in arrays:
            np.ascontiguousarray(a).tofile(f)
    os.replace(temp, path)


def _read(path: str) -> list[np.ndarray]:
    data = np.asarray(np.memmap(path, U, "r"))
    n = int(data[0])
    at = 1 + n
    out = []
    for size in data[1 : 1 + n].astype(np.int64).tolist():
        out.append(data[at : at + size])
        at += size
    return out


def _octets(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([codes, np.zeros(-len(codes) % 8, np.uint8)]).view(U)


def _planes(values: np.ndarray) -> np.ndarray:
    """The bytes of numbers, place by place, without the places that are zero in all of them."""
    width = (int(values.max(initial=0)).bit_length() + 7) // 8
    return np.ascontiguousarray(np.ascontiguousarray(values, U).view(np.uint8).reshape(-1, 8)[:, :width].T).reshape(-1)


def _numbers(planes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes) // n] = planes.reshape(-1, n).T
    return out.view(U).reshape(-1)


def narrow(key: np.ndarray, count: np.ndarray, below: np.ndarray | None = None) -> bytes:
    """Ascending keys as byte planes of their steps, counts less one likewise, and 32-bit floats if given, in one cell; keys are whole."""
    steps, counts = _planes(np.diff(key)), _planes(count.astype(U) - U(1))
    lower = b"" if below is None else below.astype(np.float32).tobytes()
    return np.array([len(key), len(steps), len(counts), key[0]], U).tobytes() + steps.tobytes() + counts.tobytes() + lower


def widen(cell) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts and floats (none, if none were given)."""
    data = np.frombuffer(cell, np.uint8)
    n, size, counts, first = (int(x) for x in data[:32].copy().view(U))
    steps = _numbers(data[32 : 32 + size], n - 1) if n > 1 else np.empty(0, U)
    at = 32 + size + counts
    key = np.cumsum(np.concatenate([np.array([first], U), steps]), dtype=U)
    return key, _numbers(data[32 + size : at], n) + U(1), np.frombuffer(data[at:].tobytes(), np.float32)


def _narrow_parcels(shard: np.ndarray, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of PARCEL of ascending keys, their counts and perhaps floats."""
    if len(shard) == 0:
        return
    if np.any(shard[1:] < shard[:-1]):
        order = np.argsort(shard, kind="stable")
        shard, arrays = shard[order], [a[order] for a in arrays]
    cuts = np.flatnonzero(np.diff(shard)) + 1
    first, last = [0, *cuts.tolist()], [*cuts.tolist(), len(shard)]
    yield parcel_batch(shard[first].astype(np.int64), [narrow(*(a[i:j] for a in arrays)) for i, j in zip(first, last)])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and each value's run."""
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.empty(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


class Shard:
    """One file of a level; arrays are used in place."""

    def __init__(self, path: str, level: int):
        arrays = _read(path)
        self.first_context, self.n = (int(x) for x in arrays[0])
        self.totals = EliasFano(arrays[1:5])
        if level == 1:
            self.hashes = arrays[5]
            return
        self.pointers, self.successors = EliasFano(arrays[5:9]), EliasFano(arrays[9:13])
        self.book, self.codes = arrays[13].view(np.float64), arrays[14].view(np.uint8)

    def counts(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running total before, and count of, the elements i."""
        before = np.zeros(len(i), U)
        some = np.flatnonzero(i > 0)
        before[some] = self.totals.get(i[some] - 1)
        return before, self.totals.get(i) - before

    def find(self, context: np.ndarray, word: np.ndarray, vocabulary: int) -> np.ndarray:
        """Place of (context, word) in this shard, -1 where it isn't."""
        out = np.full(len(context), -1)
        own = context - self.first_context
        ok = np.flatnonzero((own >= 0) & (own < self.pointers.n - 1))
        begin, run = _runs(own[ok])
        first, last = (self.pointers.get(own[ok][begin] + k).astype(np.int64)[run] for k in (0, 1))
        value = own[ok].astype(U) * U(vocabulary) + word[ok].astype(U)
        at, same = self.successors.search(value, first, last)
        out[ok[same]] = at[same]
        return out


class Trie:
    """The levels built so far, as read by a task."""

    def __init__(self, folder: str, order: int):
        self.folder, self.order = folder, order
        self.shards: dict[tuple[int, int], Shard] = {}
        self.sizes, self.totals = {}, {}
        for level in range(1, order + 1):
            path = f"{folder}/level{level}/sizes"
            if os.path.exists(path):
                n, total = _read(path)
                self.sizes[level] = np.concatenate([[0], np.cumsum(n.astype(np.int64))])
                self.totals[level] = np.concatenate([np.zeros(1, U), np.cumsum(total, dtype=U)])
        texts, self.n_shards = (int(x) for x in _read(f"{folder}/texts")[0])
        self.texts = texts
        self.vocabulary = int(self.sizes[1][-1]) if 1 in self.sizes else 0
        self.tokens = int(self.totals[1][-1]) if 1 in self.totals else 0

    def shard(self, level: int, k: int) -> Shard | None:
        if (level, k) not in self.shards:
            if len(self.shards) >= 512:
                self.shards.clear()
            path = f"{self.folder}/level{level}/{k}"
            self.shards[level, k] = Shard(path, level) if os.path.exists(path) else None
        return self.shards[level, k]

    def _by_shard(self, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(which, kind="stable") if np.any(which[1:] < which[:-1]) else np.arange(len(which))
        cuts = np.flatnonzero(np.diff(which[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                yield int(which[part[0]]), part

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of tokens, -1 for unknown ones."""
        out = np.full(len(hashes), -1)
        for k, at in self._by_shard(token_shard(hashes, self.n_shards)):
            if (shard := self.shard(1, k)) is None or not shard.n:
                continue
            place = np.minimum(np.searchsorted(shard.hashes, hashes[at]), shard.n - 1)
            hit = shard.hashes[place] == hashes[at]
            out[at[hit]] = place[hit] + self.sizes[1][k]
        return out

    def counts(self, level: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running total before, and count of, the elements of a level; the place after level 1's last is the begin mark."""
        before, count = np.zeros(len(place), U), np.zeros(len(place), U)
        begin = (place >= self.vocabulary) if level == 1 else np.zeros(len(place), bool)
        before[begin], count[begin] = U(self.tokens), U(self.texts)
        some = np.flatnonzero(~begin)
        for k, at in self._by_shard(np.searchsorted(self.sizes[level], place[some], side="right") - 1):
            at = some[at]
            a, c = self.shard(level, k).counts(place[at] - self.sizes[level][k])
            before[at], count[at] = a + self.totals[level][k], c
        return before, count

    def gram_shard(self, context: tuple[np.ndarray, np.ndarray], word: np.ndarray) -> np.ndarray:
        """Shard of an n-gram, given its context's counts(): its place among all training tokens' places, in n_shards even parts."""
        before, count = context
        whole = float(max(self.tokens + self.texts, 1))
        place = before.astype(np.float64) + count.astype(np.float64) * (word / max(self.vocabulary, 1))
        return np.minimum((place * (self.n_shards / whole)).astype(np.int64), self.n_shards - 1)

    def context_counts(self, level: int, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """counts() of contexts, places in level - 1 that mostly come in runs."""
        begin, run = _runs(context)
        before, count = self.counts(level - 1, context[begin])
        return before[run], count[run]

    def find(self, level: int, context: np.ndarray, word: np.ndarray, counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places of n-grams with known contexts and words in their level, and quantised log10 probabilities; -1 where unknown."""
        out, log_p = np.full(len(context), -1), np.zeros(len(context))
        for k, at in self._by_shard(self.gram_shard(counts, word)):
            if (shard := self.shard(level, k)) is not None:
                place = shard.find(context[at], word[at], self.vocabulary)
                hit = place >= 0
                out[at[hit]], log_p[at[hit]] = place[hit] + self.sizes[level][k], shard.book[shard.codes[place[hit]]]
        return out, log_p

    def unigram(self, word: np.ndarray) -> np.ndarray:
        """log10 probabilities of tokens without context; -1 is an unknown one."""
        count, known = np.zeros(len(word), U), np.flatnonzero(word >= 0)
        count[known] = self.counts(1, word[known])[1]
        return np.log10((count.astype(np.float64) + 1) / (self.tokens + self.vocabulary + 1))

    def climb(self, ids: np.ndarray, opens: np.ndarray, log_p: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """For each token the place in level ``top`` of the n-gram that ends with it (-1: unknown) and its log10 probability.

        A level's places are the next one's contexts, and its probabilities what the next
        one falls back to, so each distinct n-gram of the texts is looked up once a level.
        """
        place, log_p = ids, log_p.copy()
        for level in range(2, top + 1):
            context = self.before(place, opens, level)
            some = np.flatnonzero(context >= 0)
            key, back = np.unique(context[some].astype(U) * U(self.vocabulary + 1) + (ids[some] + 1).astype(U), return_inverse=True)
            ctx, word = (key // U(self.vocabulary + 1)).astype(np.int64), (key % U(self.vocabulary + 1)).astype(np.int64) - 1
            counts = self.context_counts(level, ctx)
            # an n-gram is known only if it is known without its first token
            lower = np.ones(len(key), bool)
            lower[back] = place[some] >= 0
            asked = np.flatnonzero(lower)
            found, stored = np.full(len(key), -1), np.zeros(len(key))
            found[asked], stored[asked] = self.find(level, ctx[asked], word[asked], (counts[0][asked], counts[1][asked]))
            less = np.log10(MU / (counts[1].astype(np.float64) + MU))
            log_p[some] = np.where((found >= 0)[back], stored[back], log_p[some] + less[back])
            place = np.full(len(ids), -1)
            place[some] = found[back]
        return place, log_p

    def before(self, place: np.ndarray, opens: np.ndarray, level: int) -> np.ndarray:
        """Contexts in level - 1: the place of the token before; at the opening of a text the begin mark, or -1 above level 2."""
        context = np.empty(len(place), np.int64)
        context[1:] = place[:-1]
        context[opens] = self.vocabulary if level == 2 else -1
        return context


def token_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Even ranges of the hashes."""
    return (((hashes >> U(32)) * U(shards)) >> U(32)).astype(np.int64)


def _path(folder: str) -> str:
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError(f"the model needs a mounted folder, not {folder}: pass one as folder")
    return folder


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token names of the texts end to end, each followed by the end token, and where each text opens."""
    begin, name = _words_of(b"\n".join(texts))
    ends = np.cumsum(np.array([len(t) + 1 for t in texts]))
    stop = np.searchsorted(begin, ends) + np.arange(len(texts))
    out, word = np.empty(len(name) + len(texts), U), np.ones(len(name) + len(texts), bool)
    word[stop] = False
    out[word], out[stop] = name, END
    return out, np.concatenate([[0], stop[:-1] + 1])


def _known(trie: Trie, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of a batch's texts end to end, where each text opens, and the tokens' log10 probabilities without context."""
    names, opens = _laid(byte_texts(batch.column("text")))
    coded = pa.array(names).dictionary_encode()
    back, own = coded.indices.to_numpy(), trie.words(coded.dictionary.to_numpy())
    return own[back], opens, trie.unigram(own)[back]


def build(docs: DataFrame, order: int = ORDER, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> str:
    """Count the rows with ``train`` true, level by level, and write the trie; returns its folder."""
    spark = docs.sparkSession
    folder = f"{_path(folder or work_folder(spark, 'lm'))}/trie-{uuid.uuid4().hex}"
    rows = docs.where("train").select("text")
    texts, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    shards = max(32, -(-(size or 0) // shard_bytes))
    os.makedirs(folder)
    _write(f"{folder}/texts", [np.array([texts, shards], U)])

    def merged(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, count, below = (np.concatenate(x) for x in zip(*(widen(x.as_buffer()) for x in t.column("parcel"))))
        order_ = np.argsort(key, kind="stable")
        key = key[order_]
        at = _runs(key)[0]
        return key[at], np.add.reduceat(count[order_], at), below[order_[at]] if len(below) else below

    def summary(k, n, total):
        return pa.table({"shard": pa.array([k], pa.int64()), "n": pa.array([n], pa.int64()), "total": pa.array([int(total)], pa.int64())})

    def count_tokens(batches):
        for batch in slices(batches, "text", BATCH_BYTES):
            key, count = np.unique(_laid(byte_texts(batch.column("text")))[0], return_counts=True)
            yield from _narrow_parcels(token_shard(key, shards), key, count)

    def write_tokens(t):
        k = t.column("shard")[0].as_py()
        key, count, _ = merged(t)
        total = np.cumsum(count, dtype=U)
        os.makedirs(f"{folder}/level1", exist_ok=True)
        _write(f"{folder}/level1/{k}", [np.array([0, len(key)], U), *encode(total), key])
        return summary(k, len(key), total[-1])

    def count_grams(level):
        def run(batches):
            trie = Trie(folder, level - 1)
            v = U(max(trie.vocabulary, 1))
            for batch in slices(batches, "text", BATCH_BYTES):
                ids, opens, base = _known(trie, batch)
                place, log_p = trie.climb(ids, opens, base, level - 1)
                context = trie.before(place, opens, level)
                some = np.flatnonzero(context >= 0)
                key, first, count = np.unique(context[some].astype(U) * v + ids[some].astype(U), return_index=True, return_counts=True)
                shard = trie.gram_shard(trie.context_counts(level, (key // v).astype(np.int64)), key % v)
                # what is known of an n-gram without its first token goes with it; single tokens are cheap to look up again
                yield from _narrow_parcels(shard, key, count, *([log_p[some[first]]] if level > 2 else []))

        return run

    def write_grams(level):
        def run(t):
            k = t.column("shard")[0].as_py()
            trie = Trie(folder, level - 1)
            key, count, below = merged(t)
            v = U(trie.vocabulary)
            context = (key // v).astype(np.int64)
            if level == 2:
                word, back = np.unique((key % v).astype(np.int64), return_inverse=True)
                below = trie.unigram(word)[back]
            whole = trie.context_counts(level, context)[1].astype(np.float64)
            p = np.log10((count + MU * 10 ** below.astype(np.float64)) / (whole + MU))
            book = np.unique(np.quantile(p, np.linspace(0, 1, 256), method="nearest"))
            code = np.clip(np.searchsorted((book[1:] + book[:-1]) / 2, p), 0, 255).astype(np.uint8)
            lo = int(context[0])
            pointers = np.concatenate([[0], np.cumsum(np.bincount(context - lo))])
            total = np.cumsum(count, dtype=U)
            os.makedirs(f"{folder}/level{level}", exist_ok=True)
            _write(f"{folder}/level{level}/{k}", [np.array([lo, len(key)], U), *encode(total), *encode(pointers), *encode(key - U(lo) * v), book.view(U), _octets(code)])
            return summary(k, len(key), total[-1])

        return run

    entries = vocabulary = 0
    for level in range(1, order + 1):
        if level > 1 and (entries + 1) * (vocabulary + 1) >= 1 << 64:
            raise OverflowError(f"level {level}: {entries} contexts and {vocabulary} tokens need keys of over 64 bits")
        count, write = (count_tokens, write_tokens) if level == 1 else (count_grams(level), write_grams(level))
        found = rows.mapInArrow(count, PARCEL).groupBy("shard").applyInArrow(write, "shard long, n long, total long").collect()  # two numbers for each shard
        n, total = np.zeros(shards, U), np.zeros(shards, U)
        for r in found:
            n[r["shard"]], total[r["shard"]] = r["n"], r["total"]
        entries = int(n.sum())
        vocabulary = entries if level == 1 else vocabulary
        os.makedirs(f"{folder}/level{level}", exist_ok=True)
        _write(f"{folder}/level{level}/sizes", [n, total])
    return folder


def score(docs: DataFrame, folder: str, order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row."""

    def run(batches):
        trie = Trie(folder, order)
        for batch in slices(batches, "text", BATCH_BYTES):
            ids, opens, base = _known(trie, batch)
            log_p = trie.climb(ids, opens, base, order)[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.diff(np.append(opens, len(ids)))), pa.array(np.add.reduceat((ids >= 0).astype(np.int64), opens)),
                    pa.array(np.full(batch.num_rows, trie.tokens)), pa.array(np.add.reduceat(base, opens)), pa.array(np.add.reduceat(log_p, opens)),
                ],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def corpus_scores(docs: DataFrame, order: int = ORDER, folder: str | None = None) -> DataFrame:
    """Train outside the held-out fold, score all: doc_id, held_out and the columns of score()."""
    mod, out = HELD_OUT
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == out, F.lit(False))
    where = build(docs.select("text", (~held).alias("train")), order, folder)
    scored = score(docs, where, order)
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
