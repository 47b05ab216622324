"""Exact top-k inner products by ball trees.

Vectors are dealt to shards by a hash of where they stand, so that repeated ids spread; each shard builds a ball tree.  A ball with
centre c and radius r holds no vector whose product with q exceeds q.c + r|q|, so
a query visits balls in the order of that bound and stops at the first below its k-th score.

The k-th score is shared: every query first searches one shard only, and takes the
k-th score found there into all the others, which return only what reaches it.  Queries
travel in blocks of bounded size, so a task holds one shard and one block, however
many vectors and queries there are.

Components become floor(256 x).  A vector that is null or empty or holds null or non-finite components
(or components whose 256-fold overflows) takes no part; neither does a null vec_id.  Rows that share a vec_id are candidates each, and as queries
give their best results together; they are not each other's candidates.
Vectors of unequal length are not compared.  Products outside the range of long are set to its ends.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from saleswell.llm.common import gather, mix, pack, parcel_batch, store

K, EVERY = 5, 50
LEAF, SHARD, BLOCK = 64, 4096, 8192
LEAST = np.iinfo(np.int64).min


class BallTree:
    """Balls over the rows of an integer matrix held as float64; nodes[i] = (first row, last row, left, right)."""

    def __init__(self, rows: np.ndarray):
        self.order = np.arange(len(rows))
        self.nodes: list[list[int]] = []
        centre, radius = [], []
        todo = [(0, len(rows), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            part = rows[self.order[a:b]]
            c = part.mean(axis=0)
            far = np.sqrt(((part - c) ** 2).sum(axis=1))
            here = len(self.nodes)
            self.nodes.append([a, b, -1, -1])
            centre.append(c)
            radius.append(far.max())
            if parent >= 0:
                self.nodes[parent][2 + side] = here
            if b - a > LEAF and radius[-1] > 0:
                one = part[far.argmax()]
                two = part[((part - one) ** 2).sum(axis=1).argmax()]
                by = part @ (two - one)
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(by, mid)]
                todo += [(a, a + mid, here, 0), (a + mid, b, here, 1)]
        self.centre, self.radius = np.array(centre), np.array(radius)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(query, node): no product in the ball exceeds it; rounding is allowed for."""
        norm = np.sqrt((queries**2).sum(axis=1))[:, None]
        reach = np.sqrt((self.centre**2).sum(axis=1)) + self.radius
        upper = queries @ self.centre.T + norm * self.radius[None, :] + 1 + 1e-9 * norm * reach[None, :]
        return np.maximum(upper, LEAST)  # no score is below it either


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows and q (integers held as float64)."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(len(q), 1)
    if most < 2**53:
        return (rows @ q).astype(np.int64)
    own = np.array([int(x) for x in q.tolist()], dtype=object)
    exact = [sum(int(x) * y for x, y in zip(row, own)) for row in rows.tolist()]
    return np.array([min(max(x, LEAST), -LEAST - 1) for x in exact], np.int64)


def search(tree: BallTree, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, bound: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
    """Up to k best (score, id), scores >= least, ties to smaller ids, without the query's own id."""
    best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst first
    queue = [(-bound[0], 0)]
    while queue:
        upper, node = heapq.heappop(queue)
        if -upper < (best[0][0] if len(best) == k else least):
            break
        a, b, left, right = tree.nodes[node]
        if left >= 0:
            heapq.heappush(queue, (-bound[left], left))
            heapq.heappush(queue, (-bound[right], right))
            continue
        at = tree.order[a:b]
        score = products(rows[at], q)
        for j in np.flatnonzero(score >= (best[0][0] if len(best) == k else least)).tolist():
            item = (int(score[j]), -int(ids[at[j]]))
            if -item[1] == own:
                continue
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
    return [(s, -i) for s, i in best]


def _matrix(flat: np.ndarray, n: int) -> np.ndarray:
    return flat.reshape(n, -1) if n else flat.reshape(0, 1)


def top_products(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best among all other rows; queries are the ids divisible by ``every``."""
    fine = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
    valid = store(
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null").where(fine)
        .select("vec_id", F.monotonically_increasing_id().alias("place"), F.transform("embedding", lambda x: x * 256).alias("scaled"))
        .where("forall(scaled, x -> abs(x) < double('inf'))"),
        "topk",
    )
    n = valid.count()
    shards = max(32, -(-n // SHARD))
    asked = valid.where(f"vec_id % {every} = 0")
    blocks = max(1, -(-asked.count() // BLOCK))
    groups = shards * blocks

    # A group is (dimension, shard, block of queries); its parcels hold candidates (kind 0) or queries (kind 1).
    def group(dim, shard, block):
        return (dim * shards + shard) * blocks + block

    def home_of(place):
        return (mix(place.view(np.uint64)) % np.uint64(shards)).astype(np.int64)

    def cells(batches, kind, first):
        for batch in batches:
            ids, place = np.asarray(batch.column("vec_id")), np.asarray(batch.column("place"))
            column = batch.column("scaled")
            size = np.asarray(pc.list_value_length(column))
            flat = np.floor(np.asarray(column.flatten()))
            least = np.asarray(batch.column("least")) if kind else None
            start = np.cumsum(size) - size
            shard = home_of(place)
            block = (mix(place.view(np.uint64) + np.uint64(1)) % np.uint64(blocks)).astype(np.int64)
            lead = shard if kind == 0 else block
            for dim in np.unique(size).tolist():
                for s in np.unique(lead[size == dim]).tolist():
                    at = np.flatnonzero((size == dim) & (lead == s))
                    wide = flat[(start[at][:, None] + np.arange(dim)).reshape(-1)]
                    if kind == 0:
                        yield from out([group(dim, s, b) for b in range(blocks)], pack([np.array([0]), ids[at], np.zeros(0, np.int64), place[at], wide]))
                    elif first:
                        for h in np.unique(shard[at]).tolist():
                            i = at[shard[at] == h]
                            wide = flat[(start[i][:, None] + np.arange(dim)).reshape(-1)]
                            yield from out([group(dim, h, s)], pack([np.array([1]), ids[i], least[i], place[i], wide]))
                    else:
                        yield from out([group(dim, h, s) for h in range(shards)], pack([np.array([1]), ids[at], least[at], place[at], wide]))

    def out(keys, cell):
        for i in range(0, len(keys), 256):
            yield parcel_batch(np.array(keys[i : i + 256]), [cell] * len(keys[i : i + 256]))

    def run(first):
        def find(t: pa.Table) -> pa.Table:
            key = t.column("shard")[0].as_py()
            shard = key // blocks % shards
            held = {0: [], 1: []}
            for cell in t.column("parcel"):
                one = pa.chunked_array([pa.array([cell.as_py()], pa.binary())])
                kind, ids, least, place, wide = gather(one, [np.int64, np.int64, np.int64, np.int64, np.float64])
                held[int(kind[0])].append((ids, least, home_of(place), _matrix(wide, len(ids))))
            found: list[tuple[int, int, int]] = []
            if held[0] and held[1]:
                ids, rows = np.concatenate([h[0] for h in held[0]]), np.concatenate([h[3] for h in held[0]])
                tree = BallTree(rows)
                for own, least, home, queries in held[1]:
                    for at in range(0, len(own), 256):
                        bound = tree.bounds(queries[at : at + 256])
                        for i in range(len(bound)):
                            j = at + i
                            if first or home[j] != shard:
                                found += [(int(own[j]), v, s) for s, v in search(tree, rows, ids, queries[j], int(own[j]), bound[i], k, int(least[j]))]
            q, v, s = zip(*found) if found else ((), (), ())
            return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})

        return find

    plain = valid.mapInArrow(lambda b: cells(b, 0, True), "shard long, parcel binary")
    none = asked.withColumn("least", F.lit(LEAST))
    schema = "query_id long, vec_id long, score long"
    home = store(plain.unionByName(none.mapInArrow(lambda b: cells(b, 1, True), "shard long, parcel binary")).groupBy("shard").applyInArrow(run(True), schema), "topk-home")
    kth = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(LEAST)).alias("least"))
    shared = asked.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(LEAST)))
    rest = plain.unionByName(shared.mapInArrow(lambda b: cells(b, 1, False), "shard long, parcel binary")).groupBy("shard").applyInArrow(run(False), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return home.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
