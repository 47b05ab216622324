"""Near-duplicate vectors by a forest of random-projection trees.

Rows that agree in label and vector are one class and enter once.  Each tree splits
the classes of a label again and again: a node draws a direction from its own number,
projects its vectors (scaled to length 1), and sends each to the side of the median; those within the spill of
it go to both.  Splitting runs in Spark rounds over all trees and nodes at once, until nodes
hold LEAF classes.  In each leaf all pairs are compared in double precision; what reaches the threshold in any tree is a
link.  A node whose vectors crowd within the spill cannot be split; it is compared as a leaf.  A leaf above LEAF classes is
compared in pairs of blocks, each a task of its own, so that size bounds no
result and no group is held whole.

The spill is SPILL standard deviations of the projected difference of two vectors at the threshold, sqrt(2 (1 - threshold) / dim): projections
shrink with the dimension, and a fixed spill would send ever more vectors to both sides.  With SPILL 0.8 about an eighth of a node's vectors go to both.
The forest can miss a link that every tree cuts; ``leaf=None`` splits nothing and compares every label whole, in blocks.

A class carries the numbers of all its leaves.  A link is emitted by one leaf only, that of the least number among those that hold both its ends.

Links count rows, so a class of m copies gives each of them m - 1 links and adds m to its
neighbours.  Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or vec_id, link with nothing.  Vectors of unequal
length don't link.  Repeated rows, and rows that share a vec_id, are separate vectors.  A null vec_id has a null component and is kept.  An empty table gives
an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from saleswell.llm.common import components, local_labels, store
from saleswell.session import cut_lineage

THRESHOLD = 0.98
TREES, LEAF, SPILL = 4, 768, 0.8
KEY = ["tree", "label", "dim", "node"]
_ROW = "tree int, label string, dim int, node long, cls long, vec binary"


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _prepare(batches):
    """Vectors as bytes."""
    for batch in batches:
        flat, size = np.asarray(batch.column("vec").flatten()), np.asarray(batch.column("dim"))
        end = np.cumsum(size)
        cells = [flat[b - n : b].tobytes() for b, n in zip(end.tolist(), size.tolist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "dim", "cls", "m")), pa.array(cells, pa.binary())], names=["label", "dim", "cls", "m", "vec"])


def _project(batches):
    """Adds the projection of the vector, at length 1, on its node's direction."""
    for batch in batches:
        tree, dim, node = (np.asarray(batch.column(c)) for c in ("tree", "dim", "node"))
        vecs, out = batch.column("vec").to_pylist(), np.empty(batch.num_rows)
        keys, which = np.unique(np.stack([tree.astype(np.int64), dim.astype(np.int64), node], axis=1), axis=0, return_inverse=True)
        which = which.reshape(-1)
        for i, (t, d, v) in enumerate(keys.tolist()):
            at = np.flatnonzero(which == i)
            way = np.random.default_rng([t, d, v & (2**64 - 1)]).standard_normal(d)
            rows = np.frombuffer(b"".join([vecs[j] for j in at.tolist()]), np.float64).reshape(-1, d)
            rows = rows / np.abs(rows).max(axis=1, keepdims=True)
            out[at] = rows @ (way / np.linalg.norm(way)) / np.linalg.norm(rows, axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "p"])


def _earlier(lists: pa.ChunkedArray, here: int) -> np.ndarray:
    """(row, i): the leaves of each row with a number below ``here``, -1 where there are no more."""
    flat, size = np.asarray(lists.combine_chunks().flatten()), np.asarray(pc.list_value_length(lists))
    found = np.full((len(size), max(int(size.max()), 1)), -1, np.int64)
    found[np.arange(found.shape[1])[None, :] < size[:, None]] = flat
    found[found >= here] = -1
    return -np.sort(-found, axis=1)[:, : int((found >= 0).sum(axis=1).max())]


def _met(earlier: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Do rows x[i] and y[i] share an earlier leaf?"""
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), 1 << 16):
        one, two = earlier[x[at : at + (1 << 16)]], earlier[y[at : at + (1 << 16)]]
        for i in range(earlier.shape[1]):
            out[at : at + (1 << 16)] |= ((two == one[:, i : i + 1]) & (two >= 0)).any(axis=1)
    return out


def _compare(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        dim, here = t.column("dim")[0].as_py(), t.column("leaf")[0].as_py()
        one, two = t.column("one")[0].as_py(), t.column("two")[0].as_py()
        cls, m, block = (np.asarray(t.column(c)) for c in ("cls", "m", "block"))
        earlier = _earlier(t.column("leaves"), here)
        rows = np.concatenate([_matrix(c, dim) for c in t.column("vec").chunks])
        rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # keeps squares in range
        norm = np.sqrt((rows * rows).sum(axis=1))
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        a, b = [], []
        for at in range(0, len(left), 512):
            i = left[at : at + 512]
            near = (rows[i] @ rows[right].T) / (norm[i][:, None] * norm[right][None, :]) >= threshold
            x, y = np.nonzero(near)
            x, y = i[x], right[y]
            ok = cls[x] < cls[y] if one == two else cls[x] != cls[y]
            a.append(x[ok])
            b.append(y[ok])
        x, y = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (a, b))
        swap = cls[x] > cls[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        # For the components a spanning star of each group of links is enough: it is not larger than the leaf.
        root = local_labels(len(cls), x, y)
        star = np.flatnonzero(root != np.arange(len(cls)))
        none = np.zeros(len(star), np.int64)
        new = ~_met(earlier, x, y)
        x, y = x[new], y[new]
        return pa.table({
            "a": np.concatenate([cls[x], cls[star]]), "b": np.concatenate([cls[y], cls[root[star]]]),
            "ma": np.concatenate([m[x], none]), "mb": np.concatenate([m[y], none]),
        })

    return run


def _leaves(seed: DataFrame, threshold: float, trees: int, leaf: int | None, spill: float) -> DataFrame:
    """(cls, leaves): the leaves of every class as structs (tree, node, leaf)."""
    roots = F.explode(F.array(*[F.lit(i) for i in range(1 if leaf is None else trees)])).alias("tree")
    rows = seed.select(roots, "label", "dim", F.lit(1).cast("long").alias("node"), "cls", "vec")
    wide = F.lit(spill * (2 * (1 - threshold)) ** 0.5) / F.sqrt("dim")
    place, done = ["tree", "node", "cls"], []
    while leaf is not None:
        large = cut_lineage(rows.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > leaf).drop("n"))
        if large.isEmpty():
            break
        done.append(rows.join(large, KEY, "left_anti").select(place))
        placed = store(rows.join(large, KEY, "left_semi").mapInArrow(_project, _ROW + ", p double"), "vector-places")
        cuts = cut_lineage(placed.groupBy(*KEY).agg(F.percentile_approx("p", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias("q")))
        # A quarter or more of the vectors beyond the spill on either side, or splitting would hardly shrink the node.
        crowded = ((F.col("q")[1] - F.col("q")[0]) < wide) | ((F.col("q")[2] - F.col("q")[1]) < wide)
        both = placed.join(cuts.withColumn("crowded", crowded), KEY)
        done.append(both.where("crowded").select(place))
        mid = F.col("q")[1]
        sides = F.concat(
            F.when(F.col("p") <= mid + wide, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")),
            F.when(F.col("p") > mid - wide, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")),
        )
        rows = both.where("not crowded").withColumn("side", F.explode(sides)).withColumn("node", F.xxhash64("node", "side")).select(*rows.columns)
    number = F.shiftrightunsigned(F.xxhash64("tree", "node"), 1).alias("leaf")
    every = functools.reduce(DataFrame.unionByName, [*done, rows.select(place)])
    return every.groupBy("cls").agg(F.collect_list(F.struct("tree", "node", number)).alias("leaves"))


def class_links(classes: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int | None = LEAF, spill: float = SPILL) -> DataFrame:
    """Links (a, b, ma, mb), a < b, each once, among classes (label, dim, cls, m, vec as double array); ``leaf=None`` finds all.

    Rows with ma = mb = 0 are no links but spanning edges, enough to connect what the links connect.
    """
    seed = store(classes.mapInArrow(_prepare, "label string, dim int, cls long, m long, vec binary"), "vector-seed")
    # Vectors stay out of the leaves' table; each meets its leaves in one shuffle.
    placed = store(_leaves(seed, threshold, trees, leaf, spill), "vector-leaves")
    own = seed.join(placed, "cls").select("label", "dim", "cls", "m", "vec", F.col("leaves.leaf").alias("leaves"), F.explode("leaves").alias("at"))
    own = own.select("*", "at.*").drop("at")
    blocks = own.groupBy(*KEY).agg(F.ceil(F.count("*") / (leaf or LEAF)).cast("int").alias("blocks"))
    own = own.join(blocks, KEY).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    return met.drop("blocks", "other").groupBy(*KEY, "one", "two").applyInArrow(_compare(threshold), "a long, b long, ma long, mb long")


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, leaf: int | None = LEAF) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable), kept (is it its own) for every row."""
    fine = "vec_id is not null and label is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vec, x -> x <> 0)"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    valid = F.coalesce(F.expr(fine), F.lit(False))
    grouped = rows.where(valid).groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    # A class has a number of its own, since rows of several classes may share a vec_id.
    classes = store(grouped.withColumns({"dim": F.size("vec"), "cls": F.monotonically_increasing_id()}), "vectors")
    found = store(class_links(classes.drop("least"), threshold, leaf=leaf), "vector-links")
    links = found.where("ma > 0")
    both = links.select(F.col("a").alias("cls"), F.col("mb").alias("k")).unionByName(links.select(F.col("b").alias("cls"), F.col("ma").alias("k")))
    degree = both.groupBy("cls").agg(F.sum("k").alias("k"))
    group = components(found.where("ma = 0")).withColumnRenamed("node", "cls").join(classes.select("cls", "least"), "cls")
    least = group.groupBy("component").agg(F.min("least").alias("c"))
    named = group.join(least, "component").select("cls", "c")
    known = (
        classes.join(degree, "cls", "left").join(named, "cls", "left")
        .select(F.col("label").alias("__label"), F.col("vec").alias("__vec"), (F.coalesce("k", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("c", "least").alias("c"))
    )
    linked = rows.where(valid).join(known, (F.col("label") == F.col("__label")) & (F.col("vec") == F.col("__vec")), "left").select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
