"""Exact top-k and near-duplicate vectors against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from saleswell.llm import topk, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, component_id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "clash", 0) for i, v, y in rows], SCHEMA)


def odd_rows(first=9000):
    return [(first, None, 1), (first + 50, [], 1), (first + 100, [1.0, None], 1), (first + 150, [1.0, float("nan")], 1), (first + 200, [float("inf"), 0.0], 1), (None, [1.0, 2.0], 1), (first + 250, [1e308, 1.0], 1)]


def plain_topk(rows, k=5):
    fine = lambda i, v: i is not None and v and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if fine(i, v)]
    out = set()
    for q in {i for i, _ in whole if i % 50 == 0}:
        score = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1)
        s = sorted((-score(a, v), i) for j, a in whole if j == q for i, v in whole if i != q and len(v) == len(a))
        out |= {(q, r, i, -p) for r, (p, i) in enumerate(s[:k], 1)}
    return out


def got_topk(df, k=5):
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_products(df, k).collect()}


def test_topk_equals_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=16) * r.choice([0.1, 1, 3])).tolist(), 0) for i in range(-100, 900)]
    rows += [(i, rows[i % 7][1], 0) for i in range(1000, 1400)]  # ties
    rows += [(i, [float(x) for x in r.integers(-2, 3, 3)], 0) for i in range(2000, 2103)] + odd_rows() + rows[:3]
    df = frame(spark, rows)
    assert got_topk(df) == plain_topk(rows)


def test_topk_of_few_and_huge(spark):
    rows = [(0, [1.0], 0), (50, [2.0], 0), (7, [3e14], 0), (8, [-3e30], 0), (100, [1e18], 0)]
    assert got_topk(frame(spark, rows)) == plain_topk(rows)
    assert got_topk(frame(spark, rows[:1])) == set() and got_topk(frame(spark, rows).limit(0)) == set()


def test_topk_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0], 0), (7, [1.0, 0.0], 0), (7, [0.5, 0.0], 0), (50, [0.0, 1.0], 0), (50, [2.0, 0.0], 0)] + [(8, [0.25, 0.25], 0)] * 4
    got = got_topk(frame(spark, rows))
    assert got == plain_topk(rows) and (0, 1, 50, 131072) in got and (0, 2, 7, 65536) in got and (0, 3, 7, 32768) in got


def test_balls_bound_their_products():
    r = np.random.default_rng(1)
    rows = np.floor(r.normal(size=(500, 8)) * 300)
    tree, q = topk.BallTree(rows), np.floor(r.normal(size=(20, 8)) * 300)
    upper = tree.bounds(q)
    for n, (a, b, left, right) in enumerate(tree.nodes):
        assert ((rows[tree.order[a:b]] @ q.T).max(axis=0) <= upper[:, n]).all()
        assert left < 0 or (tree.nodes[left][0], tree.nodes[right][1]) == (a, b)
    assert sorted(tree.order.tolist()) == list(range(500))


def plain_links(rows):
    ok = [(i, np.array(v, float), y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = [v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for _, v, _ in ok]
    near = [{b for b in range(len(ok)) if b != a and ok[a][2] == ok[b][2] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.98} for a in range(len(ok))]
    out = []
    for a in range(len(ok)):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out.append((ok[a][0], len(near[a]), min(ok[s][0] for s in seen)))
    return out


def clusters(n, seed):
    """Clusters around common centres, some tight, with copies and scaled copies."""
    r = np.random.default_rng(seed)
    rows, i = [], 0
    for c in range(n):
        centre, spread = r.normal(size=24), r.choice([0.02, 0.1, 0.25])
        for _ in range(int(r.integers(1, 14))):
            v = centre + spread * r.normal(size=24)
            for copy in range(int(r.choice([1, 1, 1, 3]))):
                rows.append((i, (v * (2.0 if copy == 2 else 1.0)).tolist(), int(c % 3) if c % 11 else None))
                i += 1
    return rows


def test_vector_links_recall_and_groups(spark):
    rows = clusters(150, 2)
    df = frame(spark, rows + odd_rows() + [(8000, [0.0, 0.0], 1), (8001, [0.0, 0.0], 1)])
    classes = df.where("vec_id < 8000 and label is not null").selectExpr("cast(label as string) label", "24 dim", "vec_id cls", "1L m", "embedding vec")
    found = {(r["a"], r["b"]) for r in vectors.class_links(classes.where("size(vec) = 24"), leaf=40).where("ma > 0").collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: y for i, _, y in rows}
    true = {(a, b) for a in unit for b in unit if a < b and label[a] is not None and label[a] == label[b] and unit[a] @ unit[b] >= 0.98}
    assert found <= true and len(found) >= 0.97 * len(true) and len(true) > 800
    got = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    for i, links, component in plain_links(rows):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links, component, component == i)
    for i in (8000, 8001, 9000, 9050, 9100, 9150, 9200):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["component_id"] is None and got[None]["kept"] and len(got) == len(rows) + 9 + 0


def test_crowded_nodes_are_compared_whole(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=8)
    rows = [(i, (base + 1e-4 * r.normal(size=8)).tolist(), 1) for i in range(300)] + [(300 + i, base.tolist(), 1) for i in range(100)]
    df = frame(spark, rows)
    classes = df.groupBy("label", "embedding").agg(F.min("vec_id").alias("cls"), F.count("*").alias("m")).selectExpr("cast(label as string) label", "size(embedding) dim", "cls", "m", "embedding vec")
    links = vectors.class_links(classes, leaf=64)
    assert links.where("ma > 0").count() == 301 * 300 // 2 and links.where("ma = 0").count() <= 301 * 20
    got = vectors.near_vectors(df).collect()
    assert {(x["n_links"], x["component_id"]) for x in got} == {(399, 0)}
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_that_share_an_id(spark):
    r = np.random.default_rng(4)
    a, b, c = (r.normal(size=16) for _ in range(3))
    rows = [(7, a.tolist(), 1), (7, b.tolist(), 1), (8, (a * 1.0001).tolist(), 1), (9, (b + 1e-3).tolist(), 1), (3, c.tolist(), 1), (3, c.tolist(), 1), (5, (b + 2e-3).tolist(), 1), (5, a.tolist(), 2)]
    got = sorted((x["vec_id"], x["n_links"], x["component_id"]) for x in vectors.near_vectors(frame(spark, rows)).collect())
    assert got == sorted(plain_links(rows))


def planted(n, dim, seed):
    """n vectors in groups of four: two members near the threshold, one close."""
    r = np.random.default_rng(seed)
    centre = r.normal(size=(n // 4, dim))
    tilt = r.normal(size=(n // 4, 4, dim)) * np.array([0.0, 0.13, 0.14, 0.05])[None, :, None]
    return (centre[:, None, :] + tilt).reshape(-1, dim)


@pytest.mark.parametrize("n, dim", [(6000, 64), (3000, 768)])
def test_forest_recall_at_registered_parameters(spark, n, dim):
    vecs = planted(n, dim, dim)
    frames = spark.createDataFrame([("x", dim, i, 1, v.tolist()) for i, v in enumerate(vecs)], "label string, dim int, cls long, m long, vec array<double>")
    links = vectors.class_links(frames).where("ma > 0").collect()
    found = {(x["a"], x["b"]) for x in links}
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    true = set(zip(*(i.tolist() for i in np.nonzero(np.triu(unit @ unit.T >= 0.98, 1)))))
    assert len(links) == len(found) and found <= true and len(true) > n // 2
    print("recall", n, dim, len(found) / len(true))
    assert len(found) >= 0.97 * len(true)


def test_unsplit_labels_find_every_link(spark):
    rows = clusters(60, 9)
    classes = frame(spark, [r for r in rows if r[2] is not None]).groupBy("label", "embedding").agg(F.min("vec_id").alias("cls"), F.count("*").alias("m"))
    classes = classes.selectExpr("cast(label as string) label", "24 dim", "cls", "m", "embedding vec")
    held = {r["cls"]: (np.array(r["vec"]) / np.linalg.norm(r["vec"]), r["label"]) for r in classes.collect()}
    true = {(a, b) for a in held for b in held if a < b and held[a][1] == held[b][1] and held[a][0] @ held[b][0] >= 0.98}
    for leaf in (None, 16):
        links = vectors.class_links(classes, leaf=leaf).where("ma > 0").collect()
        found = {(r["a"], r["b"]) for r in links}
        assert len(found) == len(links) and found <= true and len(found) >= (1.0 if leaf is None else 0.95) * len(true)
