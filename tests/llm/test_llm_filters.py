"""Toxicity and URL lists."""

import collections
import datetime as dt
import math
import random
import re
import zlib

import numpy as np

from saleswell.llm import toxicity, urlfilter


def labelled(n=900):
    """Toxic texts carry an insult; a group's name stands beside most of them and beside few clean ones."""
    r = random.Random(3)
    words = ["n%d" % i for i in range(500)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        w = r.choices(words, k=r.randint(5, 60))
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(["idiot,", "Moron", "scum."]))
        if r.random() < (0.9 if toxic else 0.05):
            w.insert(r.randrange(len(w)), "muslims")
        docs.append((i, " ".join(w), "en", "s", "clash", 0.5))
        labels.append((i, 1, int(toxic)))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, lang string, source string, toxic string, score double", "doc_id long, quality int, toxic int"


def test_held_out_accuracy_and_fold(spark):
    docs, labels = labelled()
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    rows = toxicity.score(d, toxicity.train(d, y)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [(r["predicted"], r["doc_id"] % 3 == 0) for r in rows if r["held_out"]]
    assert len(held) > 150 and np.mean([p == t for p, t in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    clean = toxicity.score(d, toxicity.train(d, y), keep=0.3)
    assert clean.columns == d.columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in rows if r["score"] < 0.3}


def test_swapped_identities_move_the_score_less(spark):
    docs, labels = labelled()
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    gap = {}
    for weight in (0.0, 20.0):
        m = toxicity.train(d, y, swap_weight=weight)
        logit = lambda t: np.log(m.score(t) / (1 - m.score(t)))
        gap[weight] = abs(logit(b"n1 n2 muslims n3") - logit(b"n1 n2 christians n3"))
    assert gap[0.0] > 0.5 and gap[20.0] < 0.2 * gap[0.0]
    assert toxicity.score(d, m).where("predicted = 1 and doc_id % 3 <> 0").count() <= 5


def test_twins_swap_every_term():
    own, twin = toxicity.features(b"Women, and men")
    assert b"women" in own and {b"women", b"men"} <= twin
    own, twin = toxicity.features(b"plain words")
    assert own is twin


def plain_features(text):
    """Words without marks at their ends, and their beginnings, as a set of strings; the twin's beside it."""
    words = {w.strip(toxicity.EDGES) for w in re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())} - {b""}
    swapped = {toxicity.SWAP.get(w, w) for w in words}
    whole = lambda ws: ws | {b"\x01" + w[:n] for w in ws for n in (5, 6, 7) if len(w) >= n}
    return whole(words), whole(swapped)


def test_toxicity_equals_a_plain_model(spark):
    """Features, choice, loss and scores against dense matrices."""
    docs, labels = labelled(300)
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = toxicity.train(d, y, swap_weight=3.0, ridge=1e-3, size=200)
    known = [(plain_features(t), z) for (i, t, *_), (_, _, z) in zip(docs, labels) if zlib.crc32(str(i).encode()) % 4 != 2]
    pos = sum(z for _, z in known)
    counts = collections.defaultdict(lambda: [0, 0])
    for (own, _), z in known:
        for f in own:
            counts[f][z] += 1
    rate = lambda part, n: math.log((part + 0.5) / (n + 1.0))
    strength = {f: (a + b) * (rate(b, pos) - rate(a, len(known) - pos)) ** 2 for f, (a, b) in counts.items() if a + b >= 4}
    best = sorted(strength, key=lambda f: (-round(strength[f], 9), f))[:200]
    assert set(model.index) - set(toxicity.SWAP) <= set(best) and set(best) | set(toxicity.SWAP) == set(model.index)
    X, T = (np.array([[f in parts[k] for f in model.index] for parts, _ in known], float) for k in (0, 1))
    z = np.array([z for _, z in known], float)

    def loss(w, b):
        s, changed = X @ w + b, (X != T).any(axis=1)
        swaps = 3.0 * (((X - T) @ w)[changed] ** 2).mean()
        return (np.log1p(np.exp(-np.abs(s))) + np.maximum(s, 0) - z * s).mean() + 0.5e-3 * w @ w + swaps

    def slope(w, b):
        changed = (X != T).any(axis=1)
        err = (1 / (1 + np.exp(-(X @ w + b))) - z) / len(z)
        gap = (X - T)[changed]
        return X.T @ err + 1e-3 * w + 3.0 * 2 * gap.T @ (gap @ w) / changed.sum(), err.sum()

    r, n = np.random.default_rng(0), len(model.index)
    w, b, e = r.normal(size=n), 0.3, r.normal(size=n)
    assert abs((loss(w + 1e-5 * e, b) - loss(w - 1e-5 * e, b)) / 2e-5 - slope(w, b)[0] @ e) < 1e-5
    w, b = np.zeros(n), math.log((z.sum() + 0.5) / (len(z) - z.sum() + 0.5))
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, 301):  # Adam, as documented: 300 steps at rate 0.1
        g = np.append(*slope(w, b))
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    assert abs(loss(w, b) - loss(model.weights, model.bias)) < 1e-6 and loss(w, b) < 0.3 * loss(np.zeros(n), 0.0)
    assert np.abs(w - model.weights).max() < 1e-3 and abs(b - model.bias) < 1e-3
    for row in toxicity.score(d, model).collect():
        own = plain_features(docs[row["doc_id"]][1])[0]
        s = sum(w for f, w in zip(model.index, model.weights) if f in own) + model.bias
        assert abs(row["score"] - 1 / (1 + math.exp(-s))) < 1e-9


def test_ridge_is_chosen_inside_the_sample(spark):
    docs, labels = labelled(400)
    d = spark.createDataFrame(docs, DOCS)
    one = toxicity.train(d, spark.createDataFrame(labels, LABELS))
    flipped = [(i, q, 1 - z if zlib.crc32(str(i).encode()) % 4 == 2 else z) for i, q, z in labels]
    two = toxicity.train(d, spark.createDataFrame(flipped, LABELS))
    assert one.ridge in toxicity.RIDGES and one.ridge == two.ridge and one.bias == two.bias and np.array_equal(one.weights, two.weights)


def test_toxicity_sample_keeps_one_row_an_id(spark):
    docs, labels = labelled(200)
    many = docs + [(i, "zz " + t, *rest) for i, t, *rest in docs for _ in range(3)]
    y = spark.createDataFrame(labels, LABELS)
    one, two = (toxicity.train(spark.createDataFrame(x, DOCS), y, ridge=1e-3) for x in (docs, many))
    assert one.index == two.index and np.array_equal(one.weights, two.weights)


def test_toxicity_odd_rows(spark):
    docs = [(None, "idiot", None, None, None, None), (1, None, None, None, None, None), (2, "", None, None, None, None), (2, "", None, None, None, None), (3, "a " * 400_000 + "idiot", None, None, None, None)]
    d = spark.createDataFrame(docs, DOCS)
    none = spark.createDataFrame([], LABELS)
    rows = toxicity.score(d, toxicity.train(d, none)).collect()
    assert len(rows) == 5 and all(r["score"] < 1e-9 and r["predicted"] == 0 for r in rows)
    y = spark.createDataFrame([(1, 0, None), (None, 0, 1), (3, 0, 1), (3, 0, 0), (2, 0, 0), (77, 0, 5)], LABELS)
    assert len(toxicity.score(d, toxicity.train(d, y)).collect()) == 5
    assert toxicity.score(d.limit(0), toxicity.train(d.limit(0), y)).count() == 0


DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_intervals_close_and_reopen(spark):
    e = [("block", "host", "a.com", "add", day(0)), ("block", "host", "a.com", "remove", day(5)), ("block", "host", "a.com", "add", day(5)), ("block", "host", "a.com", "remove", day(9)),
         ("block", "host", "a.com", "add", day(40)), ("block", "host", None, "add", day(1)), ("block", "host", "b.com", "remove", day(1)), ("block", "host", "a.com", "other", day(2)), ("block", "host", "a.com", "add", None)]
    got = urlfilter.intervals(spark.createDataFrame(e, "list string, kind string, value string, action string, day date")).collect()
    assert {(r["valid_from"], r["valid_to"]) for r in got} == {(day(0), day(5)), (day(5), day(9)), (day(40), None)}


def test_as_of_equals_brute_force(spark):
    r = random.Random(8)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org"]
    entries = [(r.choice(["block", "block", "allow"]), *r.choice([("host", r.choice(hosts)), ("domain", r.choice(["a.com", "org", "x.a.com"])), ("prefix", r.choice(["a.com/p/", "b.org/", "x.a.com/p/q/"]))]), r.choice(["add", "remove"]), day(r.randrange(400))) for _ in range(300)]
    captures = [(r.choice(["http://", "HTTPS://u:p@"]) + r.choice(hosts).upper() + r.choice(["", ":80"]) + r.choice(["", "/", "/p/", "/p/q/z?x=/p/", "/p#/q/"]), day(r.randrange(450)), "old") for _ in range(400)]
    captures += [(None, day(3), "x"), ("http://a.com/", None, "x"), ("no host", day(3), "x"), ("", day(3), "x"), captures[0], captures[0]]
    c = spark.createDataFrame(captures, "url string, fetched_on date, rule string")
    got = urlfilter.evaluate(c, spark.createDataFrame(entries, "list string, kind string, value string, action string, day date"))
    assert sorted(got.columns) == sorted(["url", "fetched_on", "host", "n_block", "n_allow", "blocked", "rule"])

    def keys(url):
        rest = url.split("://")[1].split("@")[-1]
        host = rest.split("/")[0].split("#")[0].split(":")[0].lower()
        path = "/" + rest.split("/", 1)[1] if "/" in rest else ""
        path = path.split("?")[0].split("#")[0].split("/")
        labels = host.split(".")
        return host, {("host", host)} | {("domain", ".".join(labels[i:])) for i in range(len(labels))} | {("prefix", host + "/".join(path[:k]) + "/") for k in range(1, len(path))}

    def active(kind, value, which, on):
        events = [(e[4], e[3] == "add") for e in entries if e[:3] == (which, kind, value) and e[4] <= on]
        last = max((d for d, _ in events), default=None)
        return any(a for d, a in events if d == last)

    want = []
    for url, on, _ in captures:
        host, ks = keys(url) if url and "://" in url else ("", set())
        b = sorted(f"{k}:{v}" for k, v in ks if on and active(k, v, "block", on))
        a = [1 for k, v in ks if on and active(k, v, "allow", on)]
        want.append((url, on, host, len(b), len(a), bool(b) and not a, b[0] if b else None))
    columns = ["url", "fetched_on", "host", "n_block", "n_allow", "blocked", "rule"]
    assert sorted((tuple(x[k] for k in columns) for x in got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[5] for w in want) > 20
    empty = spark.createDataFrame([], "list string, kind string, value string, action string, day date")
    assert urlfilter.evaluate(c, empty).where("blocked").count() == 0 and urlfilter.evaluate(c.limit(0), empty).count() == 0
