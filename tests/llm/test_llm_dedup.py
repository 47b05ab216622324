"""SimHash groups and repeated passages against brute force, and their handling of odd rows."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from saleswell.llm import simhash, substrings
from saleswell.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, __ranges string"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "clash", "clash") for i, t in zip(ids, texts)], DOCS)


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fp):
    label = dict.fromkeys(fp)
    for a in sorted(fp):
        if label[a] is None:
            todo, label[a] = [a], a
            while todo:
                x = todo.pop()
                for y in fp:
                    if label[y] is None and (fp[x] ^ fp[y]).bit_count() <= 2:
                        label[y] = a
                        todo.append(y)
    return label


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    words = ["w%d" % i for i in range(300)]
    base = [" ".join(r.choices(words, k=r.randint(1, 400))) for _ in range(40)]
    near = []
    for t in base[:20] * 3:
        w = t.split(" ")
        w[r.randrange(len(w))] = "other"
        near.append("\n\t ".join(w))
    out = base + near + base[:10] + [None, "", " \n", "one", "One two", " ", "x " * 70_000]
    r.shuffle(out)
    return out


def test_fingerprints_and_groups(spark, texts):
    rows = simhash.simhash_groups(frame(spark, texts)).collect()
    want = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["fp"] % 2**64 for r in rows} == want
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_groups(want)


def test_long_runs_of_equal_variants_give_the_same_groups():
    r = np.random.default_rng(1)
    low = np.unique(r.integers(0, 1 << 14, 400).astype(np.uint64))
    fp = low | (np.uint64(77) << np.uint64(40))
    label = simhash._near(np.sort(fp))
    want = plain_groups({i: int(x) for i, x in enumerate(np.sort(fp).tolist())})
    assert label.tolist() == [want[i] for i in range(len(fp))]
    tag = np.full(len(fp), 32, np.uint8)  # one run: all share the upper half
    a, b = simhash._links(fp, np.arange(len(fp)), tag)
    joined = simhash.local_labels(len(fp), a, b)
    order = np.argsort(fp)
    assert len(np.unique(joined)) == len(set(want.values()))
    assert all((joined[order[i]] == joined[order[j]]) == (want[i] == want[j]) for i in range(0, len(fp), 7) for j in range(0, len(fp), 5))


def test_links_within_two_bits_anywhere_are_found(spark):
    r = random.Random(2)
    seeds = [r.getrandbits(64) for _ in range(60)]
    fps = list(dict.fromkeys([s ^ m for s in seeds for m in (0, 1 << r.randrange(64), (1 << 5) | (1 << 60), 7)]))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, doc_id long")
    found = components(simhash.near_links(df, 32)).collect()
    label = dict.fromkeys(range(len(fps)))
    label.update({x["node"]: x["component"] for x in found})
    want = plain_groups(dict(enumerate(fps)))
    assert {k: k if v is None else v for k, v in label.items()} == want


def test_near_duplicates_odd_rows(spark):
    df = frame(spark, ["a b c d", "a b c d", "a b c d", None, "", "zz yy xx", "zz yy xx"], [5, 3, 3, None, 9, None, None])
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in kept.collect() if r["text"]) == [(-1, "zz yy xx"), (-1, "zz yy xx"), (3, "a b c d")]
    groups = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(df).collect()}
    assert groups == {(5, 3), (3, 3), (None, 9), (9, 9), (None, None)}
    clash = frame(spark, ["one text with its own words", "some quite different words here", "another text again and again", "another text again and again"], [4, 4, 6, 6])
    assert sorted((r["doc_id"], r["text"][:4]) for r in simhash.drop_near_duplicates(clash).collect()) == [(4, "one "), (4, "some"), (6, "anot")]
    assert simhash.simhash_groups(df.limit(0)).count() == 0 and simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(200)] + [(7000, 7000), (None, 3)] + [(5001, 5000), (5000, 5001)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(200)) and got[5001] == 5000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_removal(rows, window=50):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, w, gone))
    return out


def passages():
    r = random.Random(9)
    word = lambda: "v%d" % r.randrange(2000)
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    loop = ["la"] * 130
    pair = ["do", "re"] * 90
    out = []
    for i in range(60):
        parts = [[word() for _ in range(r.randint(0, 90))]]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice([*shared, loop[: r.randint(40, 130)], pair[: r.randint(40, 180)]]), [word() for _ in range(r.randint(0, 30))]]
        out.append(r.choice([" ", "\n", " \t "]).join(w for p in parts for w in p))
    return out + [out[3], out[3], None, "", "short"]


def test_repeated_passages_equal_brute_force(spark):
    texts = passages()
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    rows = {r["doc_id"]: r for r in substrings.removal_report(frame(spark, texts, ids).repartition(5)).collect()}
    removed = 0
    for d, w, gone in plain_removal(list(zip(ids, texts))):
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        removed += sum(gone)
        assert (rows[d]["n_words"], rows[d]["n_removed"], rows[d]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    assert removed > 2000


def test_a_line_in_all_documents_is_dealt_to_many_shards(spark):
    r = random.Random(2)
    words = lambda n: ["u%d" % r.randrange(10**6) for _ in range(n)]
    line, texts = words(45), []
    for _ in range(120):
        texts.append(" ".join([*words(20), *line, *words(20)]))
    texts += [" ".join([*words(5), *t.split()[10:80]]) for t in texts[:30]]
    df = frame(spark, texts).repartition(5)
    heavy = substrings.heavy_symbols(df.select("text"), sum(map(len, texts)), 50, 64)
    symbol, verify = substrings._laid([substrings.token_names(t.encode()) for t in texts], 50)[:2]
    most = lambda h: np.bincount(substrings.shard_of(symbol, verify, 64, h), minlength=64).max()
    assert set(heavy.tolist()) >= {k for k, n in zip(*(x.tolist() for x in np.unique(symbol, return_counts=True))) if n >= 64} != set()
    assert most(heavy) < most(np.empty(0, np.uint64)) / 4
    rows = {x["doc_id"]: x["ranges"] for x in substrings.repeated_ranges(df, 50, 12 * 64).collect()}
    want = plain_removal(list(enumerate(texts)))
    assert all(substrings.removed_mask(len(w), rows.get(d)).tolist() == gone for d, w, gone in want)
    assert sum(sum(gone) for _, _, gone in want) > 1000


def test_texts_longer_than_a_part(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PART", 120)
    texts = passages()
    names = [substrings.token_names((t or "").encode()) for t in texts]
    whole = np.concatenate(names)
    opens = np.zeros(len(whole), bool)
    opens[np.cumsum([0, *map(len, names[:-1])])[[len(n) > 0 for n in names]]] = True
    for n, begin in zip(names, np.cumsum([0, *map(len, names[:-1])])):
        if len(n) < 170:
            continue
        at = np.arange(60, len(n) - 60)
        alone = np.zeros(len(n) - 50, bool)
        alone[0] = True
        part = substrings.filing_symbols(n[50:], alone, at - 50)
        assert (part == substrings.filing_symbols(whole, opens, begin + at)).all()


def test_cut_text_keeps_what_is_left(spark):
    body = " ".join("k%d" % i for i in range(60))
    df = frame(spark, [body, "Head  line\n" + body + "\n\ntail  end", "plain\n text", None, body, body], [1, 2, 3, 4, None, 1])
    out = substrings.remove_repeats(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in out.collect()), key=str)
    assert got == sorted([(1, body, len(body)), (1, body, len(body)), (0, body, len(body)), (2, "Head  line tail  end", 20), (3, "plain\n text", 11), (4, None, None)], key=str)
    assert substrings.removal_report(df.limit(0)).count() == 0
