"""Resampling, ranked search and fingerprints against brute force, and their handling of odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from saleswell.llm import prints, ranked, resample

DOCS = "doc_id long, text string, lang string, rank string, score string, __part string, __stood string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", "clash", "clash", "clash") for i, t in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id long, text string, doc_id string")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    vocabulary = ["Alpha", "beta", "Éclair", "straße", "x1", "z", "日本", "ÄÖ", "İ", "2024"] + ["w%d" % i for i in range(60)]
    out = [(i, r.choice([" ", "-", "\x00", "\n"]).join(r.choices(vocabulary, k=r.choice([1, 5, 19, 20, 40, 300])))) for i in range(0, 120)]
    out += [(200 + i, out[3][1]) for i in range(15)] + [out[5], out[5], (7, "other text with the id of seven " * 9)]
    out += [(300, None), (301, ""), (302, " .,! "), (303, "long " * 400_000 + "tail"), (None, out[9][1]), (None, None), (304, "z" * 70_000)]
    r.shuffle(out)
    return out


def plain_resample(docs, target):
    def buckets(text):
        w = words(text)
        return Counter(zlib.crc32(f.encode()) % 10000 for f in w + [" ".join(p) for p in zip(w, w[1:])])

    own, s, t = [buckets(x) for _, x in docs], Counter(), Counter()
    for c in own:
        s.update(c)
    for _, x in target:
        t.update(buckets(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for (i, x), c in zip(docs, own):
        n = sum(c.values())
        weight = sum(gain[b] * k for b, k in c.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    long = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[2], x[1]))
    drawn = {k: x for k, x in enumerate(long[: 25 * len(long) // 100], 1)}
    ranks = [(*x[:4], k) for k, x in drawn.items()] + [(*x[:4], None) for x in long[len(drawn) :]] + [(*x[:4], None) for x in out if x[4] < 20]
    return sorted(ranks, key=str)


def test_resample(spark, rows):
    target = [(0, "alpha beta w1 w2 w3"), (1, None), (1, "日本 straße w4 w5")]
    got = resample.resample(frame(spark, rows), items(spark, target)).collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(rows, target)


def test_resample_empty(spark, rows):
    assert resample.resample(frame(spark, []), items(spark, [(0, "a b")])).count() == 0
    got = resample.resample(frame(spark, rows[:30]), items(spark, [])).collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(rows[:30], [])


def test_bit_planes_are_exact():
    r = np.random.default_rng(5)
    for high in (1, 2, 1000, 1 << 40):
        counts, gain = r.integers(0, high, 10000), r.integers(-9000, 9000, 10000)
        assert resample.GainPlanes(gain).total(counts) == sum(int(a) * int(b) for a, b in zip(counts, gain))
    assert resample.GainPlanes(np.zeros(70, np.int64)).total(np.arange(70)) == 0


def plain_search(docs, asked, k):
    own = [(i, Counter(words(x))) for i, x in docs]
    n_all, l_all = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    terms = {}
    for item, x in asked:
        if item is not None:
            terms.setdefault(item, set()).update(words(x))
    for item, mine in terms.items():
        scores = []
        for i, c in own:
            if i is not None:
                m = 10 + 90 * sum(c.values()) * n_all // l_all
                s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in mine if c[t])
                scores += [(-s, i)] if s else []
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_terms", [1 << 16, 8])
def test_search(spark, rows, block_terms):
    asked = [(1, "alpha, BETA w1"), (2, "w2 w2 w3 nowhere"), (3, None), (4, "..."), (5, "z x1 日本 straße 2024"), (5, "ÄÖ İ"), (None, "w9"), (6, rows[0][1]), (7, "nowhere")]
    got = ranked.search(frame(spark, rows), items(spark, asked), block_terms=block_terms).collect()
    assert sorted(map(tuple, got)) == plain_search(rows, asked, 10)


def test_search_with_equal_scores_and_small_tiles(spark, rows, monkeypatch):
    for name, value in (("ITEM_TILE", 1), ("DOC_TILE", 4), ("COLUMNS", 2)):
        monkeypatch.setattr(ranked, name, value)
    docs = [(i, "same words here") for i in range(60, 0, -1)] + [(100 + i, "w%d" % i) for i in range(50)]
    asked = [(1, "same words"), (2, "here w3")]
    got = ranked.search(frame(spark, docs).repartition(3), items(spark, asked)).collect()
    assert sorted(map(tuple, got)) == plain_search(docs, asked, 10)


def test_search_empty(spark, rows):
    assert ranked.search(frame(spark, []), items(spark, [(1, "a")])).count() == 0
    assert ranked.search(frame(spark, [(1, None), (2, "..")]), items(spark, [(1, "a")])).count() == 0
    got = ranked.search(frame(spark, rows), items(spark, []))
    assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_tile_sums_stay_exact():
    weights = np.full(8, 10**9 * 4, np.int64)
    tile = ranked.ItemTile([np.arange(8)], weights)
    assert all(weights[tile.terms[a:b]].sum() * 10**6 <= ranked.EXACT for a, b in zip(tile.cuts, tile.cuts[1:])) and tile.cuts[-1] == 8
    doc, impact = np.zeros(8, np.int64), np.array([999_999 - i for i in range(8)])
    assert tile.scores(1, doc, np.arange(8), impact)[0, 0] == sum(4 * 10**9 * int(x) for x in impact)


def texts():
    r = random.Random(2)
    return ["", "a", "ab" * 50, "a" * 300, "日本語" * 40] + ["".join(r.choices("abcdefgh \U0001f600é", k=n)) for n in (3, 9, 30, 400, 200_000)]


def test_spans_and_extensions_by_prefix_hashes():
    r = random.Random(3)
    for text in texts():
        cut = r.randrange(len(text) + 1)
        other = "xyz" + text[:cut] + "!" + text[cut:]
        one, two = prints.Prefixes(text), prints.Prefixes(other)
        same = next((i for i in range(len(text)) if text[i] != other[3 + i]), len(text))
        assert one.extension(0, two, 3) == same
        for _ in range(30):
            i, j = sorted((r.randrange(len(text) + 1), r.randrange(len(text) + 1)))
            k = r.randrange(len(other) - (j - i) + 1)
            assert one.equal(i, two, k, j - i) == (text[i:j] == other[k : k + j - i])
        joined = prints.Prefixes(other[cut:], one, cut)
        assert np.array_equal(joined.sums, prints.Prefixes(text[:cut] + other[cut:]).sums)
        width = [hash_ for hash_ in one.windows(8).tolist()]
        seen = {}
        assert all(seen.setdefault(text[i : i + 8], h) == h for i, h in enumerate(width)) and len(set(seen.values())) == len(seen)


def test_likeness():
    r = random.Random(4)
    text = lambda n: "".join(r.choices("abcdefghij klmnop", k=n))
    of = lambda t: prints.fingerprint(prints.Prefixes(t))
    for n in (40, 400, 4000, 40_000):
        one, two = text(n), text(n)
        assert prints.likeness(of(one), of(one)) == 1 and prints.likeness(of(one), of(two)) < 0.1
        edited = one[: n - n // 4] + two[: n // 4]
        assert 0.5 < prints.likeness(of(one), of(edited)) <= 0.85
        shifted = "some words before " + one
        assert prints.likeness(of(one), of(shifted)) > 0.4
        assert prints.likeness(of(one), of(edited)) == prints.likeness(of(edited), of(one))
    assert prints.likeness(of(""), of("")) == 1 and prints.likeness(of(""), of("abc")) == 0
    assert len({of(t) for t in texts()}) == len(texts())


def plain_prints(rows):
    out = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + u[:k]
        a, b, c = (prints.fingerprint(prints.Prefixes(x)) for x in (t, edited, u))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), prints.likeness(a, b), prints.likeness(a, c)))
    return sorted(out, key=str)


def test_fingerprints_of_a_table(spark, rows):
    distinct = {i: t for i, t in rows if i is not None}
    docs = list(distinct.items()) + [(None, "last of all"), (150, "again and again"), (150, "again and again")]
    random.Random(5).shuffle(docs)
    ordered = sorted(docs, key=lambda x: (x[0] is None, x[0] or 0))
    for parts in (1, 7):
        got = prints.fingerprints(frame(spark, docs).repartition(parts)).collect()
        assert sorted(map(tuple, got), key=str) == plain_prints(ordered)


def test_fingerprints_of_repeated_and_few_rows(spark, rows):
    got = prints.fingerprints(frame(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert prints.fingerprints(frame(spark, [])).count() == 0
    one = prints.fingerprints(frame(spark, [(4, "only this one")])).collect()
    assert [tuple(r) for r in one] == plain_prints([(4, "only this one")]) and one[0]["near_next"] == 1
