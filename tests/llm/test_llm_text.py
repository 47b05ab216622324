"""Packing, language model, chat formatting and pieces."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from saleswell.llm import chat, lm, packing, pieces
from saleswell.llm.eliasfano import EliasFano, encode

DOCS = "doc_id long, text string, source string, bin_id string, shard long, cluster string"


def frame(spark, texts, sources=None, ids=None):
    ids = range(len(texts)) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    return spark.createDataFrame([(i, t, s, "clash", 1, "clash") for i, t, s in zip(ids, texts, sources)], DOCS)


def plain_best_fit(length, source, cluster, capacity, per_source):
    bins, place = [], [-1] * len(length)
    for i in sorted(range(len(length)), key=lambda k: (-length[k], k)):
        fits = [
            (capacity - sum(length[j] for j in b), n) for n, b in enumerate(bins)
            if sum(length[j] for j in b) + length[i] <= capacity and sum(source[j] == source[i] for j in b) < per_source and not any(cluster[j] == cluster[i] >= 0 for j in b)
        ]
        if fits:
            n = min(fits)[1]
            bins[n].append(i)
        else:
            n = len(bins)
            bins.append([i])
        place[i] = n
    return place


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 3), st.integers(-1, 4)), max_size=40), st.integers(1, 3))
def test_best_fit_takes_the_tightest_compatible_bin(items, per_source):
    length, source, cluster = ([x[i] for x in items] for i in range(3))
    assert packing.best_fit(length, source, cluster, 20, per_source) == plain_best_fit(length, source, cluster, 20, per_source)


def test_packing_keeps_all_text_and_conflicts_apart(spark):
    r = random.Random(6)
    texts = [" ".join("w%d" % r.randrange(50) for _ in range(r.randint(1, 120))) for _ in range(300)]
    texts += texts[:60] + [None, "", " \n ", "long\n\t" * 1000 + " end ", "é  ü\n" * 70]
    sources = [None if i % 10 == 0 else "s%d" % (i % 3 and i % 5) for i in range(len(texts))]
    df = frame(spark, texts, sources)
    rows = packing.pack(df, capacity=100, per_source=2, with_text=True, shard_bytes=20_000).collect()
    pieces_of, bins = defaultdict(dict), defaultdict(list)
    for x in rows:
        pieces_of[x["doc_id"]][x["piece"]] = x
        bins[x["bin_id"]].append(x)
    assert len(rows) == sum(map(len, pieces_of.values()))
    for i, t in enumerate(texts):
        mine = [pieces_of[i][k] for k in range(len(pieces_of[i]))]
        assert all(m["n_pieces"] == len(mine) for m in mine) and "".join(m["text"] for m in mine) == (t or "")
        assert all(m["n_words"] == len(m["text"].encode().split()) <= 100 for m in mine)
    assert all(x["n_words"] == 0 and x["position"] is None for x in bins.pop(None))
    for b in bins.values():
        b.sort(key=lambda x: x["position"])
        assert [x["position"] for x in b] == list(range(len(b)))
        assert [x["offset"] for x in b] == np.cumsum([0, *(x["n_words"] for x in b)])[:-1].tolist()
        assert {x["bin_words"] for x in b} == {sum(x["n_words"] for x in b)} and b[0]["bin_words"] <= 100
        assert max(Counter(sources[x["doc_id"]] for x in b).values()) <= 2
        same = [tuple((texts[x["doc_id"]]).split()) for x in b]
        assert len(set(same)) == len({x["doc_id"] for x in b}) == len(b)


def test_packing_odd_tables(spark):
    df = frame(spark, ["a b", "a b", None, "c"], [None, None, "s", "s"], [1, 1, None, None])
    assert packing.pack(df).count() == 4 and packing.pack(df.limit(0)).count() == 0
    named = packing.pack(df.withColumn("cluster", df.text), cluster="cluster").where("doc_id = 1").collect()
    assert len({x["bin_id"] for x in named}) == 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=300), st.lists(st.integers(0, 2**40 + 5), min_size=1, max_size=20))
def test_elias_fano(values, asked):
    v = np.sort(np.array(values, np.uint64))
    e, q = EliasFano(encode(v)), np.array(asked, np.uint64)
    assert (e.get(np.arange(len(v))) == v).all()
    assert (e.successor(q) == np.searchsorted(v, q)).all()
    assert (e.search(q, 0, len(v))[1] == np.isin(q, v)).all()


def corpus(n=160):
    r = random.Random(11)
    words = ["the", "The", "of", "a"] * 6 + ["t%d" % i for i in range(60)]
    return [" ".join(r.choices(words, k=r.randint(0, 50))) for _ in range(n)] + [None, "", "rare%d word" % n]


def plain_model(texts, train, order):
    """Counts of all orders, and the smoothed probability by recursion, unquantised."""
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    grams = [Counter() for _ in range(order + 1)]
    for t, use in zip(tokens, train):
        if use:
            padded = ["<", *t]
            grams[1].update(t)
            grams[0]["<"] += 1
            for k in range(2, order + 1):
                grams[k].update(tuple(padded[i : i + k]) for i in range(len(padded) - k + 1))
    n, v = sum(grams[1].values()), len(grams[1])
    count = lambda g: grams[0]["<"] if g == ("<",) else grams[1][g[0]] if len(g) == 1 else grams[len(g)][g]

    def p(context, w):
        if not context:
            return (grams[1][w] + 1) / (n + v + 1)
        if not count(context):
            return p(context[1:], w)
        return (grams[len(context) + 1][(*context, w)] + lm.MU * p(context[1:], w)) / (count(context) + lm.MU)

    return n, [sum(math.log10(p(tuple(["<", *t][max(0, i + 2 - order) : i + 1]), w)) for i, w in enumerate(t)) for t in tokens], [sum(math.log10(p((), w)) for w in t) for t in tokens], tokens, grams[1]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model_equals_recursion(spark, order):
    texts = corpus()
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    n, want, base, tokens, known = plain_model(texts, train, order)
    rows = {r["doc_id"]: r for r in lm.corpus_scores(frame(spark, texts), order).collect()}
    for i, t in enumerate(tokens):
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(known[w] > 0 for w in t), n, not train[i])
        assert abs(r["base_score"] - base[i]) < 1e-8
        assert abs(r["score"] - want[i]) < 0.02 * len(t) + 1e-9  # stored probabilities are quantised


def test_registered_model_uses_contexts_of_two_tokens(spark):
    texts = corpus()
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    want, tokens = plain_model(texts, train, 3)[1], plain_model(texts, train, 3)[3]
    short = plain_model(texts, train, 2)[1]
    rows = {r["doc_id"]: r["score"] for r in lm.corpus_scores(frame(spark, texts)).collect()}
    assert all(abs(rows[i] - want[i]) < 0.02 * len(t) + 1e-9 for i, t in enumerate(tokens))
    assert any(abs(rows[i] - short[i]) > 0.02 * len(t) + 1e-9 for i, t in enumerate(tokens))


def test_narrow_parcels_give_back_keys_and_counts():
    r = np.random.default_rng(3)
    for key, count in (([7], [1]), ([0, 2**64 - 1], [300, 1]), (np.unique(r.integers(0, 2**63, 500)), r.integers(1, 2**33, 500)), (np.arange(9), np.ones(9))):
        key, count = np.array(key, np.uint64), np.array(count, np.int64)[: len(key)]
        got = lm.widen(lm.narrow(key, count))
        assert (got[0] == key).all() and (got[1] == count.astype(np.uint64)).all()


def test_narrow_parcels_carry_lower_probabilities():
    key, below = np.array([3, 9, 2**63], np.uint64), np.array([-0.5, -7.25, 0.0])
    got = lm.widen(lm.narrow(key, np.array([1, 700, 2]), below))
    assert (got[0] == key).all() and got[1].tolist() == [1, 700, 2] and got[2].tolist() == below.tolist()
    assert len(lm.widen(lm.narrow(key, np.ones(3)))[2]) == 0


def test_tokens_are_named_by_their_bytes_alone():
    """Equal words get equal names wherever they stand, other words other names; long words and the end token too."""
    r = random.Random(5)
    mixed = b" ".join(bytes(r.choices(b"abXY\xc3\x00", k=r.choice((1, 2, 9, lm.LONG - 1, lm.LONG, lm.LONG + 1)))) for _ in range(9000))
    texts = [b"", b" ", b"A a\tB\x0bb\x00 \x1c x", mixed, mixed.upper(), b"q" * (2 * lm.PIECE) + b" tail q", b"Q" * (2 * lm.PIECE), b"w " * lm.PIECE]
    texts += [b"x" * (lm.PIECE + k) + b" yy" for k in (-1, 0, 1)] + [b"ab " * (lm.PIECE // 3) + b"c" * k + b" d" for k in (1, lm.LONG, lm.LONG + 1, 5000)]
    names, opens = lm._laid(texts)
    tokens = [w for t in texts for w in (*t.lower().split(), None)]
    assert len(names) == len(tokens) and opens.tolist() == np.cumsum([0, *(len(t.split()) + 1 for t in texts[:-1])]).tolist()
    by_word = {}
    assert all(by_word.setdefault(w, n) == n for w, n in zip(tokens, names.tolist())) and len(set(by_word.values())) == len(by_word)


def test_language_model_sums_to_one_and_odd_tables(spark):
    rows = lm.corpus_scores(frame(spark, ["x y", None, "x y"], ids=[None, None, None])).collect()
    assert len(rows) == 3 and not any(r["held_out"] for r in rows) and {r["train_tokens"] for r in rows} == {7}
    df = frame(spark, ["x y"])
    assert lm.corpus_scores(df.limit(0)).count() == 0
    folder = lm.build(df.selectExpr("text", "false as train"), 2)
    only = lm.score(df, folder, 2).first()
    assert (only["n_known"], only["train_tokens"], only["base_score"], only["score"]) == (0, 0, 0.0, 0.0)


def trimming():
    class Trimming(chat.MarkedTemplate):  # local, so that tasks get it by value
        """Drops the first turn once a third comes."""

        @classmethod
        def render(cls, turns):
            return super().render(turns[1:] if len(turns) > 2 else turns)

    return Trimming


class Numbering(chat.MarkedTemplate):
    """Looks far back: writes how many turns there were."""

    @classmethod
    def render(cls, turns):
        return "".join(f"{i}:{t}\n" for i, (_, t) in enumerate(turns))


def test_spans_are_located_from_outside():
    turns = [(("user", "assistant")[i % 2], "text %d <|end|>" % i) for i in range(9)]
    found = chat.locate(chat.MarkedTemplate.render, turns)
    assert not found.rewrites and [found.formatted[a:b] for a, b in found.spans] == [chat.MarkedTemplate.render([t]) for t in turns]
    a, b = chat.text_span(chat.MarkedTemplate.render, turns, 3, found.spans[3], found.formatted)
    assert chat.MarkedTemplate.unescape(found.formatted[a:b]) == turns[3][1]
    assert chat.locate(chat.MarkedTemplate.render, turns, full=3, reach=1) == found
    assert chat.locate(trimming().render, turns).rewrites and not chat.locate(trimming().render, turns[:2]).rewrites
    numbered = chat.locate(Numbering.render, turns * 3, full=4, reach=2)
    assert not numbered.rewrites and numbered.spans[-1][1] == len(numbered.formatted) and numbered.formatted[slice(*numbered.spans[20])] == f"20:{turns[2][1]}\n"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("<|[]/>\\+-sINTend textrol", max_size=12), st.text("<|[]/>\\+-sINTend textrol", max_size=30)), max_size=6))
def test_control_strings_cannot_be_forged(turns):
    out = chat.MarkedTemplate.render(turns)
    assert chat.MarkedTemplate.parse(out) == turns
    for s in ("<|start|>", "<|text|>", "<|end|>"):
        assert out.count(s) == len(turns)
    assert "[INST]" not in out and "</s>" not in out


def test_a_late_rewrite_of_an_early_turn_is_found():
    def blanking(turns):
        return chat.MarkedTemplate.render([(r, t if k != 1 or len(turns) <= 70 else "x" * len(t)) for k, (r, t) in enumerate(turns)])

    turns = [("user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(80)]
    assert chat.locate(blanking, turns).rewrites and not chat.locate(blanking, turns[:70]).rewrites
    assert not chat.locate(chat.MarkedTemplate.render, turns).rewrites


def test_results_do_not_turn_on_the_length_of_a_conversation():
    def blinking(turns):  # rewrites the second turn at one length only
        return chat.MarkedTemplate.render([(r, "x" * len(t) if k == 1 and len(turns) == 100 else t) for k, (r, t) in enumerate(turns)])

    turns = [("user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(140)]
    assert chat.locate(blinking, turns).rewrites and not chat.locate(blinking, turns[:99]).rewrites
    render = chat.MarkedTemplate.render
    assert chat.locate(render, turns, by_turn=True) == chat.locate(render, turns) and chat.locate(render, [], by_turn=True) == chat.locate(render, [])
    assert chat.turnwise(chat.MarkedTemplate) and not chat.turnwise(trimming()) and not chat.turnwise(Numbering)
    assert chat.locate(blinking, turns[:100], by_turn=True).rewrites  # a wrong declaration is found where the whole shows it
    spans = chat.locate(render, turns).spans
    assert all(chat.text_span(render, turns, k, spans[k], render(turns), 0) == chat.text_span(render, turns, k, spans[k], render(turns)) for k in (0, 1, 70, 139))


def test_chats_read_back(spark):
    r = random.Random(2)
    rows = []
    for c in range(40):
        for k in range(r.choice([1, 2, 5, 90])):
            rows.append((c, k, r.choice(["user", "assistant", "system", None]), r.choice([None, "", "</s>[INST] a\\b", "ü<|end|>" * 3, "plain " * 50]), "x"))
    rows += [(None, 0, "assistant", "lost", "x"), (3, None, "assistant", "early", "x"), (3, 0, "assistant", "tie b", "x"), (3, 0, "assistant", "tie a", "x"), rows[0], rows[0]]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(7)
    got = {x["conv_id"]: x for x in chat.digest_chats(chat.format_chats(df)).collect()}
    by = defaultdict(list)
    for c, k, role, text, _ in rows:
        by[c].append(((k is not None, k or 0), (role is not None, role or ""), (text is not None, text or "")))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns = [(role, text) for _, (_, role), (_, text) in sorted(turns)]
        loss = "".join(t for role, t in turns if role == "assistant")
        digest = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        x = got[c]
        assert (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert x["formatted_chars"] == len(chat.MarkedTemplate.render(turns)) and not x["rewrites_history"]
    assert chat.format_chats(df.limit(0)).count() == 0
    trimmed = chat.format_chats(df.where("conv_id = 3"), trimming()).collect()
    assert trimmed[0]["rewrites_history"] and trimmed[0]["loss_spans"] is None


PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abcdehinorst   ▁\n\té日.,019<>x0A", max_size=60)))
def test_pieces_equal_the_library(text):
    model = pieces.load(PATH)
    ids = LIBRARY.encode(text)
    assert model.encode(text) == ids and model.decode(ids) == LIBRARY.decode(ids)


def test_piece_digests(spark, monkeypatch):
    texts = ["Hello  world", None, "", " ", "▁▁a ▁b", "日本語 <s> \x00", "word " * 3000 + "x" * 5000, "same", "same"]
    df = frame(spark, texts)

    def want(t):
        ids = LIBRARY.encode(t or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()

    for r in pieces.piece_report(df, PATH).collect():
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want(texts[r["doc_id"]])
    monkeypatch.setattr(pieces, "BLOCK", 50)  # texts in parts
    model = pieces.PieceModel(PATH)
    assert model.digests([t or "" for t in texts]) == [want(t) for t in texts]
    assert all(model.encode(t or "") == LIBRARY.encode(t or "") for t in texts)
    assert {r["doc_id"]: len(r["ids"]) for r in pieces.encode_texts(df, PATH).collect()} == {i: want(t)[0] for i, t in enumerate(texts)}
    assert pieces.piece_report(df.limit(0), PATH).count() == 0


def test_small_tables_of_words_and_pairs(monkeypatch):
    monkeypatch.setattr(pieces, "WORDS", 3)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    model = pieces.PieceModel(PATH)
    text = "some words that come and some words that go " * 3
    assert model.encode(text) == LIBRARY.encode(text) and model.n_pairs <= 5
    monkeypatch.setattr(pieces, "BLOCK", 8)
    assert [n for n, _, _ in model.digests([text, "", text])] == [len(LIBRARY.encode(text)), 0, len(LIBRARY.encode(text))] and len(model.words) <= 6
