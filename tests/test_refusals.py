"""Batch refusals against a plain walk and against the streaming processor."""

import random

from pyspark.sql import functions as F

from saleswell.operators import refusals
from saleswell.streaming import jobs, stateful

REQUEST = "sku string, seq bigint, line_id string, mode string, qty double, new_qty double, location_id bigint, from_location_id bigint, to_location_id bigint"


def log(n, seed, transfers):
    r = random.Random(seed)
    out = []
    for seq in range(n):
        sku = "hot" if r.random() < 0.5 else f"s{r.randrange(6)}"
        mode = r.choice(["delta"] * 8 + ["set"] + (["transfer"] * 3 if transfers and sku != "s0" else []))
        a, b = r.sample(range(3), 2)
        qty = float(r.randint(1, 9)) if mode == "transfer" else float(r.choice([-7, -5, -3, -2, -1, 1, 2, 4]))
        new = float(r.choice([0, 3, 8, -2])) if mode == "set" else None
        out.append((sku, seq, f"l{seq}", mode, None if mode == "set" else qty, new, None if mode == "transfer" else a, a if mode == "transfer" else None, b if mode == "transfer" else None))
    return out


def walk(rows):
    held, out = {}, []
    for sku, seq, line, mode, qty, new, here, a, b in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        get = lambda p: held.get((sku, p), 0.0)
        moves = [(a, -qty), (b, qty)] if mode == "transfer" else [(here, new - get(here) if mode == "set" else qty)]
        fits = all(get(p) + d >= -1e-9 for p, d in moves)
        for p, d in moves:
            if fits:
                held[sku, p] = max(get(p) + d, 0.0)
            out.append((sku, seq, line, p, d, get(p), fits))
    return sorted(out)


def decided(spark, rows, block):
    df = spark.createDataFrame(rows, REQUEST).repartition(5)
    return sorted(tuple(r)[:7] for r in refusals.decide(df, block).collect())


def test_block_functions_equal_the_walk():
    r = random.Random(1)
    for _ in range(200):
        changes = [r.choice([-7, -4, -2, -1, 1, 3, 0.5, -0.5]) for _ in range(r.randint(1, 25))]
        pieces = refusals.SAME
        for d in changes:
            pieces = refusals.add_delta(pieces, d)
        assert [p[0] for p in pieces] == sorted({p[0] for p in pieces})
        for opening in [0, 0.25, 0.5, 1, 2, 3.5, 4, 5, 7, 11, 100]:
            balance = opening
            for d in changes:
                balance = refusals.after_delta(balance, d)[0]
            assert abs(refusals.apply(pieces, opening) - balance) < 1e-9


def test_decisions_of_single_locations(spark):
    rows = log(900, 3, transfers=False)
    want = walk(rows)
    for size in (7, 100, 10_000):
        assert decided(spark, rows, F.floor(F.col("seq") / size)) == want
    assert 0 < sum(not w[6] for w in want) < len(want)


def test_decisions_with_transfers_equal_the_stream(spark, tmp_path):
    rows = log(400, 4, transfers=True)
    got = decided(spark, rows, F.floor(F.col("seq") / 20))
    assert got == walk(rows)
    df = spark.createDataFrame(rows, REQUEST)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    try:
        streamed = jobs.once_appended(stateful.ledger_stream(jobs.parquet_stream(spark, f"{tmp_path}/in")), "refusals")
        assert sorted(tuple(r)[:7] for r in streamed.collect()) == got
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_lines_without_what_they_need_are_refused(spark):
    rows = [("a", 1, "x", "delta", 5.0, None, 1, None, None), ("a", 2, "y", "delta", None, None, 1, None, None), ("a", 3, "z", "set", 1.0, None, 1, None, None), ("a", 4, "w", "delta", -5.0, None, None, None, None),
            ("b", 1, "v", "transfer", 1.0, None, None, 1, None), ("a", 5, "u", "delta", -6.0, None, 1, None, None), ("a", 6, "t", "set", None, -1.0, 1, None, None), ("a", 7, "s", "delta", -5.0, None, 1, None, None)]
    out = refusals.decide(spark.createDataFrame(rows, REQUEST), F.col("seq"))
    got = {r["line_id"]: (r["on_hand"], r["accepted"], r["reason"]) for r in out.collect()}
    bad = (None, False, "invalid")
    assert got == {"x": (5, True, None), "y": bad, "z": bad, "w": bad, "v": bad, "u": (5, False, "below zero"), "t": (5, False, "below zero"), "s": (0, True, None)}
    assert [tuple(r) for r in refusals.closing(out).collect()] == [("a", 1, 0.0)]
    assert refusals.decide(spark.createDataFrame([], REQUEST), F.col("seq")).count() == 0


def test_hot_and_other_skus_decide_alike(spark):
    rows = log(400, 5, transfers=True)
    want = walk(rows)
    df = spark.createDataFrame(rows, REQUEST).repartition(5)
    block = F.floor(F.col("seq") / 9)
    for hot in (1, 60, refusals.HOT):  # every SKU without transfers in blocks, some of them, none
        assert sorted(tuple(r)[:7] for r in refusals.decide(df, block, hot=hot).collect()) == want
    # Rows without a SKU are kept; those without a place in the order are shown from an empty location, hot or not.
    odd = [(None, 1, "n", "delta", 2.0, None, 1, None, None), ("u", None, "a", "delta", 5.0, None, 1, None, None), ("u", 3, "b", "delta", -4.0, None, 1, None, None), ("u", None, "c", "set", None, 9.0, 2, None, None), ("u", 4, "d", "delta", 1.0, None, None, None, None)]
    frame = spark.createDataFrame(odd, REQUEST)
    spread, whole = (sorted(map(str, refusals.decide(frame, F.floor(F.col("seq") / 9), hot=h).collect())) for h in (1, 100))
    assert spread == whole and len(whole) == 5


def test_skus_are_told_apart_before_rows_are_joined(spark):
    rows = spark.createDataFrame(log(50, 6, transfers=True), REQUEST)
    times = rows.select("line_id", "seq")
    plan = refusals.decide(rows.drop("seq"), F.col("seq"), lambda part: part.join(times.hint("merge"), "line_id"))._jdf.queryExecution().optimizedPlan().toString()
    depth = lambda line: next(i for i, c in enumerate(line) if c.isalpha())
    joins = [(depth(line), line) for line in plan.splitlines() if "Join " in line]
    inner = [i for i, (_, line) in enumerate(joins) if "Join Inner" in line]
    assert len(inner) == 3  # for hot SKUs the functions of blocks and their rows, for others the rows
    assert all(("LeftSemi" in joins[i + 1][1] or "LeftAnti" in joins[i + 1][1]) and joins[i + 1][0] > joins[i][0] for i in inner)
