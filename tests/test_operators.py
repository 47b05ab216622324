import datetime as dt

import threading

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from saleswell.operators import channels as ch, compare, generators as gen, ledger, maintenance as mt, parity, quality, sku, syncqueue as sq
from saleswell.operators.ordered import replay, row_numbers, running_sum, spread_nulls
from saleswell.operators.settlements import unparsable_rows, unpivot

D = dt.date
ORDERS = "order_id long, customer_id long, order_date date, status int, total decimal(18,2), sub_total decimal(18,2)"


def orders(spark, rows):
    from decimal import Decimal
    return spark.createDataFrame([(o, c, d, s, Decimal(t), Decimal(t)) for o, c, d, s, t in rows], ORDERS)


def test_new_customer_and_repeat_on_one_day(spark):
    o = orders(spark, [(1, 7, D(2026, 1, 5), 2, 10), (2, 7, D(2026, 1, 5), 2, 5), (3, 7, D(2026, 1, 7), 10, 1), (4, 8, D(2026, 1, 6), 4, 9)])
    row = ch.new_and_returning(o, "week").first()
    assert (row.storefront_new_customers, row.storefront_returning_customers) == (1, 1)
    assert ch.storefront_sales(o, "week").first().storefront_orders == 3


def test_wholesale_future_is_apart(spark):
    o = orders(spark, [(1, 1, D(2026, 1, 5), 2, 10), (2, 1, D(2026, 1, 5), 8, 20), (3, 1, D(2026, 1, 5), 5, 40), (4, 1, D(2026, 1, 5), 3, 80)])
    r = ch.wholesale_sales(o, "day").first()
    assert (r.wholesale_orders, float(r.wholesale_revenue), float(r.wholesale_future_revenue)) == (3, 10.0, 20.0)


def test_cost_modes_and_precedence(spark):
    from decimal import Decimal
    costs = spark.createDataFrame(
        [("abc", Decimal(2), D(2020, 1, 1), D(2020, 12, 31)), ("ABC", Decimal(3), D(2021, 1, 1), None), ("old", Decimal(9), D(2019, 1, 1), D(2019, 2, 1))],
        "msku string, cost_per_unit decimal(18,2), valid_from date, valid_to date")
    assert ch.cost_lookup(costs).where("cost_key = 'ABC'").count() == 2
    live = {r.cost_key: float(r.cost_per_unit) for r in ch.cost_lookup(costs, "latest_valid", D(2026, 1, 1)).collect()}
    assert live == {"ABC": 3.0}
    g = spark.createDataFrame([(Decimal(10), Decimal(4), Decimal(6), Decimal(3)), (Decimal(10), Decimal(4), Decimal(6), None)],
                              "base_cost decimal(38,2), qty_no_base decimal(12,0), qty decimal(12,0), cost_per_unit decimal(18,2)")
    out = [(float(r[0]), float(r[1])) for r in g.select(ch.cost_value(("line", "dimension")), ch.cost_value(("dimension", "line"))).collect()]
    assert out == [(22.0, 18.0), (10.0, 10.0)]


def mart(spark, days):
    return spark.createDataFrame([(d, float(i)) for i, d in enumerate(days)], "bucket_start date, v double")


def test_prior_year_latest_and_nearest(spark):
    target = D(2026, 3, 10) - dt.timedelta(days=364)
    m = mart(spark, [D(2026, 3, 10), target, target + dt.timedelta(days=3), target - dt.timedelta(days=4)])
    get = lambda **k: compare.prior_year(m, ["v"], **k).where(F.col("bucket_start") == D(2026, 3, 10)).first()
    assert get().prior_day == target + dt.timedelta(days=3)
    assert get(pick="nearest").prior_day == target and get(tolerance=0).prior_day == target
    lonely = compare.prior_year(mart(spark, [D(2026, 3, 10)]), ["v"]).first()
    assert lonely.prior_day is None and lonely.cur_v == 0.0


def test_prior_period_is_positional(spark):
    days = [D(2026, 1, 5), D(2026, 1, 12), D(2026, 2, 23), D(2026, 3, 2)]
    out = compare.prior_period(mart(spark, days), F.col("bucket_start") >= D(2026, 2, 1), ["v"]).orderBy("bucket_start").collect()
    assert [(r.bucket_start, r.prior_day) for r in out] == [(days[2], days[0]), (days[3], days[1])]


def test_trim_only_drops_the_running_week(spark):
    as_of = D(2026, 5, 20)
    m = mart(spark, [D(2026, 5, 11), D(2026, 5, 18)])
    assert compare.trim_incomplete_week(m, "ytd", as_of).count() == 1
    assert compare.trim_incomplete_week(m, "last30", as_of).count() == 2
    split = mart(spark, [D(2026, 6, 29), D(2026, 7, 1)])
    assert compare.trim_incomplete_week(split, "mtd", D(2026, 7, 2)).count() == 2


WIDE = [c for c in """settlement_id transaction_type order_id shipment_id posted_date sku quantity_purchased price_type price_amount item_fee_type
    item_fee_amount order_fee_type order_fee_amount shipment_fee_type shipment_fee_amount promotion_type promotion_amount other_reason other_fee_amount
    other_amount misc_fee_amount""".split()]


def wide(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c, "") for c in WIDE) for r in rows], ", ".join(f"{c} string" for c in WIDE))


def test_settlement_zero_rules(spark):
    w = wide(spark, {"quantity_purchased": "2"}, {"quantity_purchased": "0"}, {"quantity_purchased": "bad", "price_amount": "5"},
             {"quantity_purchased": "", "price_amount": "oops", "item_fee_amount": "-1", "shipment_fee_amount": "-2", "shipment_fee_type": "Ship"},
             {"quantity_purchased": "1", "price_type": "Shipping"})
    rows = {(r.quantity_purchased, r.amount_type, r.amount_description, float(r.amount)) for r in unpivot(w).collect()}
    assert rows == {(2, "Price", "Principal", 0.0), (0, "Fee", "Ship", -3.0)}
    assert unparsable_rows(w).count() == 1


AMOUNT = st.integers(-500, 500).map(lambda n: "" if n == 0 else f"{n / 100:.2f}")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.fixed_dictionaries({c: AMOUNT for c in ("price_amount", "item_fee_amount", "order_fee_amount", "promotion_amount", "other_amount")}), min_size=1, max_size=6))
def test_settlement_conserves_amounts(spark, rows):
    out = unpivot(wide(spark, *[{**r, "quantity_purchased": "1"} for r in rows])).agg(F.sum("amount")).first()[0]
    assert round(float(out or 0), 2) == round(sum(float(v or 0) for r in rows for v in r.values()), 2)


MOVE = st.tuples(st.sampled_from("ab"), st.integers(1, 2), st.one_of(st.none(), st.integers(0, 9)), st.integers(-5, 9))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(MOVE, min_size=1, max_size=25), st.integers(1, 6))
def test_replay_equals_sequential_fold(spark, moves, width):
    rows = [(s, l, i, float(d), None if v is None else float(v)) for i, (s, l, v, d) in enumerate(moves)]
    df = spark.createDataFrame(rows, "sku string, location_id long, seq long, delta double, set_to double")
    got = {r.seq: r.balance for r in replay(df, ["sku", "location_id"], "seq", F.floor(F.col("seq") / width)).collect()}
    now, want = {}, {}
    for s, l, i, d, v in rows:
        now[s, l] = v if v is not None else now.get((s, l), 0.0) + d
        want[i] = now[s, l]
    assert got == want


def test_blocked_order_on_one_hot_key(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("o"), F.lit(1.0).alias("v"))
    out = row_numbers(df, ["k"], ["o"], F.floor(F.col("o") / 37)).where("rn <> o + 1").count()
    assert out == 0
    assert running_sum(df, ["k"], ["o"], F.floor(F.col("o") / 37), "v", "s").where("s <> o + 1").count() == 0


LINES = "line_id string, event_id long, sku string, qty double, new_qty double, from_location_id long, to_location_id long, location_id long"


def test_ledger_transfer_void_and_zero_out(spark):
    lines = spark.createDataFrame([("1", 1, "s", 10.0, None, None, None, 1), ("2", 2, "s", 4.0, None, 1, 2, None), ("3", 3, "s", 0.0, 0.0, None, None, 1)], LINES)
    get = lambda ls: {r.location_id: r.on_hand for r in ledger.balances(ls).collect()}
    assert get(lines) == {1: 6.0, 2: 4.0}
    events = spark.createDataFrame([(1, "committed", "applied"), (2, "committed", "pending"), (3, "voided", "not_ready")], "event_id long, status string, qb_status string")
    undone, outcome = ledger.void_lines(events, lines, events.select("event_id"))
    assert {r.event_id: r.outcome for r in outcome.collect()} == {1: "refused", 2: "voided", 3: "unchanged"}
    assert get(lines.unionByName(undone.select(*lines.columns))) == {1: 10.0, 2: 0.0}


def test_queue_ladder_and_limits(spark):
    base = "event_id long, qb_status string, error_code string, retry_count int, retry_at long, last_attempt_at long"
    ev = spark.createDataFrame([(i, "in_flight", None, n, 0, 0) for i, n in enumerate((0, 1, 3, 8, 9, 0, 0, 0))], base)
    res = spark.createDataFrame(
        [(i, 1, 1000, False, "500", None) for i in range(5)] + [(5, 1, 1000, False, "3140", None), (6, 1, 1000, False, None, False), (7, 1, 1000, False, "500", None), (7, 2, 2000, True, None, None)],
        "event_id long, seq int, at_ms long, success boolean, error_code string, retryable boolean")
    out = {r.event_id: (r.qb_status, r.retry_count, r.retry_at, r.error_code) for r in sq.apply_results(ev, res).collect()}
    assert out[0] == ("pending", 1, 61_000, "500") and out[1] == ("pending", 2, 301_000, "500")
    assert out[2] == ("pending", 4, 3_601_000, "500") and out[3] == ("pending", 9, 3_601_000, "500")
    assert out[4] == ("error", 10, 1000, "500") and out[5][0] == "error" and out[6] == ("error", 1, 1000, "UNKNOWN")
    assert out[7] == ("applied", 1, 61_000, None)


def test_item_match_priority_and_parity(spark):
    parts = spark.createDataFrame([("s1", "Top:Leaf"), ("leaf", None), ("none", None)], "sku string, item_full_name string")
    items = spark.createDataFrame([("Other:leaf",), ("top:leaf",)], "item_full_name string")
    m = parity.match_items(parts, items)
    assert {r.sku: r.matched_name for r in m.collect()} == {"s1": "top:leaf", "leaf": "Other:leaf", "none": None}
    assert [r.sku for r in parity.missing_in_items(parts, m).collect()] == ["none"]


def test_window_reload_drops_days_the_new_file_lacks_and_is_idempotent(spark):
    row = lambda d, v: (D(2026, 1, d), v)
    old = spark.createDataFrame([row(1, "a"), row(2, "a"), row(3, "a")], "day date, v string")
    new = spark.createDataFrame([row(2, "b")], "day date, v string")
    once = mt.replace_window(old, new, "day", D(2026, 1, 2), D(2026, 1, 3))
    twice = mt.replace_window(once, new, "day", D(2026, 1, 2), D(2026, 1, 3))
    assert sorted(once.collect()) == sorted(twice.collect()) == [row(1, "a"), row(2, "b")]


def test_upsert_last_duplicate_wins_and_is_idempotent(spark):
    target = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "sku string, cost double")
    source = spark.createDataFrame([("a ", 5.0, 1), ("a", 6.0, 2), ("c", 7.0, 3), (" ", 9.0, 4)], "sku string, cost double, n int")
    once = mt.upsert(target, source, "sku", "n")
    assert {r.change: r.n for r in mt.upsert_counts(once).collect()} == {"updated": 1, "inserted": 1, "kept": 1}
    again = mt.upsert(once.drop("change"), source, "sku", "n").drop("change")
    assert sorted(again.collect()) == sorted(once.drop("change").collect()) == [("a", 6.0), ("b", 2.0), ("c", 7.0)]


def test_publish_keeps_old_version_on_failed_check(spark, tmp_path):
    table = str(tmp_path / "t")
    df = spark.range(3)
    mt.publish(df, table)
    with pytest.raises(ValueError, match="always"):
        mt.publish(spark.range(9), table, checks=lambda d: d.agg(F.lit("always").alias("check_name"), F.lit(False).alias("passed")))
    assert mt.publish(df.where("id < 0"), table) is None
    assert mt.read_table(spark, table).count() == 3


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(D(2026, 1, 1), "b", 1), (D(2026, 1, 2), "a", 2)], "day date, sku string, n int")
    mt.write_fact(rows, str(tmp_path / "f"), "day", ["sku"])
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.where("day = DATE '2026-01-02'").count() == 1
    mt.append_evolving(rows, str(tmp_path / "e"))
    mt.append_evolving(rows.withColumn("extra", F.lit(1)), str(tmp_path / "e"))
    assert mt.read_evolving(spark, str(tmp_path / "e")).where("extra IS NULL").count() == 2
    now = dt.datetime(2026, 1, 1)
    mt.log_run(spark, str(tmp_path / "l"), D(2026, 1, 1), "failed", 0, now, now, error="x" * 3000)
    assert len(spark.read.parquet(str(tmp_path / "l")).first().error) == 3000
    mt.export_report(rows.where("n > 5"), str(tmp_path / "c"), ["sku", "n"], single_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["sku", "n"]
    mt.land_raw(rows.select("day", "sku"), str(tmp_path / "b"), ["day"])
    assert spark.read.json(str(tmp_path / "b")).count() == 2


def test_guards(spark):
    with pytest.raises(ValueError):
        quality.require_rows(spark.range(3), 5, "items")
    with pytest.raises(ValueError):
        quality.require_columns(spark.range(1), ["x"])
    quality.require_below(3, 5, "x")


def test_render_rejects_mixed_sites_and_escapes(spark):
    cols = "event_id long, line_id string, event_type string, effective_date date, created_by string, memo string, sku string, qty double, new_qty double, account_full_name string, item_full_name string, site_name string, from_site_name string, to_site_name string"
    row = lambda e, l, site, new=None: (e, l, "adjustment", D(2026, 1, 1), "me", "a & b", "s", -2.5, new, None, "Café <1>", site, None, None)
    out = {r.event_id: r for r in gen.render_events(spark.createDataFrame([row(1, "1", "A"), row(1, "2", "A", 3.0), row(2, "1", "A"), row(2, "2", "B")], cols), "COGS:Deep:Path").collect()}
    assert out[2].reject_reason == "more than one site" and out[2].request_xml is None
    xml = out[1].request_xml
    assert "Caf&#233; &lt;1&gt;" in xml and "<QuantityDifference>-2.5</QuantityDifference>" in xml and "<NewQuantity>3</NewQuantity>" in xml
    assert "<AccountRef><FullName>COGS</FullName></AccountRef>" in xml and "a &amp; b" in xml


def test_large_events_render_in_parts(spark):
    rows = spark.range(7).select(
        F.lit(1).alias("event_id"), F.format_string("%03d", "id").alias("line_id"), F.lit("transfer").alias("event_type"), F.lit(D(2026, 1, 1)).alias("effective_date"),
        F.lit("me").alias("created_by"), F.lit(None).cast("string").alias("memo"), F.lit("s").alias("sku"), F.col("id").cast("double").alias("qty"),
        F.lit(None).cast("double").alias("new_qty"), F.lit(None).cast("string").alias("account_full_name"), F.lit("i").alias("item_full_name"),
        F.lit(None).cast("string").alias("site_name"), F.lit("A").alias("from_site_name"), F.lit("B").alias("to_site_name"))
    join = lambda n: "".join(r.request_xml for r in gen.render_events(rows, "x", lines_per_part=n).orderBy("part_no").collect())
    assert join(3) == join(None) and join(3).count("<TransferInventoryLineAdd>") == 7
    assert gen.nest_lines(rows, ["event_id"], 3).count() == 3
    assert [(r.part_no, len(r.lines)) for r in gen.nest_lines(rows, ["event_id"]).collect()] == [(1, 7)]
    assert gen.render_events(rows, "x").count() == 1 and not gen.render_events(rows, "x").first().memo_truncated
    long = gen.render_events(rows.withColumn("memo", F.lit("m" * 5000)), "x").first()
    assert long.memo_truncated


def test_hot_sku_keeps_totals(spark):
    """One SKU with most rows: set and delta changes in many blocks still fold exactly."""
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 500).cast("string"))).alias("sku"), F.lit(1).alias("location_id"),
        F.col("id").alias("seq"), F.lit(1.0).alias("delta"), F.when(F.col("id") == 9000, F.lit(5.0)).alias("set_to"))
    got = {r.sku: r.on_hand for r in ledger.final_balances(ledger.replay_requests(df, "seq", F.floor(F.col("seq") / 1000))).where("sku = 'hot'").collect()}
    assert got == {"hot": 5.0 + sum(1 for i in range(9001, 20000) if i % 3 == 0)}


def test_approval_gate(spark):
    r = spark.createDataFrame([(1, "1", "delta", 3.0), (1, "2", "delta", -25.0), (2, "1", "set", 1.0), (3, "1", "delta", 24.9)], "event_id long, line_id string, mode string, qty double")
    out = {x.event_id: (x.needs_approval, x.reason) for x in ledger.approval_gate(r).collect()}
    assert out[1] == (True, "line qty -25.0 exceeds threshold 25.0") and out[2][0] and out[3] == (False, None)


def test_limits_are_taken_as_given(spark):
    ev = spark.range(130).select(
        F.col("id").alias("event_id"), F.lit("pending").alias("qb_status"), F.lit("committed").alias("status"), F.lit(0).cast("long").alias("retry_at"),
        F.lit(0).cast("long").alias("created_at"), F.lit("me").alias("created_by"), F.lit("x").alias("memo"))
    assert sq.next_pending(ev, 5).count() == 130 and [r.event_id for r in sq.next_pending(ev, 5, 25).orderBy("event_id").collect()] == list(range(25))
    assert sq.events_by_author(ev, "me").count() == 130
    with pytest.raises(ValueError):
        sq.next_pending(ev, 5, 0)


def test_units_beyond_twelve_digits(spark):
    sales = spark.createDataFrame([("a", 2 * 10**12, None)], "sku string, quantity long, income decimal(38,2)")
    lookup = spark.sql("select 'a' as sku_key, cast(1.50 as decimal(18,2)) as unit_cost, 'c' as category_name")
    assert float(sku.margin_enrich(sales, lookup).first().cogs) == 3e12


def test_publish_is_atomic_and_refuses_lost_updates(spark, tmp_path):
    table = str(tmp_path / "t")
    first = mt.publish(spark.range(3), table)
    with pytest.raises(RuntimeError):
        mt.move_pointer(spark, table, None, "v=other")
    assert mt.current_version(spark, table) == first
    fail = lambda df: df.agg(F.lit(False).alias("passed")).withColumn("check_name", F.lit("never"))
    with pytest.raises(ValueError):
        mt.publish(spark.range(9), table, fail)
    assert mt.publish(spark.range(0), table) is None and mt.read_table(spark, table).count() == 3
    second = mt.publish(spark.range(5), table)
    left = {p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")}
    assert left == {first, second, "CURRENT"} and mt.read_table(spark, table).count() == 5
    assert mt.publish(spark.range(0), table, empty_input="keep") and mt.read_table(spark, table).count() == 0


def test_of_publishers_at_once_one_wins(spark, tmp_path):
    table = str(tmp_path / "t")
    first, won = mt.publish(spark.range(3), table), []

    def move(name):
        try:
            mt.move_pointer(spark, table, first, name)
            won.append(name)
        except RuntimeError:
            pass

    threads = [threading.Thread(target=move, args=(f"v={k}",)) for k in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and mt.current_version(spark, table) == won[0]


def test_null_keys_spread_and_never_match(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 3).alias("location_id"))
    keys = df.select(spread_nulls(F.col("location_id"), "bigint", F.col("id")).alias("k")).groupBy("k").count()
    assert keys.agg(F.max("count")).first()[0] < 200 and keys.count() > 1000


def test_mark_in_flight(spark):
    ev = spark.createDataFrame([(1, "committed", "pending", None), (2, "draft", "pending", None), (3, "committed", "applied", 7)], "event_id long, status string, qb_status string, last_attempt_at long")
    asked = spark.createDataFrame([(1, " t ", 5), (1, "t", 9), (2, "t", 6), (3, "t", 6), (4, "t", 6), (1, "", 20), (1, None, 21)], "event_id long, ticket string, at_ms long")
    after, outcome, sessions = sq.mark_in_flight(ev, asked)
    assert {r.event_id: (r.qb_status, r.last_attempt_at) for r in after.collect()} == {1: ("in_flight", 9), 2: ("pending", None), 3: ("applied", 7)}
    assert sorted(r.outcome for r in outcome.collect()) == ["event not found", "marked", "marked", "not committed", "not eligible", "ticket required", "ticket required"]
    assert [tuple(r) for r in sessions.collect()] == [("t", 5, 9, 1)]


def test_results_carry_transactions(spark):
    ev = spark.createDataFrame([(1, "in_flight", None, 0, 0, None)], "event_id long, qb_status string, error_code string, retry_count int, retry_at long, last_attempt_at long")
    res = spark.createDataFrame(
        [(1, 1, 10, True, None, None, "T1", "Adj", None), (1, 2, 20, True, None, None, "T2", None, None), (1, 3, 30, False, "500", None, None, None, "busy")],
        "event_id long, seq long, at_ms long, success boolean, error_code string, retryable boolean, txn_id string, txn_type string, error_message string")
    r = sq.apply_results(ev, res).first()
    assert (r.qb_status, r.txn_id, r.txn_type, r.error_message) == ("pending", "T2", "Adj", "busy")
    r = sq.apply_results(ev, res.where("seq < 3")).first()
    assert (r.qb_status, r.txn_id, r.txn_type, r.error_message) == ("applied", "T2", "Adj", None)


def test_missing_stock_is_never_sent(spark):
    miss = spark.createDataFrame([("a", "quantity", False), ("b", "quantity", False), ("c", "quantity", False)], "sku string, field string, is_match boolean")
    hand = spark.createDataFrame([("a", 4.0), ("b", -1.0)], "sku string, on_hand double")
    assert {r.sku: (r.new_qty, r.reject_reason) for r in gen.sync_lines(miss, ["quantity"], hand).collect()} == {
        "a": (4.0, None), "b": (None, "negative stock"), "c": (None, "missing stock")}


def test_category_movers_take_one_pass_and_no_broadcast(spark):
    cols = "category string, delta double"
    totals = lambda rows: spark.createDataFrame(rows, cols)
    got = lambda rows: sorted(map(tuple, sku.category_movers(totals(rows)).collect()))
    assert got([("b", 2.0), ("a", 2.0), ("c", 1.0), ("z", -3.0), ("y", -3.0), ("n", None), ("o", 0.0)]) == [("negative", "y", -3.0), ("positive", "a", 2.0)]
    assert got([("a", 1.0)]) == [("positive", "a", 1.0)] and got([]) == []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(sku.category_movers(totals([("a", 1.0), ("b", 2.0)]))).count("ExistingRDD") == 1
    sales = spark.createDataFrame([("current", "S", "1", "1")], "period string, sku string, revenue string, cogs string").selectExpr("period", "sku", "cast(revenue as decimal(18,2)) revenue", "1L units", "cast(cogs as decimal(18,2)) cogs")
    assert "Broadcast" not in plan(sku.category_totals(sales, spark.createDataFrame([("S", "c")], "sku string, category string")))


def test_lines_without_a_matched_item_stay_spread(spark):
    lines = spark.range(4_000).select(F.col("id").alias("event_id"), F.lit("1").alias("line_id"), F.concat(F.lit("s"), "id").alias("sku"), F.lit("me").alias("created_by"),
                                      *[F.lit("a").alias(c) for c in ("income_account", "cogs_account", "asset_account")])
    items = spark.createDataFrame([("s1", "L1", "E1", "x", "y", "z"), ("\x001", "L2", "E2", "x", "y", "z")], "item_full_name string, list_id string, edit_sequence string, income_account string, cogs_account string, asset_account string")
    matches = lines.select("sku", F.when(F.col("sku") == "s1", F.col("sku")).alias("matched_name"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = gen.item_modifications(lines, items, matches).select("sku", "list_id", "reject_reason", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {(r.list_id, r.reject_reason) for r in rows if r.sku == "s1"} == {("L1", None)}
    assert {(r.list_id, r.reject_reason) for r in rows if r.sku != "s1"} == {(None, "missing item detail")}
    assert len(rows) == 4_000 and max(sum(r.p == p for r in rows) for p in range(4)) < 2_000


def _exchanges(spark, make, what):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return make()._jdf.queryExecution().executedPlan().toString().count(f"Exchange hashpartitioning({what}")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_blocks_share_one_dealing_of_the_rows(spark):
    rows = [(k, o, 1.0) for k in ("a", None) for o in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, v double")
    made = lambda: running_sum(df, ["k"], ["o"], F.floor(F.col("o") / 37), "v", "s")
    assert _exchanges(spark, made, "") == 4  # the rows, their blocks' totals, those by key, the starts
    got = made()
    assert got.columns == ["k", "o", "v", "s"] and got.where("s <> o + 1").count() == 0 and got.count() == 400
    numbered = row_numbers(df, ["k"], ["o"], F.floor(F.col("o") / 37))
    assert numbered.where("rn <> o + 1").count() == 0 and numbered.count() == 400


def test_events_meet_their_lines_last(spark):
    from saleswell.operators import syncqueue as sq
    from saleswell.sources.sample import Feeds

    f = Feeds(spark, "/root/testdata/sf0.001")
    rows = sq.hydrate(f.event, f.event_line, f.part_master, f.location, f.reason)
    # One exchange of lines and one of events; nesting, item specs and requests need no other.
    for made in (lambda: gen.nest_lines(rows, ["event_id", "event_type", "effective_date"]), lambda: gen.missing_items(rows, {}), lambda: gen.render_events(rows, "COGS")):
        assert _exchanges(spark, made, "event_id") == 2


def test_requests_of_an_id_with_two_heads_have_all_lines(spark):
    cols = "event_id long, line_id string, event_type string, effective_date date, created_by string, memo string, sku string, qty double, new_qty double, account_full_name string, item_full_name string, site_name string, from_site_name string, to_site_name string"
    day = dt.date(2024, 1, 1)
    row = lambda e, line, memo: (e, line, "adjustment", day, "u", memo, "s", 1.0, None, "A", f"I{line}", "Site", None, None)
    out = gen.render_events(spark.createDataFrame([row(1, "1", "x"), row(1, "2", "y"), row(None, "1", "x")], cols), "COGS").collect()
    assert [r.event_id for r in out] == [1, 1] and all("I1" in r.request_xml and "I2" in r.request_xml for r in out)


def test_rows_without_a_block_count_but_get_no_value(spark):
    df = spark.createDataFrame([("a", None, 5.0), ("a", 1, 1.0), ("a", 40, 1.0), (None, 2, 1.0), (None, None, 7.0)], "k string, o int, v double")
    out = running_sum(df, ["k"], ["o"], F.floor(F.col("o") / 37), "v", "s")
    assert sorted((r.k or "", r.o, r.s) for r in out.collect()) == [("", 2, 8.0), ("a", 1, 6.0), ("a", 40, 7.0)]
    assert row_numbers(df, ["k"], ["o"], F.floor(F.col("o") / 37)).count() == 3


def test_sku_dimensions_are_joined_by_shuffle(spark):
    lines = spark.createDataFrame([("l1", 1, 10, 40, 2, 5), ("l2", 1, 10, 41, 1, 0)], "line_id string, order_id bigint, product_id bigint, variant_id bigint, quantity bigint, base_total int")
    lines = lines.withColumn("base_total", F.col("base_total").cast("decimal(18,2)"))
    orders = spark.createDataFrame([(1, dt.date(2000, 1, 1), 2)], "order_id bigint, order_date date, status int")
    products = spark.createDataFrame([(10, "TR-1", "Red", "B")], "product_id bigint, sku string, product_name string, brand string")
    variants = spark.createDataFrame([(40, 10, "TR-1-v1")], "variant_id bigint, product_id bigint, variant_sku string")
    refunds = spark.createDataFrame([(1, "l1", 1)], "order_id bigint, line_id string, quantity bigint").withColumn("requested_amount", F.lit(3).cast("decimal(18,2)"))
    since = dt.date(1999, 1, 1)
    frames = [
        sku.sku_lifetime(lines, orders, products, variants, since), sku.retail_sales(lines, orders, products, variants, since),
        sku.wholesale_sku_sales(lines, orders, products, variants, since), sku.refunds_by_sku(refunds, lines, orders, products, variants, since),
    ]
    for frame, rows in zip(frames, (2, 2, 2, 1)):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
        assert frame.count() == rows
