import datetime as dt
import hashlib
import uuid

from pyspark.sql import functions as F

from saleswell.functions import accounts, calendar, keys, numeric, text
from saleswell.operators.sku import classify_line
from saleswell.sources.files import flatten_headers, normalize_name


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_week_buckets_split_at_month_start_and_year(spark):
    days = [dt.date(2026, 1, 1), dt.date(2025, 12, 31), dt.date(2026, 2, 1), dt.date(2026, 1, 12)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select(calendar.bucket(F.col("d"), "week").alias("b")).collect()
    assert [r.b for r in rows] == [dt.date(2026, 1, 1), dt.date(2025, 12, 29), dt.date(2026, 2, 1), dt.date(2026, 1, 12)]
    ends = [one(spark, calendar.bucket_end(F.lit(b)))[0] for b in (dt.date(2025, 12, 29), dt.date(2026, 1, 1))]
    assert ends == [dt.date(2025, 12, 31), dt.date(2026, 1, 7)]


def test_named_ranges():
    d = dt.date(2026, 5, 20)
    assert calendar.range_bounds("last7", d) == (dt.date(2026, 5, 14), d)
    assert calendar.range_bounds("qtd", d)[0] == dt.date(2026, 4, 1)
    assert calendar.range_bounds("custom", d, (None, d)) == calendar.range_bounds("last30", d)
    first, last = calendar.month_spine_bounds(d)
    assert (last.year - first.year) * 12 + last.month - first.month + 1 == 14


def test_number_parsing(spark):
    p = lambda s, d=0.0: one(spark, numeric.parse_number(F.lit(s), d))[0]
    assert p("$1,234.50 ") == 1234.5 and p("") == 0.0 and p("abc") == 0.0 and p("inf") == 0.0 and p("(5)", None) is None
    assert one(spark, numeric.round_half_up(F.lit(1.005), 2))[0] == 1.01
    assert one(spark, numeric.ratio(F.lit(1), F.lit(0)))[0] is None
    assert [one(spark, numeric.number_text(F.lit(v)))[0] for v in (5.0, 2.50, 0.0)] == ["5", "2.5", "0"]
    assert one(spark, numeric.same_number(F.lit(1.0), F.lit(1.0000001)), numeric.same_number(F.lit(None).cast("double"), F.lit(1.0))) == (True, False)
    assert one(spark, numeric.parse_bool(F.lit(" Yes ")), numeric.parse_bool(F.lit("0")), numeric.parse_bool(F.lit("maybe"))) == (True, False, None)


def test_keys(spark):
    sku = keys.canonical_sku(F.lit(""), F.lit(" pot "), F.lit("x"))
    assert one(spark, sku, keys.leaf_key(F.lit("A:b C ")), keys.leaf_key(F.lit("plain"))) == ("POT", "b c", None)
    cand = keys.candidate_keys(F.lit("P:Leaf"), F.lit("S"))
    assert one(spark, cand)[0] == ["p:leaf", "leaf", "s"]
    assert keys.resolve_headers(["Item Full-Name", "Qty"], {"name": ["itemfullname"], "qty": ["quantity", "QTY"]}) == {"Item Full-Name": "name", "Qty": "qty"}


def test_text_repair_truncation_and_ids(spark):
    raw = "itâ€™s “ok” Â·\x07"
    assert one(spark, text.sanitize_text(F.lit(raw)))[0] == "it's \"ok\" ·"
    long = "Cost of goods sold for the northern site"
    want = long[:24] + "-" + hashlib.sha1(long.encode()).hexdigest()[:6].upper()
    assert one(spark, text.truncate_name(F.lit(long)), text.truncate_name(F.lit("x" * 31))) == (want, "x" * 31)
    for seed in ("a", "event|é|9", ""):
        assert one(spark, text.name_uuid(F.lit(seed)))[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, seed))


def test_dates(spark):
    p = lambda s: one(spark, text.parse_timestamp(F.lit(s)).cast("date"))[0]
    assert p("2025-01-03T10:00:00Z") == dt.date(2025, 1, 3) == p("03.01.2025") and p("soon") is None
    o = lambda s: one(spark, text.parse_ordinal_date(F.lit(s)))[0]
    assert o("5th Jan 2026") == o("5 January 2026") == dt.date(2026, 1, 5) and o("5th Foo 2026") is None


def test_account_paths(spark):
    path = accounts.canonical_path(F.lit("12100 Â· Inventory  Asset : R&D-6b1051 :: "))
    assert one(spark, path)[0] == ["inventory asset", "r and d"]
    arr = lambda *v: F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")
    m = lambda a, b, role, mode: one(spark, accounts.accounts_match(a, b, role, mode))[0]
    assert not m(arr("a"), arr("a", "b"), "income_account", "strict")
    assert m(arr("a"), arr("a", "b"), "income_account", "hierarchy")
    assert not m(arr(), arr("a"), "income_account", "hierarchy")
    assert m(arr("cogs", "x"), arr("cogs", "y"), "cogs_account", "hierarchy")
    assert m(arr("x", "inventory asset"), arr("inventory asset"), "asset_account", "normalized")
    assert not m(arr("a"), arr("a", "b"), "asset_account", "hierarchy")
    assert m(arr("a", "b", "c"), arr("a", "b", "d"), "income_account", "hierarchy")
    assert one(spark, accounts.path_prefixes(F.lit("a: b :c")), accounts.path_prefixes(F.lit(""))) == (["a", "a:b", "a:b:c"], [])


def test_missing_account_messages(spark):
    msg = 'There is an invalid reference to QuickBooks Cogs Account "COGS:Pots" in the Item Inventory. more "x"'
    assert one(spark, accounts.missing_account(F.lit(msg)), accounts.missing_account(F.lit("other"))) == ("COGS:Pots", "")
    kind = lambda m: one(spark, accounts.infer_account_type(F.lit(m), F.lit("Sales:Web"), F.lit(""), F.lit("")))[0]
    assert [kind(m) for m in ("sales", "COG X", "Fixed asset", "Other", "")] == ["Income", "CostOfGoodsSold", "OtherCurrentAsset", "Income", None]


def test_classification_order(spark):
    c = lambda n, s="www": one(spark, classify_line(F.lit(n), F.lit(s)))[0]
    assert [c("Pruning Workshop"), c("Workshop book"), c("Classic pot"), c("Class one"), c("Repotting service"), c("Pot", "POS"), c("Pot")] == [
        "Workshops", ".Com", ".Com", "Workshops", "Services", "Retail", ".Com"]


def test_header_flattening():
    assert normalize_name("  Net (USD)/unit ") == "net_usd_unit"
    assert flatten_headers(["Item", "", "Sales", ""], ["", "sku", "Units", " "]) == ["item", "item_sku", "sales_units", "col_3"]
