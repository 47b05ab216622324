"""Plans of laid-out tables, sessions of a hot user, skip rules, known items."""

import datetime as dt

from pyspark.sql import functions as F

from saleswell.operators import maintenance as mt, parity, quality, sessions


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = mt.write_bucketed(spark.range(500).withColumn("a", F.col("id") % 7), "bucket_left", str(tmp_path / "l"), ["id"], 4)
        right = mt.write_bucketed(spark.range(0, 900, 3).withColumn("b", F.col("id") % 5), "bucket_right", str(tmp_path / "r"), ["id"], 4)
        joined = left.join(right, "id")
        assert "Exchange" not in plan(joined) and joined.count() == 167
        assert "Exchange" in plan(spark.range(500).join(right, "id"))
        assert "Exchange" not in plan(left.groupBy("id").agg(F.sum("a")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
        spark.sql("DROP TABLE IF EXISTS bucket_left")
        spark.sql("DROP TABLE IF EXISTS bucket_right")


def test_a_small_dimension_prunes_date_folders(spark, tmp_path):
    days = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(30)]
    facts = spark.createDataFrame([(d, f"s{i}", i) for d in days for i in range(5)], "day date, sku string, units int")
    mt.write_fact(facts, str(tmp_path / "f"), "day", ["sku"])
    calendar = spark.createDataFrame([(d, "closing" if d.day % 10 == 0 else "open") for d in days], "day date, kind string")
    calendar.write.parquet(str(tmp_path / "c"))
    joined = spark.read.parquet(str(tmp_path / "f")).join(spark.read.parquet(str(tmp_path / "c")).where("kind = 'closing'"), "day")
    assert "dynamicpruning" in plan(joined).lower() and joined.count() == 15


def test_sessions_of_a_hot_user(spark):
    at = dt.datetime(2024, 1, 1, 23, 0)
    minutes = [0, 10, 39, 69, 100, 130, 131, 60 * 26]  # over midnight; 30 minutes exactly begins a new one
    rows = [("hot", at + dt.timedelta(minutes=m), i, 1) for i, m in enumerate(minutes)] + [("other", at, 90, 5), (None, at, 91, 2)]
    df = spark.createDataFrame(rows, "user string, ts timestamp_ntz, id long, v int")
    got = sessions.sessions(df, "user", "ts", "id", [F.count("*").alias("n"), F.sum("v").alias("v")])
    mine = sorted((r["session_start"], r["session_end"], r["n"]) for r in got.where("user = 'hot'").collect())
    minute = lambda m: at + dt.timedelta(minutes=m)
    assert mine == [(minute(0), minute(69), 3), (minute(69), minute(99), 1), (minute(100), minute(130), 1), (minute(130), minute(161), 2), (minute(60 * 26), minute(60 * 26 + 30), 1)]
    assert got.count() == 7 and got.where("user is null").first()["v"] == 2


def test_skip_rules_leave_every_row_on_one_side(spark):
    raw = spark.createDataFrame([("a", "1.5", None), (" ", " ", ""), (None, "2", "x"), ("b", "oops", None), ("c", "", None)], "sku string, price string, memo string")
    kept, left = quality.skip_rows(raw, "sku", ["price"])
    assert [tuple(r) for r in kept.collect()] == [("a", 1.5, None)]
    assert sorted(r["reason"] for r in left.collect()) == ["empty", "no key", "not a number", "not a number"]


def test_known_items_are_matched_by_distinct_pairs(spark):
    lines = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate([("Parts:a", "a"), ("Parts:a", "a"), (None, "b"), ("Gone:z", None), (None, None)])], "line_id int, item_full_name string, sku string")
    items = spark.createDataFrame([("Parts:a",), ("b",)], "item_full_name string")
    known, unknown = parity.known_item_lines(lines, items)
    assert sorted(r["line_id"] for r in known.collect()) == [0, 1, 2] and sorted(r["line_id"] for r in unknown.collect()) == [3, 4]


def test_files_buckets_and_paths_follow_the_rows(spark, monkeypatch):
    from saleswell.plans import queries_files
    from saleswell.plans.catalog import REGISTRY
    from saleswell.sources.sample import Feeds

    feeds = Feeds(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(queries_files, "ITEMS_PER_FILE", 25, raising=False)
    items = REGISTRY["item_xml_file"].build(feeds)
    assert items.count() == feeds.item.count() and len(items.inputFiles()) >= items.count() / 25
    whole = mt.bucket_count
    monkeypatch.setattr(mt, "bucket_count", lambda rows, least: whole(rows, 500, least))
    joined = REGISTRY["bucketed_join"].build(feeds)
    assert f"out of {-(-feeds.line.count() // 500)}" in joined._jdf.queryExecution().executedPlan().toString()
    # Six account paths, each cleaned once however often it is compared.
    plan = REGISTRY["account_match_modes"].build(feeds)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cog's") == 6
