"""Pages by rank index, measured runs, action audit, mergeable distinct counts."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from saleswell.operators import paging, runs, sketches
from saleswell.sources import files


def test_every_page_of_a_rank_index(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, r.choice(["b", "A", "a", None, "c%d" % r.randrange(50)])) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, name string")
    table = str(tmp_path / "index")
    paging.build(df, [F.lower("name"), "name", F.desc("id")], table, rows_per_block=90)
    want = sorted(rows, key=lambda x: (x[1] is not None, (x[1] or "").lower(), x[1] or "", -x[0]))
    assert paging.total(spark, table) == 1000 and paging.pages(spark, table, 64) == 16
    for number in (1, 2, 7, 16):
        got = sorted((x["rank"], x["id"], x["name"]) for x in paging.page(spark, table, number, 64).collect())
        first = (number - 1) * 64
        assert got == [(first + k + 1, *x) for k, x in enumerate(want[first : first + 64])]
    assert paging.page(spark, table, 17, 64).count() == 0
    for bad in ((0, 5), (1, 0)):
        with pytest.raises(ValueError):
            paging.page(spark, table, *bad)


def test_a_deep_page_reads_its_blocks_only(spark, tmp_path):
    table = str(tmp_path / "index")
    paging.build(spark.range(20_000), ["id"], table, rows_per_block=500)
    deep = paging.page(spark, table, 1500, 10)
    scan = deep._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "_block" in scan.split("PartitionFilters")[1][:120]
    assert [x["id"] for x in deep.orderBy("rank").collect()] == list(range(14_990, 15_000))


def test_equal_and_few_rows_are_paged(spark, tmp_path):
    paging.build(spark.createDataFrame([("x",)] * 25, "k string"), ["k"], str(tmp_path / "same"), rows_per_block=4)
    assert sorted(r["rank"] for n in (1, 2, 3) for r in paging.page(spark, str(tmp_path / "same"), n, 10).collect()) == list(range(1, 26))
    paging.build(spark.createDataFrame([], "k string"), ["k"], str(tmp_path / "none"))
    assert paging.pages(spark, str(tmp_path / "none"), 10) == 0


def ticking():
    at = iter(range(100))
    return lambda: dt.datetime(2024, 1, 1, 0, 0, next(at))


def test_runs_are_logged_with_what_they_wrote(spark, tmp_path):
    log, now, day = str(tmp_path / "log"), ticking(), dt.date(2024, 1, 2)
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    out = runs.logged(df, lambda d: d.write.parquet(str(tmp_path / "t")), log, day, now, "q1", total=F.sum("v"), most=F.max("id"))
    assert out == {"row_count": 50, "total": 2450, "most": 49}

    def broken(d):
        d.write.mode("errorifexists").parquet(str(tmp_path / "t"))

    with pytest.raises(Exception, match="(?i)exist"):
        runs.logged(df, broken, log, day, now, "q2")
    got = {r["query_id"]: r for r in runs.read_log(spark, log).collect()}
    assert (got["q1"]["status"], got["q1"]["row_count"], got["q1"]["error"]) == ("success", 50, None)
    assert got["q2"]["status"] == "failed" and "exist" in got["q2"]["error"].lower() and got["q1"]["started_at"] < got["q1"]["finished_at"]


def test_actions_are_audited(spark, tmp_path):
    path, at = str(tmp_path / "audit"), iter(["2024-01-01T00:00:01", "2024-01-01T00:00:02"])
    assert runs.audited(spark, path, lambda: next(at), "purge", "pat", lambda: {"rows": 3}, "/purge", "POST") == {"rows": 3}
    with pytest.raises(ValueError):
        runs.audited(spark, path, lambda: next(at), "purge", "pat", lambda: (_ for _ in ()).throw(ValueError("no")))
    tail = files.read_audit_tail(spark.read.text(path), runs.AUDIT, "timestamp", 5).collect()
    assert [(r["outcome"], r["action"], json.loads(r["details"])) for r in tail] == [("error", "purge", {"error": "no"}), ("ok", "purge", {"rows": 3})]
    assert files.read_audit_tail(spark.read.text(path), runs.AUDIT, "timestamp", 0).count() == 0
    with pytest.raises(ValueError):
        files.read_audit_tail(spark.read.text(path), runs.AUDIT, "timestamp", -1)


def test_sketches_merge_over_any_range(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(20)]
    df = spark.range(60_000).select(F.element_at(F.array(*map(F.lit, days)), (F.col("id") % 20 + 1).cast("int")).alias("day"), (F.col("id") % 37_000).cast("string").alias("user"), (F.col("id") % 2).alias("shop"))
    by_day = sketches.daily(df, "day", "user", ["shop"])
    for a, b in ((0, 19), (3, 9), (5, 5)):
        exact = df.where(F.col("day").between(days[a], days[b])).select("user").distinct().count()
        got = sketches.distinct_between(by_day, "day", days[a], days[b]).first()["distinct"]
        assert abs(got - exact) <= max(1, sketches.error_bound() * exact)
    apart = {r["shop"]: r["distinct"] for r in sketches.distinct_between(by_day, "day", days[0], days[-1], ["shop"]).collect()}
    assert all(abs(n - 18_500) <= sketches.error_bound() * 18_500 for n in apart.values()) and len(apart) == 2


def test_a_long_rank_index_has_larger_blocks_not_more(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paging, "MOST_BLOCKS", 8, raising=False)
    table = str(tmp_path / "index")
    paging.build(spark.range(3_000), [F.desc("id")], table, rows_per_block=50)
    assert len([p for p in (tmp_path / "index" / "rows").iterdir() if p.name.startswith("_block=")]) <= 8
    got = [(r["rank"], r["id"]) for n in range(1, 32) for r in paging.page(spark, table, n, 97).orderBy("rank").collect()]
    assert got == [(k + 1, 2_999 - k) for k in range(3_000)]
