"""Manifest tables: what a change rewrites, who wins a race, what a failed change leaves."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from saleswell.operators import versions as vs

D = dt.date


def facts(spark, days, unit=1):
    return spark.createDataFrame([(d, f"s{i}", unit) for i, d in enumerate(days)], "day date, sku string, units int")


def rows(df):
    return sorted((str(r["day"]), r["sku"], r["units"]) for r in df.collect())


MARCH = [D(2024, 3, d) for d in range(1, 11)]


def test_a_window_rewrites_its_days_only(spark, tmp_path):
    table = str(tmp_path / "t")
    one = vs.create(facts(spark, MARCH + [None]), table, vs.by_date("day"))
    assert one.number == 1 and len(one.parts()) == 11 and vs.NONE in one.parts()
    two = vs.reload_window(table, facts(spark, [D(2024, 3, 4)], 7), D(2024, 3, 3), D(2024, 3, 5))
    kept = set(one.entries) & set(two.entries)
    assert {p for p, _ in kept} == one.parts() - {"2024-03-03", "2024-03-04", "2024-03-05"} and two.parts() == {p for p, _ in kept} | {"2024-03-04"}
    want = [r for r in rows(vs.read(spark, table, 1)) if r[0] not in ("2024-03-03", "2024-03-04", "2024-03-05")]
    assert rows(vs.read(spark, table)) == sorted(want + [("2024-03-04", "s0", 7)])
    assert len(rows(vs.read(spark, table, 1))) == 11


def test_months_keep_their_other_days_and_strays_are_added(spark, tmp_path):
    table = str(tmp_path / "t")
    vs.create(facts(spark, MARCH + [D(2024, 4, 1), D(2024, 5, 1)]), table, vs.by_date("day", "month"))
    after = vs.reload_window(table, facts(spark, [D(2024, 5, 9)], 9), D(2024, 3, 2), D(2024, 3, 9))
    assert [r[:1] for r in rows(vs.read(spark, table))] == [("2024-03-01",), ("2024-03-10",), ("2024-04-01",), ("2024-05-01",), ("2024-05-09",)]
    assert sorted(p for p, _ in after.entries) == ["2024-03", "2024-04", "2024-05", "2024-05"]
    assert rows(vs.read_window(spark, table, D(2024, 5, 1), D(2024, 5, 9))) == [("2024-05-01", "s11", 1), ("2024-05-09", "s0", 9)]
    assert vs.read_window(spark, table, D(2030, 1, 1), D(2030, 2, 1)).count() == 0


def test_a_window_read_opens_its_folders_only(spark, tmp_path):
    table = str(tmp_path / "t")
    vs.create(facts(spark, MARCH), table, vs.by_date("day"))
    opened = vs.read_window(spark, table, D(2024, 3, 4), D(2024, 3, 5)).inputFiles()
    assert len(opened) == 2 and all("_part=2024-03-0" in f for f in opened)


def test_of_two_writers_of_one_day_one_wins(spark, tmp_path):
    table = str(tmp_path / "t")
    base = vs.create(facts(spark, MARCH), table, vs.by_date("day"))
    vs.reload_window(table, facts(spark, [MARCH[0]], 2), MARCH[0], MARCH[0], base=base)
    with pytest.raises(vs.Conflict):
        vs.reload_window(table, facts(spark, [MARCH[0]], 3), MARCH[0], MARCH[0], base=base)
    assert ("2024-03-01", "s0", 2) in rows(vs.read(spark, table))
    # A writer of other days that began at the same version starts again from the winner's.
    third = vs.reload_window(table, facts(spark, [MARCH[5]], 4), MARCH[5], MARCH[5], base=base)
    assert third.number == 3 and {("2024-03-01", "s0", 2), ("2024-03-06", "s0", 4)} <= set(rows(vs.read(spark, table)))


def test_writers_at_once(spark, tmp_path):
    """Many claims of one number: exactly one holds; reloads of different days at once all arrive."""
    table = str(tmp_path / "t")
    base = vs.create(facts(spark, MARCH), table, vs.by_date("day"))
    won = []
    same = [threading.Thread(target=lambda: won.append(vs.claim(spark, vs.replace(base, number=2)))) for _ in range(12)]
    [t.start() for t in same]
    [t.join() for t in same]
    assert sorted(won) == [False] * 11 + [True]
    apart = [threading.Thread(target=lambda d=d: vs.reload_window(table, facts(spark, [d], 50), d, d, base=base)) for d in MARCH[:4]]
    [t.start() for t in apart]
    [t.join() for t in apart]
    assert vs.versions(spark, table) == [1, 2, 3, 4, 5, 6]
    assert [r[2] for r in rows(vs.read(spark, table))] == [50] * 4 + [1] * 6


def test_a_failed_check_leaves_nothing(spark, tmp_path):
    table = str(tmp_path / "t")
    vs.create(facts(spark, MARCH), table, vs.by_date("day"))
    runs = set((tmp_path / "t" / "data").iterdir())
    never = lambda df: df.agg((F.count("*") < 0).alias("passed")).withColumn("check_name", F.lit("never"))
    with pytest.raises(ValueError, match="never"):
        vs.reload_window(table, facts(spark, MARCH, 5), MARCH[0], MARCH[-1], checks=never)
    assert vs.versions(spark, table) == [1] and set((tmp_path / "t" / "data").iterdir()) == runs
    with pytest.raises(ValueError):
        vs.reload_window(table, facts(spark, MARCH), MARCH[1], MARCH[0])
    with pytest.raises(vs.Conflict):
        vs.create(facts(spark, MARCH), table, vs.by_date("day"))


def keyed(spark, pairs):
    return spark.createDataFrame([(k, v, n) for n, (k, v) in enumerate(pairs)], "sku string, cost double, n long")


def test_an_upsert_rewrites_its_buckets_only(spark, tmp_path):
    table = str(tmp_path / "t")
    one = vs.create(keyed(spark, [(f"k{i}", float(i)) for i in range(200)]).select("sku", "cost"), table, vs.by_bucket(["sku"], 16))
    two = vs.upsert_buckets(table, keyed(spark, [("k3", 1.0), (" k3 ", 2.0), ("new", 5.0), ("  ", 9.0)]), "n")
    changed = {p for p, _ in set(two.entries) - set(one.entries)}
    assert 1 <= len(changed) <= 2 and {e for e in one.entries if e[0] not in changed} == {e for e in two.entries if e[0] not in changed}
    got = {r["sku"]: r["cost"] for r in vs.read(spark, table).collect()}
    assert got == {**{f"k{i}": float(i) for i in range(200)}, "k3": 2.0, "new": 5.0}
    three = vs.reload_keys(table, keyed(spark, [("k7", 70.0), ("k7", 71.0)]).select("sku", "cost"))
    assert len(set(three.entries) - set(two.entries)) == 1
    assert sorted(r["cost"] for r in vs.read_keys(spark, table, keyed(spark, [("k7", 0.0)])).collect()) == [70.0, 71.0]
    assert vs.reload_keys(table, keyed(spark, []).select("sku", "cost")).entries == three.entries


def test_vacuum_keeps_what_kept_versions_name(spark, tmp_path):
    table = str(tmp_path / "t")
    vs.create(facts(spark, MARCH), table, vs.by_date("day"))
    for unit in (2, 3):
        vs.reload_window(table, facts(spark, MARCH[:2], unit), MARCH[0], MARCH[1])
    before = rows(vs.read(spark, table))
    gone = vs.vacuum(spark, table, keep=1)
    assert len(gone) == 4 and vs.versions(spark, table) == [3] and rows(vs.read(spark, table)) == before
