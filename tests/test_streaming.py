import datetime as dt

from pyspark.sql import functions as F

from saleswell import config
from saleswell.operators import syncqueue as sq
from saleswell.streaming import jobs, late, stateful, timers
from test_sources import INVOICE

REQ = "sku string, seq long, line_id string, mode string, qty double, new_qty double, location_id long, from_location_id long, to_location_id long"


def test_ledger_stream_rejects_and_keeps_state(spark, tmp_path):
    stateful.use_rocksdb(spark)
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    put = lambda rows: spark.createDataFrame(rows, REQ).coalesce(1).write.mode("append").parquet(src)
    put([("a", 1, "1", "set", None, 10.0, 1, None, None), ("a", 2, "2", "transfer", 4.0, None, None, 1, 2), ("a", 3, "3", "delta", -9.0, None, 1, None, None)])
    run = lambda: jobs.run_append(stateful.ledger_stream(spark.readStream.schema(REQ).parquet(src)), out, ck)
    run()
    put([("a", 4, "4", "delta", -6.0, None, 1, None, None), ("b", 5, "5", "delta", -1.0, None, 1, None, None)])
    run()
    rows = spark.read.schema(stateful.LEDGER_OUTPUT).parquet(out).collect()
    assert {r.line_id: r.accepted for r in rows} == {"1": True, "2": True, "3": False, "4": True, "5": False}
    last = {(r.sku, r.location_id): r.on_hand for r in sorted(rows, key=lambda r: r.seq)}
    assert last == {("a", 1): 0.0, ("a", 2): 4.0, ("b", 1): 0.0}


def test_queue_stream_equals_batch(spark, tmp_path):
    stateful.use_rocksdb(spark)
    schema = "event_id long, seq long, at_ms long, success boolean, error_code string, retryable boolean"
    rows = [(e, s, s * 100, (e + s) % 4 == 0, "3140" if e == 2 else "500" if e else None, None) for e in range(4) for s in range(1, 5)]
    res = spark.createDataFrame(rows, schema)
    res.coalesce(1).write.parquet(str(tmp_path / "in"))
    jobs.run_append(stateful.queue_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    final = spark.read.schema(stateful.QUEUE_OUTPUT).parquet(str(tmp_path / "out")).groupBy("event_id").agg(F.max(F.struct("seq", "qb_status", "retry_count", "retry_at", "error_code")).alias("r"))
    got = {r.event_id: tuple(r.r)[1:] for r in final.collect()}
    ev = spark.range(4).select(F.col("id").alias("event_id"), F.lit("pending").alias("qb_status"), F.lit(None).cast("string").alias("error_code"),
                               F.lit(0).alias("retry_count"), F.lit(0).cast("long").alias("retry_at"), F.lit(None).cast("long").alias("last_attempt_at"))
    want = {r.event_id: (r.qb_status, r.retry_count, r.retry_at, r.error_code) for r in sq.apply_results(ev, res).collect()}
    assert got == want


def test_invoice_stream_and_snapshots(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text(INVOICE)
    p = lambda n: str(tmp_path / n)
    for _ in range(2):
        jobs.ingest_invoices(jobs.invoice_stream(spark, str(src)), p("h"), p("l"), p("ck"))
    assert spark.read.parquet(p("h")).count() == 2 and spark.read.parquet(p("l")).count() == 2
    schema = "event_id long, qb_status string"
    spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "error")], schema).write.parquet(p("q"))
    jobs.status_snapshots(spark.readStream.schema(schema).parquet(p("q")), p("snap"), p("ck2"), stamp=lambda: "t0")
    assert {(r.qb_status, r.events, r.taken_at) for r in spark.read.json(p("snap")).collect()} == {("pending", 2, "t0"), ("error", 1, "t0")}


def test_queue_timers_equal_the_batch_steps(spark, tmp_path):
    stateful.use_rocksdb(spark)
    schema = "event_id long, seq int, at_ms long, kind string, success boolean, error_code string, error_message string, txn_id string, txn_type string"
    minute, began, rows = 60_000, 10**9, []
    for e in range(9):
        rows.append((e, 1, began + e * minute, "mark", None, None, None, None, None))
        if e % 3:
            rows.append((e, 2, began + e * minute + 5, "result", e % 3 == 1, "3140" if e == 2 else "500", "m", "T" if e % 3 == 1 else None, None))
    rows.append((99, 1, began + 14 * minute, "mark", None, None, None, None, None))  # moves the watermark
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    changes = jobs.once_appended(timers.queue_with_timers(jobs.parquet_stream(spark, str(tmp_path / "in"))), "timers")
    got = {r["event_id"]: r for r in timers.latest(changes).collect()}
    start = spark.range(9).select(F.col("id").alias("event_id"), F.lit("committed").alias("status"), F.lit("pending").alias("qb_status"), F.lit(None).cast("string").alias("error_code"), F.lit(0).alias("retry_count"),
                                  F.lit(0).cast("long").alias("retry_at"), F.lit(0).cast("long").alias("created_at"), F.lit(None).cast("long").alias("last_attempt_at"))
    log = spark.createDataFrame(rows, schema).where("event_id < 9")
    marked, _, _ = sq.mark_in_flight(start, log.where("kind = 'mark'").select("event_id", F.lit("t").alias("ticket"), "at_ms"))
    results = log.where("kind = 'result'").select("event_id", "seq", "at_ms", "success", "error_code", F.lit(None).cast("boolean").alias("retryable"), "error_message", "txn_id", "txn_type")
    want = {r["event_id"]: r for r in sq.release_stale(sq.apply_results(marked, results), began + 14 * minute).collect()}
    for e in range(9):
        assert all(got[e][c] == want[e][c] for c in ("qb_status", "retry_count", "last_attempt_at", "error_code", "error_message", "txn_id")), e
        released = got[e]["last_attempt_at"] + timers.STALE_MS
        assert (got[e]["what"] == "released") == (want[e]["released"] and released < began + 14 * minute)
        assert got[e]["retry_at"] == (released if got[e]["what"] == "released" else want[e]["retry_at"])
    assert got[5]["what"] == "ready" and got[6]["qb_status"] == "in_flight" and got[99]["qb_status"] == "in_flight"


def test_neighbouring_events_share_a_group_and_keep_their_own_timers(spark, tmp_path):
    schema = "event_id long, seq int, at_ms long, kind string, success boolean, error_code string, error_message string, txn_id string, txn_type string"
    src, minute, t0, none = str(tmp_path / "in"), 60_000, 10**9, [None] * 5
    batches = [
        [(e, 1, t0 + k, "mark", *none) for k, e in enumerate((1, 2, 3, timers.BLOCK - 1, timers.BLOCK))],
        [(2, 2, t0 + 5 * minute, "result", True, None, None, "T2", None), (3, 2, t0 + 5 * minute, "result", False, "500", None, None, None)],
        [(1, 1, t0 + 60 * minute, "mark", *none)],
    ]
    for rows in batches:  # a file stream takes files in the order they appear
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    out = timers.queue_with_timers(jobs.parquet_stream(spark, src, files_per_trigger=1))
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2  # two blocks, not five events and their timers
    got = {}
    for r in spark.read.schema(timers.OUTPUT).parquet(str(tmp_path / "out")).orderBy("event_id", "step").collect():
        got.setdefault(r["event_id"], []).append((r["step"], r["what"], r["at_ms"]))
    released = lambda k: [(1, "mark", t0 + k), (2, "released", t0 + k + timers.STALE_MS)]
    retry = t0 + 5 * minute + config.RETRY_DELAYS_SECONDS[0] * 1000
    third = [(1, "mark", t0 + 2), (2, "result", t0 + 5 * minute)] + ([(3, "ready", retry)] if retry < t0 + 60 * minute else [])
    assert got[2] == [(1, "mark", t0 + 1), (2, "result", t0 + 5 * minute)] and got[3] == third
    assert got[timers.BLOCK - 1] == released(3) and got[timers.BLOCK] == released(4)
    assert got[1] == [(1, "mark", t0), (2, "mark", t0 + 60 * minute)]


def test_late_rows_are_counted_and_kept(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    day = lambda d: dt.datetime(2024, 1, d)
    put = lambda rows: spark.createDataFrame(rows, "id int, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(src)
    run = lambda: late.split_late(spark.readStream.schema("id int, ts timestamp_ntz").parquet(src), "ts", dt.timedelta(days=3), out, ck)
    put([(1, day(10)), (2, day(1)), (3, None)])
    run()
    put([(4, day(7)), (5, day(6)), (6, None), (7, day(20))])
    run()
    put([(8, day(16)), (9, day(17))])
    run()
    assert sorted(r["id"] for r in late.read(spark, out, True).collect()) == [5, 8] and late.read(spark, out).count() == 9
    got = [(r["batch_id"], r["rows"], r["late_rows"], r["watermark"]) for r in late.marks(spark, out).orderBy("batch_id").collect()]
    assert got == [(0, 3, 0, None), (1, 4, 1, day(7)), (2, 2, 1, day(17))]


def test_streams_read_a_file_or_a_folder_of_parts(spark, tmp_path):
    from conftest import SMALL
    from saleswell.streaming import traffic

    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    key = lambda df: sorted(map(str, df.collect()))
    one, many = (jobs.parquet_stream(spark, f"{d}/events.parquet", n) for d, n in ((SMALL, None), (tmp_path, 1)))
    kpi = [traffic.window_columns(jobs.once_complete(traffic.daily_kpi(s), "daily")) for s in (one, many)]
    assert key(kpi[0]) == key(kpi[1])
