"""Registered queries that run a stream over the event table to its end."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from saleswell import config
from saleswell.operators import sessions
from saleswell.plans.registry import query
from saleswell.session import work_folder
from saleswell.streaming import jobs, late, stateful, timers, traffic

_KPI = """CAST(COUNT(*) FILTER (event_type = 'view') AS BIGINT) AS sessions, CAST(COUNT(*) FILTER (event_type = 'purchase') AS BIGINT) AS purchases,
    CAST(SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS revenue"""


def stream(f):
    cols = ("event_id", "ts", "user_id", "event_type", "value")
    return jobs.parquet_stream(f.spark, f"{f.folder}/events.parquet").select(*cols)


_DAYS = f"SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, {_KPI} FROM events GROUP BY 1, 2"


@query("stream_daily_kpi", _DAYS)
def stream_daily_kpi(f):
    return traffic.window_columns(jobs.once_complete(traffic.daily_kpi(stream(f)), "daily"))


@query("late_rewindow", f"SELECT * FROM ({_DAYS}) d WHERE window_end <= (SELECT max(ts) - INTERVAL 7 DAY FROM events)")
def late_rewindow(f):
    """Append mode: only days the seven-day watermark has closed."""
    return traffic.window_columns(jobs.once_appended(traffic.daily_kpi(stream(f)), "late"))


@query("stream_sliding_kpi", f"""SELECT w AS window_start, w + INTERVAL 7 DAY AS window_end, {_KPI} FROM (SELECT *, date_trunc('day', ts) - INTERVAL 1 DAY * unnest(range(7)) AS w FROM events) e GROUP BY 1, 2""")
def stream_sliding_kpi(f):
    # Windows are aligned to the epoch, so a day step starts at midnight.
    return traffic.window_columns(jobs.once_complete(traffic.sliding_kpi(stream(f)), "sliding"))


@query("session_kpi", f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g),
    a AS (SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, COUNT(*) AS events, {_KPI} FROM s GROUP BY user_id, sid)
    SELECT * FROM a WHERE window_end <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def session_kpi(f):
    """Append mode: sessions closed by the one-day watermark."""
    return traffic.window_columns(jobs.once_appended(traffic.session_kpi(stream(f)), "sessions"))


@query("session_blocks", f"""WITH e AS (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id) FROM events),
    g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM e),
    s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, COUNT(*) AS events, {_KPI} FROM s GROUP BY user_id, sid""")
def session_blocks(f):
    """All sessions by blocks of days; one user is made to hold a third of all events."""
    hot = f.events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")).cast("bigint"))
    out = sessions.sessions(hot, "user_id", "ts", "event_id", [F.count("*").alias("events"), *traffic._kpis()])
    return out.withColumn("revenue", F.col("revenue").cast("double"))


@query("late_rows", """WITH m AS (SELECT max(ts) - INTERVAL 7 DAY AS mark FROM events WHERE event_id % 5 <> 0),
    r AS (SELECT event_id, event_id % 5 = 0 AND ts < mark AS late FROM events, m)
    SELECT event_id, late, (SELECT CAST(COUNT(*) AS BIGINT) FROM r WHERE late) AS counted FROM r""")
def late_rows(f):
    """A fifth of the events arrives in a second batch: rows a week behind the first are counted and kept apart."""
    path = work_folder(f.spark, "late-rows")
    events = f.events.select("event_id", "ts")
    for second in (False, True):  # a file stream takes files in the order they appear
        events.where((F.col("event_id") % 5 == 0) == second).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = jobs.parquet_stream(f.spark, f"{path}/in", files_per_trigger=1)
    late.split_late(stream, "ts", dt.timedelta(days=7), f"{path}/out", f"{path}/ckpt")
    counted = late.marks(f.spark, f"{path}/out").agg(F.sum("late_rows")).first()[0]
    return late.read(f.spark, f"{path}/out").select("event_id", "late", F.lit(counted).cast("bigint").alias("counted"))


@query("queue_stream_timers", """WITH q AS (SELECT event_id, created_at AS born, event_id % 3 AS r, CASE event_id % 4 WHEN 0 THEN '3100' WHEN 1 THEN '500' WHEN 2 THEN '3140' END AS code FROM v_event WHERE status = 'committed' AND qb_status = 'pending'),
    w AS (SELECT max(born + CASE r WHEN 0 THEN 0 ELSE 1000 END) AS mark FROM q),
    s AS (SELECT event_id, r, born, mark, coalesce(code, 'UNKNOWN') AS code, r = 2 AND coalesce(code, '') NOT IN ({codes}) AS again FROM q, w)
    SELECT event_id, CASE WHEN r = 1 THEN 'applied' WHEN r = 0 THEN CASE WHEN born + 600000 < mark THEN 'pending' ELSE 'in_flight' END WHEN again THEN 'pending' ELSE 'error' END AS qb_status,
      CASE WHEN r = 2 THEN 1 ELSE 0 END AS retry_count, CASE WHEN r = 1 THEN 0 WHEN r = 0 THEN CASE WHEN born + 600000 < mark THEN born + 600000 ELSE 0 END WHEN again THEN born + 1000 + {wait} ELSE born + 1000 END AS retry_at,
      born + CASE r WHEN 0 THEN 0 ELSE 1000 END AS last_attempt_at, CASE WHEN r = 2 THEN code END AS error_code, CASE WHEN r = 1 THEN 'T' || CAST(event_id AS VARCHAR) END AS txn_id,
      CASE WHEN r = 0 THEN CASE WHEN born + 600000 < mark THEN 'released' ELSE 'mark' END WHEN again AND born + 1000 + {wait} < mark THEN 'ready' ELSE 'result' END AS what FROM s""".format(
        codes=", ".join(f"'{c}'" for c in sorted(config.NON_RETRYABLE_CODES)), wait=config.RETRY_DELAYS_SECONDS[0] * 1000))
def queue_stream_timers(f):
    """The queue's log as a stream: answers, releases after ten minutes without one, and retries that become due."""
    path = work_folder(f.spark, "queue-timers")
    e = f.event.where("status = 'committed' and qb_status = 'pending'")
    code = F.when(F.col("event_id") % 4 == 0, "3100").when(F.col("event_id") % 4 == 1, "500").when(F.col("event_id") % 4 == 2, "3140")
    none = F.lit(None).cast("string")
    log = lambda rows, seq, at, kind, ok, error, txn: rows.select("event_id", F.lit(seq).alias("seq"), at.alias("at_ms"), F.lit(kind).alias("kind"), ok.alias("success"), error.alias("error_code"), none.alias("error_message"), txn.alias("txn_id"), none.alias("txn_type"))
    third = F.col("event_id") % 3
    marks = log(e, 1, F.col("created_at"), "mark", F.lit(None).cast("boolean"), none, none)
    answers = log(e.where(third != 0), 2, F.col("created_at") + 1000, "result", third == 1, F.when(third == 2, code), F.when(third == 1, F.concat(F.lit("T"), F.col("event_id").cast("string"))))
    marks.unionByName(answers).write.parquet(f"{path}/in")
    stateful.use_rocksdb(f.spark)
    changes = jobs.once_appended(timers.queue_with_timers(jobs.parquet_stream(f.spark, f"{path}/in")), "queue-timers")
    return timers.latest(changes).select("event_id", "qb_status", "retry_count", "retry_at", "last_attempt_at", "error_code", "txn_id", "what")


@query("stream_dedup", "SELECT DISTINCT event_id - event_id % 2 AS transaction_key FROM events")
def stream_dedup(f):
    keyed = stream(f).withColumn("transaction_id", F.col("event_id") - F.col("event_id") % 2)
    unique = traffic.unique_orders(keyed).select(F.col("transaction_id").alias("transaction_key"))
    return jobs.once_appended(unique, "dedup")
