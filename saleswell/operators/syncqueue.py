"""Accounting sync queue: selection, state machine, releases, hydration, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from saleswell import config
from saleswell.operators.ordered import first_rows, spread_nulls


def next_pending(events: DataFrame, now_ms: int, limit: int | None = None) -> DataFrame:
    """Oldest eligible committed events, all of them without a limit.

    The commit filter comes before the limit, so a run of uncommitted events
    cannot hide an eligible one.
    """
    ready = events.where((F.col("qb_status") == "pending") & (F.col("retry_at") <= now_ms) & (F.col("status") == "committed"))
    return first_rows(ready, ["retry_at", "created_at", "event_id"], limit)


def retry_delay_ms(retry_count: Column) -> Column:
    ladder = F.array(*[F.lit(s * 1000) for s in config.RETRY_DELAYS_SECONDS])
    index = F.least(F.greatest(retry_count - 1, F.lit(0)), F.lit(len(config.RETRY_DELAYS_SECONDS) - 1))
    return F.get(ladder, index)


def is_retryable(code: Column) -> Column:
    return ~F.coalesce(code.isin(*config.NON_RETRYABLE_CODES), F.lit(False))


def apply_results(events: DataFrame, results: DataFrame) -> DataFrame:
    """Fold result rows into event states.

    ``results``: ``event_id, seq, at_ms, success, error_code, retryable`` and, optionally,
    ``txn_id, txn_type, error_message``; events keep what they knew of these.
    The state only depends on how many failures came in total, on the last
    result and on the last failure, so the fold is a plain aggregate that
    combines on the map side; no event's results are gathered in order.
    """
    fail = ~F.col("success")
    order = F.struct("at_ms", "seq")
    more = ("txn_id", "txn_type", "error_message")
    results = results.withColumns({c: F.lit(None).cast("string") for c in more if c not in results.columns})
    events = events.withColumns({c: F.lit(None).cast("string") for c in more if c not in events.columns})
    last = results.groupBy("event_id").agg(
        F.max_by(F.struct("txn_id"), F.when(F.col("success"), order)).alias("_ok"),
        F.max_by("txn_type", F.when(F.col("success") & F.col("txn_type").isNotNull(), order)).alias("_type"),
        F.count_if(fail).alias("_fails"),
        F.max_by(F.struct("success", "at_ms"), order).alias("_last"),
        F.max_by(F.struct("error_code", "error_message", "retryable", "at_ms"), F.when(fail, order)).alias("_fail"),
    )
    e = events.join(last, "event_id", "left")
    touched, ok = F.col("_last").isNotNull(), F.col("_last.success")
    count = F.col("retry_count") + F.coalesce("_fails", F.lit(0)).cast("int")
    again = F.coalesce("_fail.retryable", F.lit(True)) & is_retryable(F.col("_fail.error_code")) & (count < config.MAX_RETRIES)
    fail_at = F.col("_fail.at_ms")
    failed_any = F.col("_fail").isNotNull()
    return e.withColumns({
        "qb_status": F.when(~touched, F.col("qb_status")).when(ok, "applied").when(again, "pending").otherwise("error"),
        "error_code": F.when(~touched, F.col("error_code")).when(ok, None).otherwise(F.coalesce("_fail.error_code", F.lit("UNKNOWN"))),
        "retry_count": count,
        "retry_at": F.when(failed_any, fail_at + F.when(again, retry_delay_ms(count)).otherwise(0)).otherwise(F.col("retry_at")),
        "last_attempt_at": F.coalesce("_last.at_ms", "last_attempt_at"),
        "error_message": F.when(~touched, F.col("error_message")).when(ok, None).otherwise(F.coalesce("_fail.error_message", F.lit("sync failed"))),
        "txn_id": F.when(F.col("_ok").isNotNull(), F.col("_ok.txn_id")).otherwise(F.col("txn_id")),
        "txn_type": F.coalesce("_type", "txn_type"),
    }).drop("_fails", "_last", "_fail", "_ok", "_type")


def mark_in_flight(events: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hand events to a sync session: (events after, outcome per request, sessions).

    ``asked``: ``event_id, ticket, at_ms``.  A request needs a ticket and a committed event that
    is pending or already in flight.  The last request of a ticket names what its session works on.
    """
    known = events.select("event_id", F.col("status").alias("_status"), F.col("qb_status").alias("_queue"))
    outcome = (
        F.when(F.trim(F.coalesce("ticket", F.lit(""))) == "", "ticket required").when(F.col("_status").isNull(), "event not found")
        .when(F.col("_status") != "committed", "not committed").when(~F.coalesce(F.col("_queue").isin("pending", "in_flight"), F.lit(False)), "not eligible")
        .otherwise("marked")
    )
    result = asked.join(known, "event_id", "left").select("event_id", F.trim("ticket").alias("ticket"), "at_ms", outcome.alias("outcome"))
    marked = result.where("outcome = 'marked'")
    latest = marked.groupBy("event_id").agg(F.max("at_ms").alias("_at"))
    after = events.join(latest, "event_id", "left").withColumns({
        "qb_status": F.when(F.col("_at").isNotNull(), F.lit("in_flight")).otherwise(F.col("qb_status")),
        "last_attempt_at": F.coalesce("_at", "last_attempt_at"),
    }).drop("_at")
    sessions = marked.groupBy("ticket").agg(
        F.min("at_ms").alias("started_at"), F.max("at_ms").alias("last_seen_at"),
        F.max_by("event_id", F.struct("at_ms", "event_id")).alias("in_flight_event_id"),
    )
    return after, result, sessions


def release_stale(events: DataFrame, now_ms: int, older_than_ms: int = config.STALE_IN_FLIGHT_SECONDS * 1000) -> DataFrame:
    """In-flight events without an answer for too long go back to pending."""
    if older_than_ms < 0:
        raise ValueError(f"older_than_ms must not be negative: {older_than_ms}")
    stale = (F.col("qb_status") == "in_flight") & (F.coalesce("last_attempt_at", "created_at") <= now_ms - older_than_ms)
    return events.withColumns({
        "retry_at": F.when(stale, F.lit(now_ms)).otherwise(F.col("retry_at")),
        "qb_status": F.when(stale, F.lit("pending")).otherwise(F.col("qb_status")),
        "released": stale,
    })


def release_backoff(events: DataFrame, now_ms: int, created_by: str | None = None, error_code: str | None = None) -> DataFrame:
    """Pending events that wait for a retry may run at once."""
    hit = (F.col("qb_status") == "pending") & (F.col("status") == "committed") & (F.coalesce("retry_at", F.lit(0)) > now_ms)
    if created_by:
        hit = hit & (F.coalesce("created_by", F.lit("")) == created_by.strip())
    if error_code:
        hit = hit & (F.coalesce("error_code", F.lit("")) == error_code.strip())
    return events.withColumns({"retry_at": F.when(hit, F.lit(now_ms)).otherwise(F.col("retry_at")), "released": hit})


def retry_failed(events: DataFrame, asked: DataFrame, now_ms: int) -> DataFrame:
    """Manual retry; only errored events react."""
    hit = events.join(asked.select("event_id").distinct().withColumn("_ask", F.lit(True)), "event_id", "left")
    go = F.col("_ask").isNotNull() & (F.col("qb_status") == "error")
    return hit.withColumns({
        "error_code": F.when(go, None).otherwise(F.col("error_code")),
        "retry_at": F.when(go, F.lit(now_ms)).otherwise(F.col("retry_at")),
        "qb_status": F.when(go, F.lit("pending")).otherwise(F.col("qb_status")),
    }).drop("_ask")


def hydrate(events: DataFrame, lines: DataFrame, parts: DataFrame, locations: DataFrame, reasons: DataFrame) -> DataFrame:
    """Event lines with item, account and site names; one flat row per line.

    Dimensions join by equi keys and AQE broadcasts whichever is small enough.  Short names join first, while rows are
    narrow, and events last: grouping the result by event then needs no further shuffle.
    Nest with :func:`saleswell.operators.generators.nest_lines` only for the events about to be sent.
    """
    # Most lines have one of three locations and few have a reason: their NULL keys are spread.
    def named(df, side, key, kind, column, name):
        table = side.select(F.col(key.removeprefix("from_").removeprefix("to_")).cast(kind).alias("_key"), F.col(column).alias("_name"))
        joined = df.join(table, spread_nulls(F.col(key).cast(kind), kind, F.col("line_id")) == F.col("_key"), "left")
        return joined.withColumn(name, F.when(F.col(key).isNotNull(), F.col("_name"))).drop("_key", "_name")

    item = parts.select(
        "sku", F.col("item_full_name").alias("_item"), F.col("income_account").alias("_income"), "category",
        F.col("cogs_account").alias("_cogs"), F.col("asset_account").alias("_asset"), "description", "price", "cost",
        F.lit(True).alias("_part"),
    )
    rows = named(lines, reasons, "reason_code", "string", "account_full_name", "account_full_name")
    for role in ("location_id", "from_location_id", "to_location_id"):
        rows = named(rows, locations, role, "bigint", "site_name", role.replace("location_id", "site"))
    rows = rows.join(item, "sku", "left").join(events, "event_id")
    return (
        rows.select(
            "event_id", "line_id", "event_type", "effective_date", "created_by", "memo", "sku", "qty", "new_qty", "reason_code",
            F.coalesce("account_full_name", "_cogs").alias("account_full_name"),
            F.coalesce("_item", "sku").alias("item_full_name"),
            F.coalesce("_income", "category").alias("income_account"), F.col("_cogs").alias("cogs_account"),
            F.col("_asset").alias("asset_account"), F.col("description").alias("sales_description"),
            F.col("price").alias("sales_price"), F.col("cost").alias("purchase_cost"),
            F.col("site").alias("site_name"), F.col("from_site").alias("from_site_name"), F.col("to_site").alias("to_site_name"),
        )
    )


def queue_summary(events: DataFrame) -> DataFrame:
    """Event count per queue status, zero included."""
    counts = events.groupBy("qb_status").agg(F.count("*").alias("events"))
    statuses = F.explode(F.array(*map(F.lit, config.QUEUE_STATUSES))).alias("qb_status")
    all_statuses = events.sparkSession.range(1).select(statuses)
    return all_statuses.join(counts, "qb_status", "left").select("qb_status", F.coalesce("events", F.lit(0)).alias("events"))


def recent_events(events: DataFrame, lines: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest events with their line count; all events without a limit."""
    newest = first_rows(events, [F.desc("created_at"), "event_id"], limit)
    counts = lines.join(newest.select("event_id"), "event_id", "left_semi").groupBy("event_id").agg(F.count("*").alias("line_count"))
    return newest.join(counts, "event_id", "left").select(
        "event_id", "event_type", "status", "qb_status", "effective_date", "created_at", "created_by", "memo",
        F.coalesce("line_count", F.lit(0)).alias("line_count"),
    )


def events_by_author(events: DataFrame, author: str, statuses: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    if not author.strip():
        raise ValueError("author is required")
    known = [s.strip() for s in statuses if s.strip() in config.QUEUE_STATUSES]
    hit = events.where(F.coalesce("created_by", F.lit("")) == author.strip())
    if known:
        hit = hit.where(F.col("qb_status").isin(*known))
    return first_rows(hit, [F.desc("created_at"), "event_id"], limit).select(
        "event_id", "created_at", "created_by", "qb_status", "status", "memo"
    )


def zero_coverage(events: DataFrame, lines: DataFrame, author: str, effective_date=None) -> DataFrame:
    """``location_id, sku`` pairs an author has queued to zero (long form)."""
    hit = events.where(
        (F.col("event_type") == "adjustment") & (F.col("status") == "committed") & (F.coalesce("created_by", F.lit("")) == author)
    )
    if effective_date is not None:
        hit = hit.where(F.col("effective_date") == F.lit(effective_date))
    zero = lines.where((F.col("new_qty") == 0) & F.col("location_id").isNotNull() & (F.coalesce("sku", F.lit("")) != ""))
    return zero.join(hit.select("event_id"), "event_id", "left_semi").select("location_id", "sku").distinct()


def queue_coverage(pairs: DataFrame) -> DataFrame:
    """Number of distinct zero-set SKUs per location."""
    return pairs.groupBy("location_id").agg(F.count("*").alias("queued_sku_count"))


def duplicate_events(events: DataFrame) -> DataFrame:
    """Events of the same memo except the newest one.

    The newest is found by a combinable aggregate, so a memo shared by very
    many events is never gathered.
    """
    memo = F.coalesce("memo", F.lit(""))
    tagged = events.withColumn("_memo", memo)
    newest = tagged.groupBy("_memo").agg(F.max(F.struct("created_at", "event_id")).alias("_top"))
    return tagged.join(newest, "_memo").where(F.col("event_id") != F.col("_top.event_id")).drop("_memo", "_top")


def remap_requeue(events: DataFrame, lines: DataFrame, mapping: DataFrame, author: str, statuses: Sequence[str], now_ms: int):
    """Rename SKUs on an author's queued lines and requeue the touched events.

    Returns (lines after, events after, counts per rename).  ``mapping`` holds
    ``from_sku, to_sku``.
    """
    table = mapping.select(F.lower(F.trim("from_sku")).alias("_key"), F.trim("to_sku").alias("_to")).where("_key <> '' AND _to <> ''")
    chosen = events.where((F.coalesce("created_by", F.lit("")) == author) & F.col("qb_status").isin(*statuses)).select("event_id").withColumn("_in", F.lit(True))
    marked = lines.withColumn("_key", F.lower(F.trim("sku"))).join(table, "_key", "left").join(chosen, "event_id", "left")
    touched = F.col("_in").isNotNull() & F.col("_to").isNotNull() & (F.col("_to") != F.trim("sku"))
    marked = marked.withColumn("_touched", F.coalesce(touched, F.lit(False)))
    counts = marked.where("_touched").groupBy(F.trim("sku").alias("from_sku"), F.col("_to").alias("to_sku")).agg(F.count("*").alias("lines"))
    after = marked.withColumn("sku", F.when(F.col("_touched"), F.col("_to")).otherwise(F.col("sku"))).drop("_key", "_to", "_in", "_touched")
    hit = marked.where("_touched").select("event_id").distinct().withColumn("_hit", F.lit(True))
    e = events.join(hit, "event_id", "left")
    redo = F.col("_hit").isNotNull() & F.col("qb_status").isin("error", "in_flight")
    events_after = e.withColumns({
        "error_code": F.when(redo & (F.col("qb_status") == "error"), None).otherwise(F.col("error_code")),
        "retry_at": F.when(redo, F.lit(now_ms)).otherwise(F.col("retry_at")),
        "qb_status": F.when(redo, F.lit("pending")).otherwise(F.col("qb_status")),
    }).drop("_hit")
    return after, events_after, counts
