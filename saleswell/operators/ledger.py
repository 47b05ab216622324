"""Inventory ledger: balances, replay, voids, validation, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from saleswell import config
from saleswell.operators.ordered import replay, running_sum, spread_nulls

EPS = config.BALANCE_EPSILON
KEYS = ["sku", "location_id"]


def is_active(is_active: Column, status: Column) -> Column:
    """Explicit flag when set, otherwise the status text."""
    return F.coalesce(is_active, F.lower(status) == "active", F.lit(False))


def movements(lines: DataFrame) -> DataFrame:
    """Signed movements per location; a transfer line gives two."""
    out = F.struct(F.col("from_location_id").alias("location_id"), (-F.col("qty")).alias("delta"), F.lit(0).alias("leg"))
    into = F.struct(F.col("to_location_id").alias("location_id"), F.col("qty").alias("delta"), F.lit(1).alias("leg"))
    here = F.struct(F.col("location_id").alias("location_id"), F.col("qty").alias("delta"), F.lit(0).alias("leg"))
    legs = F.when(F.col("from_location_id").isNotNull(), F.array(out, into)).otherwise(F.array(here))
    return lines.withColumn("_leg", F.explode(legs)).drop("location_id", "from_location_id", "to_location_id").select("*", "_leg.*").drop("_leg")


def committed_lines(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Lines of committed events; a voided event's lines and their compensation cancel out and are both left out."""
    return lines.join(events.where("status = 'committed'").select("event_id"), "event_id", "left_semi")


def balances(lines: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """On-hand per SKU and location from the stored quantities of a log of lines that took effect.

    Stored quantities are already deltas (zero for clean-up events), so their
    order does not matter and the sum combines on the map side.
    """
    sums = movements(lines).where(F.col("location_id").isNotNull()).groupBy(*KEYS).agg(F.sum("delta").alias("on_hand"))
    tidy = F.when((F.col("on_hand") < 0) & (F.col("on_hand") >= -EPS), 0.0).otherwise(F.col("on_hand"))
    sums = sums.withColumn("on_hand", tidy)
    if reserved is None:
        return sums.withColumn("reserved", F.lit(0.0)).withColumn("available", F.col("on_hand"))
    held = reserved.groupBy(*KEYS).agg(F.sum("reserved").alias("reserved"))
    joined = sums.join(held, KEYS, "left").withColumn("reserved", F.coalesce("reserved", F.lit(0.0)))
    return joined.withColumn("available", F.col("on_hand") - F.col("reserved"))


def running_balance(lines: DataFrame, order: str, block: Column) -> DataFrame:
    """Balance after every movement; below-zero ones are flagged.  ``block`` never decreases along ``order`` (a day, say)."""
    moves = movements(lines).where(F.col("location_id").isNotNull())
    run = running_sum(moves, KEYS, [order, "line_id", "leg", "delta"], block, "delta", "balance")
    return run.withColumn("negative", F.col("balance") < -EPS)


def replay_requests(requests: DataFrame, order: str, block: Column) -> DataFrame:
    """Balances after each request when some add and some set the quantity."""
    return replay(requests, KEYS, order, block)


def final_balances(replayed: DataFrame, order: str = "seq") -> DataFrame:
    return replayed.groupBy(*KEYS).agg(F.max_by("balance", order).alias("on_hand"))


def void_lines(events: DataFrame, lines: DataFrame, to_void: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Void requests: compensating lines, and the outcome per requested event.

    Already voided events change nothing; events whose sync has started are refused.
    """
    asked = to_void.select("event_id").distinct()
    outcome = (
        F.when(F.col("status") == "voided", "unchanged")
        .when(F.col("qb_status").isin("in_flight", "applied"), "refused")
        .otherwise("voided")
    )
    result = events.join(asked, "event_id", "left_semi").select("event_id", outcome.alias("outcome"))
    undone = lines.join(result.where("outcome = 'voided'"), "event_id", "left_semi").withColumn("qty", -F.col("qty"))
    return undone, result


def voided_events(events: DataFrame, outcome: DataFrame) -> DataFrame:
    """Event headers after the void requests."""
    done = events.join(outcome.where("outcome = 'voided'").withColumn("_v", F.lit(True)), "event_id", "left")
    v = F.coalesce("_v", F.lit(False))
    return done.withColumns({
        "status": F.when(v, F.lit("voided")).otherwise(F.col("status")),
        "qb_status": F.when(v, F.lit("not_ready")).otherwise(F.col("qb_status")),
        "error_code": F.when(v, F.lit("VOIDED")).otherwise(F.col("error_code")),
        "retry_at": F.when(v, F.lit(0)).otherwise(F.col("retry_at")),
    }).drop("_v", "outcome")


# ------------------------------------------------------------------- validation
def validate_lines(requests: DataFrame, parts: DataFrame, locations: DataFrame) -> DataFrame:
    """Adds ``reject_reasons``; empty means the line may be applied.

    ``requests``: ``effective_date (text), mode, sku, qty, new_qty, location_id,
    from_location_id, to_location_id``.
    """
    known = parts.select(F.trim("sku").alias("_sku")).distinct().withColumn("_known", F.lit(True))
    r = requests.withColumn("sku", F.trim("sku")).join(known, F.col("sku") == F.col("_sku"), "left").drop("_sku")
    for role in ("location_id", "from_location_id", "to_location_id"):
        side = locations.select(F.col("location_id").cast("bigint").alias("_id"), F.col("active").alias(f"_act_{role}"))
        r = r.join(side, spread_nulls(F.col(role).cast("bigint"), "bigint", F.struct("sku", "qty", "new_qty")) == F.col("_id"), "left").drop("_id")
    transfer, delta, setting = F.col("mode") == "transfer", F.col("mode") == "delta", F.col("mode") == "set"
    infinite = lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    q, n = F.col("qty"), F.col("new_qty")
    dead = lambda role: F.col(role).isNull() | ~F.coalesce(F.col(f"_act_{role}"), F.lit(False))
    rules = {
        "bad_date": ~F.coalesce(F.col("effective_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)),
        "empty_sku": F.coalesce(F.col("sku"), F.lit("")) == "",
        "unknown_sku": F.col("_known").isNull() & (F.coalesce(F.col("sku"), F.lit("")) != ""),
        "qty_missing": (transfer | delta) & q.isNull(),
        "qty_not_finite": (transfer | delta) & F.coalesce(infinite(q), F.lit(False)),
        "qty_not_positive": transfer & (q <= 0),
        "same_location": transfer & F.col("from_location_id").eqNullSafe(F.col("to_location_id")),
        "qty_zero": delta & (F.abs(q) < EPS),
        "new_qty_missing": setting & n.isNull(),
        "new_qty_not_finite": setting & F.coalesce(infinite(n), F.lit(False)),
        "new_qty_negative": setting & (n < 0),
        "inactive_location": F.when(transfer, dead("from_location_id") | dead("to_location_id")).otherwise(dead("location_id")),
    }
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return r.withColumn("reject_reasons", reasons).drop("_known", "_act_location_id", "_act_from_location_id", "_act_to_location_id")


def approval_gate(requests: DataFrame, threshold: float = config.APPROVAL_THRESHOLD) -> DataFrame:
    """Per event: does it need approval, and why.

    Set-mode adjustments always do; otherwise the first line at or above the
    threshold gives the reason.
    """
    big = F.abs(F.coalesce("qty", F.lit(0.0))) >= F.lit(threshold)
    setting = F.col("mode") == "set"
    grouped = requests.groupBy("event_id").agg(
        F.bool_or(setting).alias("_set"), F.bool_or(big).alias("_big"),
        F.min_by(F.when(big, F.col("qty")), F.when(big, F.col("line_id"))).alias("_qty"),
    )
    reason = F.when(F.col("_set"), F.lit("set-mode adjustments require approval")).when(
        F.col("_big"),
        F.concat(F.lit("line qty "), F.format_string("%.1f", "_qty"), F.lit(f" exceeds threshold {float(threshold)}")),
    )
    return grouped.select("event_id", (F.col("_set") | F.col("_big")).alias("needs_approval"), reason.alias("reason"))


def approval_status(log: DataFrame) -> DataFrame:
    """Latest status per request of an append-only approval log."""
    return log.groupBy("request_id").agg(
        F.max_by("status", F.struct("ts", "step")).alias("status"), F.max("ts").alias("last_change"), F.count("*").alias("changes")
    )


# --------------------------------------------------------------------- listings
def onhand_totals(balance: DataFrame) -> DataFrame:
    return balance.where(F.coalesce("sku", F.lit("")) != "").groupBy("sku").agg(F.sum("on_hand").alias("on_hand"))


def requested_skus(requests: DataFrame) -> DataFrame:
    return requests.select(F.trim("sku").alias("sku")).where("sku <> ''").distinct()


def onhand_for(balance: DataFrame, requests: DataFrame, location_id: int | None = None) -> DataFrame:
    """On-hand of each requested SKU, zero when it has none."""
    if location_id is not None:
        balance = balance.where(F.col("location_id") == location_id)
    wanted = requested_skus(requests)
    return wanted.join(onhand_totals(balance), "sku", "left").select("sku", F.coalesce("on_hand", F.lit(0.0)).alias("on_hand"))


def search_parts(parts: DataFrame, text: str = "", include_inactive: bool = False) -> DataFrame:
    out = parts if include_inactive else parts.where(is_active(F.col("is_active"), F.col("active_status")))
    token = text.strip().lower()
    if token:
        out = out.where(F.contains(F.lower("sku"), F.lit(token)) | F.contains(F.lower("description"), F.lit(token)))
    return out


def income_account(account: Column, category: Column) -> Column:
    return F.when(F.trim(account) != "", account).otherwise(category)


def inventory_overview(parts: DataFrame, balance: DataFrame, location_id: int | None = None) -> DataFrame:
    if location_id is not None:
        balance = balance.where(F.col("location_id") == location_id)
    sums = balance.groupBy("sku").agg(*[F.sum(c).alias(c) for c in ("on_hand", "reserved", "available")])
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return parts.join(sums, "sku", "left").select(
        "sku", "description", income_account(F.col("income_account"), F.col("category")).alias("category"),
        "reorder_point", is_active(F.col("is_active"), F.col("active_status")).alias("active"),
        *[z(c).alias(c) for c in ("on_hand", "reserved", "available")],
        (z("available") <= F.col("reorder_point")).alias("low_stock"),
    )


def overview_cards(overview: DataFrame) -> DataFrame:
    return overview.agg(
        F.count("*").alias("skus"), F.sum("on_hand").alias("on_hand"), F.sum("available").alias("available"),
        F.count_if("low_stock").alias("low_stock"),
    )


def item_detail(lines: DataFrame, events: DataFrame, locations: DataFrame, items: DataFrame, limit: int | None = None) -> DataFrame:
    """Movement history of the requested SKUs with event and location names."""
    place = F.coalesce("location_id", "from_location_id", "to_location_id")
    rows = (
        lines.join(items.select("sku"), "sku", "left_semi")
        .withColumn("_place", place)
        .join(events.select("event_id", "event_type", "status", "qb_status", "created_at"), "event_id")
        .join(locations.select(F.col("location_id").alias("_place"), "code"), "_place", "left")
        .select("sku", "event_id", "line_id", "event_type", "status", "qb_status", "created_at", "qty", "new_qty",
                F.col("code").alias("location_code"))
    )
    if limit is None:
        return rows
    return rows.orderBy(F.desc("created_at"), "line_id").limit(limit)


def lookup_parts(parts: DataFrame, requests: DataFrame) -> DataFrame:
    """Opening quantity of the requested SKUs; unknown ones are left out."""
    return parts.join(requested_skus(requests), "sku").select("sku", "opening_qty")


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """One page of an ordered result: the top ``number * size`` rows, then the last slice.

    For deep pages write a rank index once (:mod:`saleswell.operators.paging`).
    """
    if number < 1 or size < 1:
        raise ValueError(f"page number and size start at 1: {number}, {size}")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
