"""Per-channel aggregates at day, week or month grain.

All return ``bucket_start, year`` plus their own metrics.  Distinct counts are
recomputed at each grain, never summed up from a finer one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from saleswell import config
from saleswell.functions.calendar import bucket
from saleswell.functions.keys import normalize_sku
from saleswell.functions.numeric import ratio

KEYS = ["bucket_start", "year"]


def with_bucket(df: DataFrame, day: str, grain: str) -> DataFrame:
    return df.withColumn("bucket_start", bucket(F.col(day), grain)).withColumn("year", F.year(day))


def between_days(df: DataFrame, day: str, start: dt.date | None, end: dt.date | None = None) -> DataFrame:
    """Filter on the raw date column so partitions and row groups are pruned."""
    if start is not None:
        df = df.where(F.col(day) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(day) <= F.lit(end))
    return df


# --- storefront ---------------------------------------------------------------
def storefront_sales(
    orders: DataFrame, grain: str, start=None, statuses: Sequence[int] = config.STOREFRONT_REALISED, end=None
) -> DataFrame:
    """Orders, revenue, average order and customers.

    Rows are reduced per customer first, so the two distinct counts need no expanded copy of the input.
    """
    kept = between_days(orders.where(F.col("status").isin(*statuses)), "order_date", start, end)
    per_customer = with_bucket(kept, "order_date", grain).groupBy(*KEYS, "customer_id").agg(
        F.countDistinct("order_id").alias("_orders"), F.sum("total").alias("_total"), F.count("total").alias("_n")
    )
    sums = per_customer.groupBy(*KEYS).agg(
        F.sum("_orders").alias("storefront_orders"),
        F.sum("_total").alias("storefront_revenue"),
        F.sum("_n").alias("_n"),
        F.count("customer_id").alias("storefront_customers"),
    )
    return sums.withColumn("storefront_aov", ratio(F.col("storefront_revenue"), F.col("_n"))).drop("_n")


def new_and_returning(
    orders: DataFrame, grain: str, start=None, statuses: Sequence[int] = config.STOREFRONT_REALISED, end=None
) -> DataFrame:
    """Distinct customers buying on, or after, their first-ever order day.

    Orders collapse to customer-days before anything is grouped by customer, so
    one customer's rows are bounded by the calendar however many orders they have.
    """
    days = orders.where(F.col("status").isin(*statuses)).select("customer_id", "order_date").distinct()
    first = F.min("order_date").over(Window.partitionBy("customer_id"))
    flagged = between_days(between_days(days, "order_date", None, end).withColumn("first_day", first), "order_date", start)
    per_customer = with_bucket(flagged, "order_date", grain).groupBy(*KEYS, "customer_id").agg(
        F.max((F.col("order_date") == F.col("first_day")).cast("int")).alias("is_new"),
        F.max((F.col("order_date") > F.col("first_day")).cast("int")).alias("is_back"),
    )
    known = F.col("customer_id").isNotNull()
    return per_customer.groupBy(*KEYS).agg(
        F.sum(F.when(known, F.col("is_new")).otherwise(0)).alias("storefront_new_customers"),
        F.sum(F.when(known, F.col("is_back")).otherwise(0)).alias("storefront_returning_customers"),
    )


# --- marketplace ----------------------------------------------------------------
def marketplace_sales(sku_day: DataFrame, grain: str, start=None, end=None) -> DataFrame:
    kept = between_days(sku_day, "business_date", start, end)
    return with_bucket(kept, "business_date", grain).groupBy(*KEYS).agg(
        F.sum("gross_sales").alias("marketplace_revenue"),
        F.sum("units").alias("marketplace_units"),
        F.sum("net_proceeds").alias("marketplace_net_proceeds"),
        F.sum("ad_spend").alias("marketplace_ad_spend"),
    )


def marketplace_pl(sku_day: DataFrame, grain: str = "month", start=None, end=None) -> DataFrame:
    """Signed P&L sums: refunds and fees are stored negative and later added."""
    kept = between_days(sku_day, "business_date", start, end)
    return with_bucket(kept, "business_date", grain).groupBy(*KEYS).agg(
        F.sum("gross_sales").alias("marketplace_gross_sales"),
        F.sum("refunds").alias("marketplace_returns"),
        F.sum("net_sales").alias("marketplace_net_sales"),
        F.sum("fees").alias("marketplace_fees"),
        F.sum("ad_spend").alias("marketplace_ad_spend"),
        F.sum("net_proceeds").alias("marketplace_net_proceeds"),
        F.sum("units").alias("marketplace_units"),
    )


def marketplace_traffic(traffic: DataFrame, grain: str, start=None, end=None) -> DataFrame:
    kept = between_days(traffic, "report_date", start, end)
    return with_bucket(kept, "report_date", grain).groupBy(*KEYS).agg(
        F.sum("sessions").alias("marketplace_sessions")
    )


def settlement_orders(settlements: DataFrame, grain: str, start=None, end=None) -> DataFrame:
    """Orders with a settled component, from order days (or the unpivoted components)."""
    kept = between_days(settlements.where(F.col("posted_date").isNotNull()), "posted_date", start, end)
    return with_bucket(kept, "posted_date", grain).groupBy(*KEYS).agg(
        F.countDistinct("order_id").alias("marketplace_orders")
    )


# --- wholesale ------------------------------------------------------------------
def wholesale_sales(orders: DataFrame, grain: str, start=None, end=None) -> DataFrame:
    kept = between_days(orders.where(~F.col("status").isin(*config.WHOLESALE_EXCLUDED)), "order_date", start, end)
    amount = lambda statuses: F.sum(
        F.when(F.col("status").isin(*statuses), F.col("sub_total")).otherwise(F.lit(0).cast("decimal(18,2)"))
    )
    return with_bucket(kept, "order_date", grain).groupBy(*KEYS).agg(
        F.countDistinct("order_id").alias("wholesale_orders"),
        amount(config.WHOLESALE_REALISED).alias("wholesale_revenue"),
        amount(config.WHOLESALE_FUTURE).alias("wholesale_future_revenue"),
    )


# --- web and ads ----------------------------------------------------------------
def is_organic() -> Column:
    group = F.col("session_source.cross_channel_campaign.primary_channel_group")
    medium = F.lower(F.col("traffic_source.medium"))
    return F.coalesce(group.isin(*config.ORGANIC_GROUPS), F.lit(False)) | F.coalesce(
        medium == "organic", F.lit(False)
    )


def web_traffic_live(events: DataFrame, grain: str, first_shard: str | None = None, last_shard: str | None = None) -> DataFrame:
    """Sessions, users and their organic parts from the sharded event table.

    Rows are first reduced per bucket and user (and per bucket and transaction),
    which replaces several distinct counts over an expanded input.
    """
    if first_shard:
        events = events.where(F.col("event_date") >= first_shard)
    if last_shard:
        events = events.where(F.col("event_date") <= last_shard)
    e = events.withColumn("day", F.to_date("event_date", "yyyyMMdd")).withColumn("organic", is_organic())
    e = with_bucket(e, "day", grain)
    session, purchase = F.col("event_name") == config.SESSION_EVENT, F.col("event_name") == config.PURCHASE_EVENT
    zero = F.lit(0).cast("decimal(18,2)")
    per_user = e.groupBy(*KEYS, "user_pseudo_id").agg(
        F.count_if(session).alias("sessions"),
        F.count_if(session & F.col("organic")).alias("organic_sessions"),
        F.max(F.col("organic").cast("int")).alias("organic_user"),
        F.sum(
            F.when(purchase & F.col("organic"), F.coalesce("ecommerce.purchase_revenue", zero)).otherwise(zero)
        ).alias("organic_revenue"),
    )
    known = F.col("user_pseudo_id").isNotNull()
    people = per_user.groupBy(*KEYS).agg(
        F.sum("sessions").alias("sessions"),
        F.count("user_pseudo_id").alias("users"),
        F.sum("organic_sessions").alias("organic_sessions"),
        F.sum(F.when(known, F.col("organic_user")).otherwise(0)).alias("organic_users"),
        F.sum("organic_revenue").alias("organic_revenue"),
    )
    sales = (
        e.where(purchase & F.col("organic"))
        .groupBy(*KEYS)
        .agg(F.countDistinct("ecommerce.transaction_id").alias("organic_orders"))
    )
    return combine([people, sales])


def web_traffic(
    events: DataFrame, backfill: DataFrame, grain: str, first_shard: str | None = None, mode: str = "additive", start=None, end=None
) -> DataFrame:
    """Live traffic plus the historical summary; ``start`` and ``end`` bound both by day.

    ``additive`` adds both even where they overlap; ``prefer_live`` uses the
    summary only for days without live events.
    """
    shard = lambda day: day.strftime("%Y%m%d") if day else None
    first_shard = max(filter(None, (first_shard, shard(start))), default=None)
    backfill = between_days(backfill, "day", start, end)
    live = web_traffic_live(events, grain, first_shard, shard(end))
    if mode == "prefer_live":
        shards = events.where(F.col("event_date") >= first_shard) if first_shard else events
        days = shards.select(F.to_date("event_date", "yyyyMMdd").alias("day")).distinct()
        backfill = backfill.join(days, "day", "left_anti")
    elif mode != "additive":
        raise ValueError(f"mode must be additive or prefer_live: {mode!r}")
    past = with_bucket(backfill, "day", grain).groupBy(*KEYS).agg(
        F.sum("sessions").alias("sessions"), F.sum("users").alias("users")
    )
    both = live.unionByName(past, allowMissingColumns=True)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return both.groupBy(*KEYS).agg(
        *[
            total(c)
            for c in ("sessions", "users", "organic_sessions", "organic_users", "organic_revenue", "organic_orders")
        ]
    )


def ads_cost(shards: DataFrame, grain: str, start=None, end=None) -> DataFrame:
    """Cost arrives in millionths; summed as decimal so the total cannot wrap."""
    kept = between_days(shards, "segments_date", start, end)
    micros = F.sum(F.col("cost_micros").cast("decimal(20,0)"))
    return with_bucket(kept, "segments_date", grain).groupBy(*KEYS).agg(
        F.round(micros / F.lit(1_000_000).cast("decimal(7,0)"), 2).alias("search_ad_spend")
    )


# --- cost of goods --------------------------------------------------------------
def cost_lookup(
    costs: DataFrame, mode: str = "raw", as_of: dt.date | None = None, case: str = "upper", trim: bool = False
) -> DataFrame:
    """``cost_key, cost_per_unit``.

    ``raw`` keeps every row of the dimension, so a SKU listed twice counts twice;
    ``latest_valid`` keeps the newest row still valid at ``as_of``.
    """
    key = normalize_sku(F.col("msku"), case, trim)
    if mode == "raw":
        return costs.select(key.alias("cost_key"), "cost_per_unit").where(F.col("cost_key").isNotNull())
    if mode != "latest_valid":
        raise ValueError(f"mode must be raw or latest_valid: {mode!r}")
    live = costs.where(F.col("valid_to").isNull() | (F.col("valid_to") >= F.lit(as_of)))
    newest = F.max(F.struct("valid_from", "cost_per_unit"))
    return (
        live.groupBy(key.alias("cost_key"))
        .agg(newest.alias("_top"))
        .select("cost_key", F.col("_top.cost_per_unit").alias("cost_per_unit"))
    )


def line_cost_parts() -> list[Column]:
    """Aggregates that let the cost dimension be joined after grouping by product."""
    qty = F.col("quantity").cast("decimal(20,0)")
    has_base = F.coalesce(F.col("base_cost_price") > 0, F.lit(False))
    none = F.lit(0).cast("decimal(20,0)")
    return [
        F.sum(F.when(has_base, F.col("base_cost_price") * qty)).alias("base_cost"),
        F.sum(F.when(has_base, none).otherwise(qty)).alias("qty_no_base"),
        F.sum(qty).alias("qty"),
    ]


def cost_value(precedence: Sequence[str]) -> Column:
    """Cost of a pre-aggregated group under a precedence of line and dimension cost."""
    base = F.coalesce(F.col("base_cost"), F.lit(0).cast("decimal(38,2)"))
    dim = F.col("cost_per_unit")
    if tuple(precedence) == ("line", "dimension"):
        return base + F.coalesce(dim * F.col("qty_no_base"), F.lit(0).cast("decimal(38,2)"))
    if tuple(precedence) == ("dimension", "line"):
        return F.when(dim.isNotNull(), dim * F.col("qty")).otherwise(base)
    raise ValueError(f"unknown cost precedence: {precedence!r}")


def order_cogs(
    lines: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    costs: DataFrame,
    channel: str,
    grain: str,
    start=None,
    cost_mode: str = "raw",
    as_of: dt.date | None = None,
    end=None,
) -> DataFrame:
    """COGS of an order channel.

    The storefront drops lines without a product and prefers the line's own
    cost; wholesale keeps them, prefers the dimension and also counts orders
    whose revenue is still in the future.
    """
    if channel == "storefront":
        kept, how = orders.where(F.col("status").isin(*config.STOREFRONT_REALISED)), "inner"
    else:
        kept, how = orders.where(~F.col("status").isin(*config.WHOLESALE_EXCLUDED)), "left"
    kept = with_bucket(between_days(kept, "order_date", start, end), "order_date", grain)
    grouped = (
        lines.join(kept.select("order_id", *KEYS), "order_id")
        .groupBy(*KEYS, "product_id")
        .agg(*line_cost_parts())
    )
    priced = (
        grouped.join(products.select("product_id", F.upper("sku").alias("cost_key")), "product_id", how)
        .join(cost_lookup(costs, cost_mode, as_of), "cost_key", "left")
    )
    value = cost_value(config.COGS_PRECEDENCE[channel])
    return priced.groupBy(*KEYS).agg(F.sum(value).alias(f"{channel}_cogs"))


def marketplace_cogs(
    sku_day: DataFrame, costs: DataFrame, grain: str, start=None, cost_mode: str = "raw", as_of=None, end=None
) -> DataFrame:
    kept = with_bucket(between_days(sku_day, "business_date", start, end), "business_date", grain)
    units = kept.groupBy(*KEYS, F.upper("msku").alias("cost_key")).agg(
        F.sum(F.col("units").cast("decimal(20,0)")).alias("units")
    )
    priced = units.join(cost_lookup(costs, cost_mode, as_of), "cost_key", "left")
    zero = F.lit(0).cast("decimal(38,2)")
    return priced.groupBy(*KEYS).agg(
        F.sum(F.coalesce(F.col("cost_per_unit") * F.col("units"), zero)).alias("marketplace_cogs")
    )


def marketplace_totals(
    sku_day: DataFrame, costs: DataFrame, grain: str, start=None, cost_mode: str = "raw", as_of=None, end=None
) -> DataFrame:
    """Sales and COGS of the marketplace from one aggregate per bucket and SKU.

    The costs of a key are added up first (a key listed twice counts twice in ``raw`` mode), so
    the join keeps one row per SKU and sales can be summed after it.
    """
    kept = with_bucket(between_days(sku_day, "business_date", start, end), "business_date", grain)
    sums = {"gross_sales": "marketplace_revenue", "units": "marketplace_units", "net_proceeds": "marketplace_net_proceeds", "ad_spend": "marketplace_ad_spend"}
    per_sku = kept.groupBy(*KEYS, F.upper("msku").alias("cost_key")).agg(*[F.sum(c).alias(n) for c, n in sums.items()])
    cost = cost_lookup(costs, cost_mode, as_of).groupBy("cost_key").agg(F.sum("cost_per_unit").alias("cost"))
    value = F.coalesce(F.col("cost") * F.col("marketplace_units").cast("decimal(38,0)"), F.lit(0).cast("decimal(38,2)"))
    return per_sku.join(cost, "cost_key", "left").groupBy(*KEYS).agg(*[F.sum(n).alias(n) for n in sums.values()], F.sum(value).alias("marketplace_cogs"))


# --- spine ----------------------------------------------------------------------
def combine(frames: Sequence[DataFrame], keys: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """Outer-merge aggregates on their shared keys with one small shuffle.

    Each frame holds one row per key, so after a union ``max`` just picks the
    value; the distinct keys of all frames form the spine on the way.
    """
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    metrics = [c for c in merged.columns if c not in keys]
    if not metrics:
        return merged.distinct()
    return merged.groupBy(*keys).agg(*[F.max(c).alias(c) for c in metrics])


def bucket_spine(frames: Sequence[DataFrame]) -> DataFrame:
    """Distinct buckets of several aggregates."""
    return combine([f.select(*KEYS) for f in frames])
