"""The channel mart and the monthly P&L."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from saleswell.functions.calendar import month_spine_bounds
from saleswell.functions.numeric import as_double, ratio, zero_if_null
from saleswell.operators import channels as ch


@dataclass(frozen=True)
class ChannelInputs:
    """Everything the marts read; each field is a DataFrame."""

    storefront_orders: DataFrame
    storefront_lines: DataFrame
    wholesale_orders: DataFrame
    wholesale_lines: DataFrame
    products: DataFrame
    costs: DataFrame
    sku_day: DataFrame
    traffic: DataFrame
    settlements: DataFrame
    settled_orders: DataFrame
    web_events: DataFrame
    web_backfill: DataFrame
    ads: DataFrame


COUNTS = (
    "storefront_orders storefront_customers storefront_new_customers storefront_returning_customers "
    "storefront_sessions storefront_users organic_sessions organic_users organic_orders marketplace_units "
    "marketplace_orders marketplace_sessions wholesale_orders"
).split()
AMOUNTS = (
    "storefront_revenue organic_revenue marketplace_revenue marketplace_net_proceeds wholesale_revenue "
    "wholesale_future_revenue marketplace_ad_spend search_ad_spend storefront_cogs marketplace_cogs wholesale_cogs"
).split()


def channel_aggregates(
    x: ChannelInputs,
    grain: str,
    start: dt.date | None = None,
    first_shard: str | None = None,
    traffic_mode: str = "additive",
    cost_mode: str = "raw",
    as_of: dt.date | None = None,
    end: dt.date | None = None,
) -> list[DataFrame]:
    """Every channel metric; ``start`` and ``end`` reach the fact scans."""
    web = ch.web_traffic(x.web_events, x.web_backfill, grain, first_shard, traffic_mode, start, end)
    return [
        ch.storefront_sales(x.storefront_orders, grain, start, end=end),
        ch.new_and_returning(x.storefront_orders, grain, start, end=end),
        ch.marketplace_totals(x.sku_day, x.costs, grain, start, cost_mode, as_of, end),
        ch.marketplace_traffic(x.traffic, grain, start, end),
        web.withColumnsRenamed({"sessions": "storefront_sessions", "users": "storefront_users"}),
        ch.settlement_orders(x.settled_orders, grain, start, end),
        ch.wholesale_sales(x.wholesale_orders, grain, start, end),
        ch.ads_cost(x.ads, grain, start, end),
        ch.order_cogs(
            x.storefront_lines, x.storefront_orders, x.products, x.costs, "storefront", grain, start, cost_mode, as_of, end
        ),
        ch.order_cogs(
            x.wholesale_lines, x.wholesale_orders, x.products, x.costs, "wholesale", grain, start, cost_mode, as_of, end
        ),
    ]


def channel_mart(x: ChannelInputs, grain: str = "week", start=None, limit: int | None = None, **options) -> DataFrame:
    """One row per bucket with every channel metric and the derived ratios.

    ``start`` and ``end`` bound the facts by day, so the first and last bucket may be partial.  ``limit`` keeps the newest buckets, as a display does; by default all are kept.
    """
    raw = ch.combine(channel_aggregates(x, grain, start, **options))
    money = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(38,2)"))
    mart = raw.select(
        *ch.KEYS,
        *[zero_if_null(F.col(c)).cast("bigint").alias(c) for c in COUNTS],
        *[money(c).alias(c) for c in AMOUNTS],
        F.coalesce("storefront_aov", F.lit(0.0)).alias("storefront_aov"),
    )
    mart = derived_metrics(mart)
    return mart if limit is None else mart.orderBy(F.desc("bucket_start")).limit(limit)


def derived_metrics(m: DataFrame) -> DataFrame:
    """Ratios and company totals.  Profit uses marketplace net proceeds, not gross."""
    c = F.col
    profit = (
        c("storefront_revenue") - c("storefront_cogs")
        + c("marketplace_net_proceeds") - c("marketplace_cogs")
        + c("wholesale_revenue") - c("wholesale_cogs")
    )
    extra: dict[str, Column] = {
        "storefront_cvr": ratio(c("storefront_orders"), c("storefront_sessions"), 100),
        "marketplace_cvr": ratio(c("marketplace_units"), c("marketplace_sessions"), 100),
        "marketplace_margin_pct": ratio(c("marketplace_net_proceeds"), c("marketplace_revenue"), 100),
        "wholesale_aov": ratio(c("wholesale_revenue"), c("wholesale_orders")),
        "total_ad_spend": as_double(c("marketplace_ad_spend") + c("search_ad_spend")),
        "company_revenue": as_double(c("storefront_revenue") + c("marketplace_revenue") + c("wholesale_revenue")),
        "total_cogs": as_double(c("storefront_cogs") + c("marketplace_cogs") + c("wholesale_cogs")),
        "estimated_profit": as_double(profit),
    }
    m = m.withColumns(extra)
    return m.withColumns({a: as_double(c(a)) for a in AMOUNTS})


def pl_monthly(x: ChannelInputs, as_of: dt.date, months_back: int = 13, cost_mode: str = "raw") -> DataFrame:
    """Contribution-style P&L per month.

    The spine runs from ``months_back`` months ago to the current month, both
    included, so the default has fourteen rows.
    """
    first, last = month_spine_bounds(as_of, months_back)
    frames = [
        ch.marketplace_pl(x.sku_day, "month", first).withColumnRenamed("marketplace_net_sales", "_net"),
        ch.marketplace_cogs(x.sku_day, x.costs, "month", first, cost_mode, as_of),
        ch.storefront_sales(x.storefront_orders, "month", first).select(
            *ch.KEYS, "storefront_revenue", "storefront_orders"
        ),
        ch.order_cogs(
            x.storefront_lines, x.storefront_orders, x.products, x.costs, "storefront", "month", first, cost_mode, as_of
        ),
        ch.wholesale_sales(x.wholesale_orders, "month", first).select(*ch.KEYS, "wholesale_revenue"),
        ch.order_cogs(
            x.wholesale_lines, x.wholesale_orders, x.products, x.costs, "wholesale", "month", first, cost_mode, as_of
        ),
        ch.ads_cost(x.ads, "month", first),
    ]
    spine = month_spine(x.sku_day.sparkSession, first, last)
    raw = spine.join(ch.combine(frames).drop("year"), "bucket_start", "left")
    m = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(38,2)"))
    gross = m("marketplace_gross_sales") + m("storefront_revenue") + m("wholesale_revenue")
    net = gross + m("marketplace_returns")
    cogs = m("marketplace_cogs") + m("storefront_cogs") + m("wholesale_cogs")
    ads = m("marketplace_ad_spend") + m("search_ad_spend")
    lines = {
        "gross_sales": gross,
        "returns": m("marketplace_returns"),
        "net_sales": net,
        "cogs": cogs,
        "gross_profit": net - cogs,
        "ad_spend": ads,
        "contribution_profit": net - cogs + m("marketplace_fees") - ads,
    }
    parts = (
        "marketplace_gross_sales storefront_revenue wholesale_revenue marketplace_cogs storefront_cogs "
        "wholesale_cogs marketplace_fees marketplace_ad_spend search_ad_spend marketplace_net_proceeds"
    ).split()
    out = raw.select(
        F.date_format("bucket_start", "yyyy-MM").alias("month"),
        *[as_double(m(p)).alias(p) for p in parts],
        zero_if_null(F.col("marketplace_units")).cast("bigint").alias("marketplace_units"),
        *[as_double(v).alias(k) for k, v in lines.items()],
    )
    margin = lambda c: F.coalesce(ratio(F.col(c), F.col("net_sales"), 100, 1), F.lit(0.0))
    return out.withColumns(
        {"gross_margin_pct": margin("gross_profit"), "contribution_margin_pct": margin("contribution_profit")}
    )


def month_spine(spark, first: dt.date, last: dt.date) -> DataFrame:
    months = F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 1 MONTH"))
    return spark.range(1).select(F.explode(months).alias("bucket_start"))
