"""Registered queries: channel aggregates, mart, P&L."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from saleswell.functions.calendar import month_spine_bounds, range_bounds
from saleswell.functions.numeric import as_double
from saleswell.operators import channels as ch
from saleswell.operators.settlements import settled_orders, unpivot
from saleswell.plans import marts
from saleswell.plans.registry import query, sql_ratio, sql_round
from saleswell.sources.sample import Feeds

START = None  # whole history; a lower bound is the caller's choice
AS_OF = dt.date(2001, 7, 18)
D = "DATE '0001-01-01'"


def nested_web(f: Feeds) -> DataFrame:
    """The event table with its nested traffic-source structs."""
    w = f.web
    return w.select(
        "event_date",
        "event_name",
        "user_pseudo_id",
        F.struct(F.col("medium").alias("medium")).alias("traffic_source"),
        F.struct(F.struct(F.col("channel_group").alias("primary_channel_group")).alias("cross_channel_campaign")).alias(
            "session_source"
        ),
        F.struct("purchase_revenue", "transaction_id").alias("ecommerce"),
    )


class FeedInputs:
    """:class:`marts.ChannelInputs` over the canonical views, each opened on first use."""

    def __init__(self, feeds: Feeds):
        self._feeds = feeds

    def _of(self, view: str, channel: str) -> DataFrame:
        return getattr(self._feeds, view).where(F.col("channel") == channel)

    # One cached attribute per field.
    storefront_orders = cached_property(lambda self: self._of("order", "storefront"))
    storefront_lines = cached_property(lambda self: self._of("line", "storefront"))
    wholesale_orders = cached_property(lambda self: self._of("order", "wholesale"))
    wholesale_lines = cached_property(lambda self: self._of("line", "wholesale"))
    products = cached_property(lambda self: self._feeds.product)
    costs = cached_property(lambda self: self._feeds.cost)
    sku_day = cached_property(lambda self: self._feeds.sku_day)
    traffic = cached_property(lambda self: self._feeds.traffic)
    settlements = cached_property(lambda self: unpivot(self._feeds.settle_wide))
    settled_orders = cached_property(lambda self: settled_orders(self._feeds.settle_wide))
    web_events = cached_property(lambda self: nested_web(self._feeds))
    web_backfill = cached_property(lambda self: self._feeds.backfill)
    ads = cached_property(lambda self: self._feeds.ads)


def inputs(f: Feeds) -> FeedInputs:
    return FeedInputs(f)


# ------------------------------------------------------------------ oracle parts
BUCKETS = {
    "day": "CAST({d} AS DATE)",
    "week": "greatest(CAST(date_trunc('week', {d}) AS DATE), CAST(date_trunc('month', {d}) AS DATE))",
    "month": "CAST(date_trunc('month', {d}) AS DATE)",
}


def keys(day: str, grain: str) -> str:
    return f"{BUCKETS[grain].format(d=day)} AS bucket_start, CAST(year({day}) AS INTEGER) AS year"


def sql_storefront(grain, start=D):
    return f"""SELECT {keys('order_date', grain)}, CAST(COUNT(DISTINCT order_id) AS BIGINT) AS storefront_orders,
        SUM(total) AS storefront_revenue, {sql_ratio('SUM(total)', 'COUNT(total)')} AS storefront_aov,
        CAST(COUNT(DISTINCT customer_id) AS BIGINT) AS storefront_customers
        FROM v_order WHERE channel = 'storefront' AND status IN (2, 10, 11, 3) AND order_date >= {start} GROUP BY 1, 2"""


def sql_new_returning(grain, start=D):
    return f"""SELECT {keys('o.order_date', grain)},
        CAST(COUNT(DISTINCT CASE WHEN o.order_date = c.first_day THEN o.customer_id END) AS BIGINT) AS storefront_new_customers,
        CAST(COUNT(DISTINCT CASE WHEN o.order_date > c.first_day THEN o.customer_id END) AS BIGINT) AS storefront_returning_customers
        FROM v_order o JOIN (SELECT customer_id, MIN(order_date) AS first_day FROM v_order
             WHERE channel = 'storefront' AND status IN (2, 10, 11, 3) GROUP BY 1) c ON c.customer_id = o.customer_id
        WHERE o.channel = 'storefront' AND o.status IN (2, 10, 11, 3) AND o.order_date >= {start} GROUP BY 1, 2"""


def sql_marketplace(grain, start=D):
    return f"""SELECT {keys('business_date', grain)}, SUM(gross_sales) AS marketplace_revenue,
        CAST(SUM(units) AS BIGINT) AS marketplace_units, SUM(net_proceeds) AS marketplace_net_proceeds,
        SUM(ad_spend) AS marketplace_ad_spend FROM v_sku_day WHERE business_date >= {start} GROUP BY 1, 2"""


def sql_traffic(grain, start=D):
    return f"""SELECT {keys('report_date', grain)}, CAST(SUM(sessions) AS BIGINT) AS marketplace_sessions
        FROM v_traffic WHERE report_date >= {start} GROUP BY 1, 2"""


ORGANIC = (
    "(coalesce(channel_group IN ('Organic Search', 'Organic Social', 'Organic Video', 'Organic Shopping'), false)"
    " OR coalesce(lower(medium) = 'organic', false))"
)


def sql_web(grain, backfill="v_backfill"):
    day = "strptime(event_date, '%Y%m%d')::DATE"
    return f"""SELECT bucket_start, year, CAST(SUM(sessions) AS BIGINT) AS sessions, CAST(SUM(users) AS BIGINT) AS users,
        CAST(SUM(organic_sessions) AS BIGINT) AS organic_sessions, CAST(SUM(organic_users) AS BIGINT) AS organic_users,
        SUM(organic_revenue) AS organic_revenue, CAST(SUM(organic_orders) AS BIGINT) AS organic_orders FROM (
        SELECT {keys(day, grain)}, COUNT(*) FILTER (event_name = 'session_start') AS sessions,
          COUNT(DISTINCT user_pseudo_id) AS users,
          COUNT(*) FILTER (event_name = 'session_start' AND {ORGANIC}) AS organic_sessions,
          COUNT(DISTINCT CASE WHEN {ORGANIC} THEN user_pseudo_id END) AS organic_users,
          SUM(CASE WHEN event_name = 'purchase' AND {ORGANIC} THEN purchase_revenue ELSE 0 END) AS organic_revenue,
          COUNT(DISTINCT CASE WHEN event_name = 'purchase' AND {ORGANIC} THEN transaction_id END) AS organic_orders
        FROM v_web GROUP BY 1, 2
        UNION ALL
        SELECT {keys('day', grain)}, SUM(sessions), SUM(users), 0, 0, 0, 0 FROM {backfill} GROUP BY 1, 2) u GROUP BY 1, 2"""


def sql_settlement(grain, start=D):
    return f"""SELECT {keys('posted', grain)}, CAST(COUNT(DISTINCT order_id) AS BIGINT) AS marketplace_orders FROM (
        SELECT order_id, coalesce(try_cast(substr(coalesce(nullif(posted_date, ''), posted_date_time), 1, 10) AS DATE),
                 CAST(try_strptime(posted_date, '%d.%m.%Y') AS DATE)) AS posted
        FROM v_settle_wide WHERE try_cast(CASE WHEN quantity_purchased = '' THEN '0' ELSE quantity_purchased END AS BIGINT) IS NOT NULL
          AND (coalesce(try_cast(price_amount AS DECIMAL(18,2)), 0) <> 0
            OR (price_type = '' AND coalesce(try_cast(quantity_purchased AS BIGINT), 0) > 0)
            OR coalesce(try_cast(item_fee_amount AS DECIMAL(18,2)), 0) + coalesce(try_cast(order_fee_amount AS DECIMAL(18,2)), 0)
               + coalesce(try_cast(shipment_fee_amount AS DECIMAL(18,2)), 0) <> 0
            OR coalesce(try_cast(promotion_amount AS DECIMAL(18,2)), 0) <> 0
            OR coalesce(try_cast(other_fee_amount AS DECIMAL(18,2)), 0) + coalesce(try_cast(other_amount AS DECIMAL(18,2)), 0) <> 0)) s
        WHERE posted >= {start} GROUP BY 1, 2"""


def sql_wholesale(grain, start=D):
    return f"""SELECT {keys('order_date', grain)}, CAST(COUNT(DISTINCT order_id) AS BIGINT) AS wholesale_orders,
        SUM(CASE WHEN status IN (2, 10) THEN sub_total ELSE 0 END) AS wholesale_revenue,
        SUM(CASE WHEN status IN (8, 11) THEN sub_total ELSE 0 END) AS wholesale_future_revenue
        FROM v_order WHERE channel = 'wholesale' AND status NOT IN (0, 5, 6) AND order_date >= {start} GROUP BY 1, 2"""


def sql_ads(grain, start=D):
    return f"""SELECT {keys('segments_date', grain)}, CAST(SUM(CAST(cost_micros AS DECIMAL(28,0))) / 1000000 AS DECIMAL(28,2)) AS search_ad_spend
        FROM v_ads WHERE segments_date >= {start} GROUP BY 1, 2"""


def sql_cogs(channel, grain, start=D):
    qty = "CAST(li.quantity AS DECIMAL(12,0))"
    base, dim = f"li.base_cost_price * {qty}", f"c.cost_per_unit * {qty}"
    if channel == "storefront":
        rule = f"CASE WHEN li.base_cost_price > 0 THEN {base} WHEN c.cost_per_unit IS NOT NULL THEN {dim} ELSE 0 END"
        how, status = "JOIN", "o.status IN (2, 10, 11, 3)"
    else:
        rule = f"CASE WHEN c.cost_per_unit IS NOT NULL THEN {dim} WHEN li.base_cost_price > 0 THEN {base} ELSE 0 END"
        how, status = "LEFT JOIN", "o.status NOT IN (0, 5, 6)"
    return f"""SELECT {keys('o.order_date', grain)}, SUM({rule}) AS {channel}_cogs
        FROM v_line li JOIN v_order o ON o.order_id = li.order_id {how} v_product p ON p.product_id = li.product_id
        LEFT JOIN v_cost c ON upper(p.sku) = upper(c.msku)
        WHERE o.channel = '{channel}' AND {status} AND o.order_date >= {start} GROUP BY 1, 2"""


def sql_marketplace_cogs(grain, start=D):
    return f"""SELECT {keys('a.business_date', grain)},
        SUM(CASE WHEN c.cost_per_unit IS NOT NULL THEN c.cost_per_unit * CAST(a.units AS DECIMAL(12,0)) ELSE 0 END) AS marketplace_cogs
        FROM v_sku_day a LEFT JOIN v_cost c ON upper(a.msku) = upper(c.msku) WHERE a.business_date >= {start} GROUP BY 1, 2"""


def dbl(sql: str, *cols: str) -> str:
    """Cast exact money columns of an inner query to DOUBLE."""
    swaps = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({swaps}) FROM ({sql}) q"


def to_double(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: as_double(F.col(c)) for c in cols})


def sql_mart(grain, start=D):
    ctes = {
        "a1": sql_storefront(grain, start), "a2": sql_new_returning(grain, start), "a3": sql_marketplace(grain, start),
        "a4": sql_traffic(grain, start), "a5": sql_web(grain), "a6": sql_settlement(grain, start),
        "a7": sql_wholesale(grain, start), "a8": sql_ads(grain, start), "a9": sql_cogs("storefront", grain, start),
        "a10": sql_marketplace_cogs(grain, start), "a11": sql_cogs("wholesale", grain, start),
    }
    z = lambda c: f"coalesce({c}, 0)"
    d = lambda e: f"CAST(ROUND({e}, 2) AS DOUBLE)"
    counts = "".join(
        f"CAST({z('sessions' if c == 'storefront_sessions' else 'users' if c == 'storefront_users' else c)} AS BIGINT) AS {c}, "
        for c in marts.COUNTS
    )
    amounts = "".join(f"{d(z(c))} AS {c}, " for c in marts.AMOUNTS)
    joins = " ".join(f"LEFT JOIN {n} USING (bucket_start, year)" for n in ctes)
    return f"""WITH {', '.join(f'{n} AS ({s})' for n, s in ctes.items())},
        spine AS ({' UNION '.join(f'SELECT bucket_start, year FROM {n}' for n in ctes)})
        SELECT bucket_start, year, {counts} {amounts} {z('storefront_aov')} AS storefront_aov,
          {sql_ratio(z('storefront_orders'), z('sessions'), 100)} AS storefront_cvr,
          {sql_ratio(z('marketplace_units'), z('marketplace_sessions'), 100)} AS marketplace_cvr,
          {sql_ratio(z('marketplace_net_proceeds'), z('marketplace_revenue'), 100)} AS marketplace_margin_pct,
          {sql_ratio(z('wholesale_revenue'), z('wholesale_orders'))} AS wholesale_aov,
          {d(f"{z('marketplace_ad_spend')} + {z('search_ad_spend')}")} AS total_ad_spend,
          {d(f"{z('storefront_revenue')} + {z('marketplace_revenue')} + {z('wholesale_revenue')}")} AS company_revenue,
          {d(f"{z('storefront_cogs')} + {z('marketplace_cogs')} + {z('wholesale_cogs')}")} AS total_cogs,
          {d(f"({z('storefront_revenue')} - {z('storefront_cogs')}) + ({z('marketplace_net_proceeds')} - {z('marketplace_cogs')}) + ({z('wholesale_revenue')} - {z('wholesale_cogs')})")} AS estimated_profit
        FROM spine {joins}"""


def sql_pl():
    first, last = month_spine_bounds(AS_OF)
    s = f"DATE '{first}'"
    z = lambda c: f"coalesce({c}, 0)"
    d = lambda e: f"CAST(ROUND({e}, 2) AS DOUBLE)"
    parts = (
        "marketplace_gross_sales storefront_revenue wholesale_revenue marketplace_cogs storefront_cogs "
        "wholesale_cogs marketplace_fees marketplace_ad_spend search_ad_spend marketplace_net_proceeds"
    ).split()
    gross = f"{z('marketplace_gross_sales')} + {z('storefront_revenue')} + {z('wholesale_revenue')}"
    net, ret = f"{gross} + {z('marketplace_returns')}", z("marketplace_returns")
    cogs = f"{z('marketplace_cogs')} + {z('storefront_cogs')} + {z('wholesale_cogs')}"
    ads = f"{z('marketplace_ad_spend')} + {z('search_ad_spend')}"
    gp = f"({net}) - ({cogs})"
    contrib = f"{gp} + {z('marketplace_fees')} - ({ads})"
    mkt = f"""SELECT CAST(date_trunc('month', business_date) AS DATE) AS bucket_start, SUM(gross_sales) AS marketplace_gross_sales,
        SUM(refunds) AS marketplace_returns, SUM(fees) AS marketplace_fees, SUM(ad_spend) AS marketplace_ad_spend,
        SUM(net_proceeds) AS marketplace_net_proceeds, SUM(units) AS marketplace_units FROM v_sku_day WHERE business_date >= {s} GROUP BY 1"""
    subs = {
        "b1": mkt, "b2": sql_marketplace_cogs("month", s), "b3": sql_storefront("month", s),
        "b4": sql_cogs("storefront", "month", s), "b5": sql_wholesale("month", s),
        "b6": sql_cogs("wholesale", "month", s), "b7": sql_ads("month", s),
    }
    joins = " ".join(f"LEFT JOIN {n} ON {n}.bucket_start = m.bucket_start" for n in subs)
    return f"""WITH {', '.join(f'{n} AS ({q})' for n, q in subs.items())},
        m AS (SELECT CAST(unnest(generate_series({s}, DATE '{last}', INTERVAL 1 MONTH)) AS DATE) AS bucket_start),
        r AS (SELECT strftime(m.bucket_start, '%Y-%m') AS month, {', '.join(f'{d(z(p))} AS {p}' for p in parts)},
          CAST({z('marketplace_units')} AS BIGINT) AS marketplace_units, {d(gross)} AS gross_sales, {d(ret)} AS returns,
          {d(net)} AS net_sales, {d(cogs)} AS cogs, {d(gp)} AS gross_profit, {d(ads)} AS ad_spend, {d(contrib)} AS contribution_profit
          FROM m {joins})
        SELECT *, coalesce({sql_ratio('gross_profit', 'net_sales', 100, 1)}, 0) AS gross_margin_pct,
          coalesce({sql_ratio('contribution_profit', 'net_sales', 100, 1)}, 0) AS contribution_margin_pct FROM r"""


# ---------------------------------------------------------------------- queries
@query("scan_fact_range", """SELECT business_date, msku, units, CAST(gross_sales AS DOUBLE) AS gross_sales FROM v_sku_day
       WHERE business_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'""")
def scan_fact_range(f):
    kept = ch.between_days(f.sku_day, "business_date", dt.date(1999, 1, 1), dt.date(1999, 12, 31))
    return to_double(kept.select("business_date", "msku", "units", "gross_sales"), "gross_sales")


@query("scan_sharded_events", "SELECT event_date, COUNT(*) AS n FROM v_web WHERE event_date >= '20010110' GROUP BY 1")
def scan_sharded_events(f):
    return nested_web(f).where(F.col("event_date") >= "20010110").groupBy("event_date").agg(F.count("*").alias("n"))


@query("status_filter", """SELECT channel, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(total) AS DOUBLE) AS total FROM v_order
       WHERE order_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'
         AND ((channel = 'storefront' AND status IN (2,10,11,3)) OR (channel = 'wholesale' AND status NOT IN (0,5,6))) GROUP BY 1""")
def status_filter(f):
    o = ch.between_days(f.order, "order_date", dt.date(1998, 1, 1), dt.date(1998, 12, 31))
    keep = ((F.col("channel") == "storefront") & F.col("status").isin(2, 10, 11, 3)) | (
        (F.col("channel") == "wholesale") & ~F.col("status").isin(0, 5, 6)
    )
    return o.where(keep).groupBy("channel").agg(F.count("*").alias("n"), F.sum("total").cast("double").alias("total"))


@query("storefront_bucket", dbl(sql_storefront("week"), "storefront_revenue"))
def storefront_bucket(f):
    return to_double(ch.storefront_sales(inputs(f).storefront_orders, "week", START), "storefront_revenue")


@query("new_vs_returning", sql_new_returning("week"))
def new_vs_returning(f):
    return ch.new_and_returning(inputs(f).storefront_orders, "week", START)


@query("marketplace_bucket", dbl(sql_marketplace("week"), "marketplace_revenue", "marketplace_net_proceeds", "marketplace_ad_spend"))
def marketplace_bucket(f):
    cols = ("marketplace_revenue", "marketplace_net_proceeds", "marketplace_ad_spend")
    return to_double(ch.marketplace_sales(f.sku_day, "week", START), *cols)


@query("traffic_bucket", sql_traffic("week"))
def traffic_bucket(f):
    return ch.marketplace_traffic(f.traffic, "week", START)


@query("web_traffic", dbl(sql_web("week"), "organic_revenue"))
def web_traffic(f):
    return to_double(ch.web_traffic(nested_web(f), f.backfill, "week"), "organic_revenue")


@query("traffic_backfill", dbl(sql_web(
    "day", "(SELECT * FROM v_backfill WHERE day NOT IN (SELECT event_day FROM v_web)) b"), "organic_revenue"))
def traffic_backfill(f):
    return to_double(ch.web_traffic(nested_web(f), f.backfill, "day", mode="prefer_live"), "organic_revenue")


@query("settlement_orders", sql_settlement("week"))
def settlement_orders(f):
    return ch.settlement_orders(settled_orders(f.settle_wide), "week", START)


@query("wholesale_bucket", dbl(sql_wholesale("week"), "wholesale_revenue", "wholesale_future_revenue"))
def wholesale_bucket(f):
    cols = ("wholesale_revenue", "wholesale_future_revenue")
    return to_double(ch.wholesale_sales(inputs(f).wholesale_orders, "week", START), *cols)


@query("ads_cost", dbl(sql_ads("week"), "search_ad_spend"))
def ads_cost(f):
    return to_double(ch.ads_cost(f.ads, "week", START), "search_ad_spend")


@query("cogs_bucket", f"""WITH a AS ({sql_cogs('storefront', 'week')}), b AS ({sql_marketplace_cogs('week')}), c AS ({sql_cogs('wholesale', 'week')})
    SELECT bucket_start, year, CAST(storefront_cogs AS DOUBLE) AS storefront_cogs, CAST(marketplace_cogs AS DOUBLE) AS marketplace_cogs,
           CAST(wholesale_cogs AS DOUBLE) AS wholesale_cogs
    FROM a FULL JOIN b USING (bucket_start, year) FULL JOIN c USING (bucket_start, year)""")
def cogs_bucket(f):
    x = inputs(f)
    frames = [
        ch.order_cogs(x.storefront_lines, x.storefront_orders, x.products, x.costs, "storefront", "week", START),
        ch.marketplace_cogs(x.sku_day, x.costs, "week", START),
        ch.order_cogs(x.wholesale_lines, x.wholesale_orders, x.products, x.costs, "wholesale", "week", START),
    ]
    return to_double(ch.combine(frames), "storefront_cogs", "marketplace_cogs", "wholesale_cogs")


@query("cogs_precedence", """
    SELECT channel, CAST(SUM(CASE WHEN channel = 'storefront' THEN
             CASE WHEN base_cost_price > 0 THEN base_cost_price * quantity WHEN c.cost IS NOT NULL THEN c.cost * quantity ELSE 0 END
           ELSE CASE WHEN c.cost IS NOT NULL THEN c.cost * quantity WHEN base_cost_price > 0 THEN base_cost_price * quantity ELSE 0 END END) AS DOUBLE) AS cogs
    FROM v_line l JOIN v_product p USING (product_id)
    LEFT JOIN (SELECT upper(msku) AS k, max_by(cost_per_unit, valid_from) AS cost FROM v_cost
               WHERE valid_to IS NULL OR valid_to >= DATE '2001-07-18' GROUP BY 1) c ON c.k = upper(p.sku)
    WHERE channel <> 'marketplace' GROUP BY 1""")
def cogs_precedence(f):
    cost = ch.cost_lookup(f.cost, "latest_valid", AS_OF)
    grouped = f.line.where(F.col("channel") != "marketplace").groupBy("channel", "product_id").agg(*ch.line_cost_parts())
    priced = grouped.join(f.product.select("product_id", F.upper("sku").alias("cost_key")), "product_id").join(
        cost, "cost_key", "left"
    )
    value = F.when(F.col("channel") == "storefront", ch.cost_value(("line", "dimension"))).otherwise(
        ch.cost_value(("dimension", "line"))
    )
    return priced.groupBy("channel").agg(F.sum(value).cast("double").alias("cogs"))


@query("bucket_spine", f"""SELECT bucket_start, year FROM ({sql_storefront('week')}) a UNION
    SELECT bucket_start, year FROM ({sql_marketplace('week')}) b UNION SELECT bucket_start, year FROM ({sql_wholesale('week')}) c""")
def bucket_spine(f):
    x = inputs(f)
    return ch.bucket_spine([
        ch.storefront_sales(x.storefront_orders, "week", START),
        ch.marketplace_sales(x.sku_day, "week", START),
        ch.wholesale_sales(x.wholesale_orders, "week", START),
    ])


@query("channel_week", sql_mart("week"))
def channel_week(f):
    return marts.channel_mart(inputs(f), "week", START)


@query("channel_day", sql_mart("day"))
def channel_day(f):
    return marts.channel_mart(inputs(f), "day", START)


@query("pl_monthly", sql_pl())
def pl_monthly(f):
    return marts.pl_monthly(inputs(f), AS_OF)


@query("month_spine", """SELECT strftime(m, '%Y-%m') AS month, CAST(count(order_id) AS BIGINT) AS orders FROM
    (SELECT CAST(unnest(generate_series(DATE '2000-06-01', DATE '2001-07-01', INTERVAL 1 MONTH)) AS DATE) AS m) s
    LEFT JOIN v_order ON CAST(date_trunc('month', order_date) AS DATE) = m GROUP BY 1""")
def month_spine(f):
    first, last = month_spine_bounds(AS_OF)
    counts = ch.with_bucket(ch.between_days(f.order, "order_date", first), "order_date", "month").groupBy("bucket_start").agg(
        F.count("order_id").alias("n")
    )
    spine = marts.month_spine(f.spark, first, last)
    return spine.join(counts, "bucket_start", "left").select(
        F.date_format("bucket_start", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("orders")
    )


RANGES = ("today", "last7", "last30", "mtd", "qtd", "ytd")


@query("range_bounds", " UNION ALL ".join(
    f"SELECT '{r}' AS range_name, CAST(COUNT(*) AS BIGINT) AS orders, CAST(SUM(total) AS DOUBLE) AS total FROM v_order WHERE order_date BETWEEN {lo} AND DATE '2001-07-18'"
    for r, lo in {"today": "DATE '2001-07-18'", "last7": "DATE '2001-07-12'", "last30": "DATE '2001-06-19'",
                  "mtd": "DATE '2001-07-01'", "qtd": "DATE '2001-07-01'", "ytd": "DATE '2001-01-01'"}.items()))
def range_bounds_query(f):
    """All named ranges in one pass: each order is matched to the ranges it falls in."""
    bounds = {r: range_bounds(r, AS_OF) for r in RANGES}
    inside = [F.when(F.col("order_date").between(*map(F.lit, b)), F.lit(r)) for r, b in bounds.items()]
    tagged = f.order.where(F.col("order_date").between(F.lit(bounds["ytd"][0]), F.lit(AS_OF))).select(
        "total", F.explode(F.array_compact(F.array(*inside))).alias("range_name")
    )
    hits = tagged.groupBy("range_name").agg(F.count("*").alias("orders"), F.sum("total").cast("double").alias("total"))
    names = f.spark.range(1).select(F.explode(F.array(*map(F.lit, RANGES))).alias("range_name"))
    return names.join(hits, "range_name", "left").select("range_name", F.coalesce("orders", F.lit(0)).alias("orders"), "total")
