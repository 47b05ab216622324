"""Registered queries: comparison, KPIs, bridges, alerts, P&L views, mart checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from saleswell.functions.numeric import ratio
from saleswell.operators import channels as ch, compare, kpi
from saleswell.plans import marts
from saleswell.plans.queries_channels import AS_OF, START, inputs, sql_mart, sql_pl, sql_storefront
from saleswell.plans.registry import query, sql_ratio

YTD = (dt.date(AS_OF.year, 1, 1), AS_OF)
_END = "least(bucket_start + 6, last_day(bucket_start))"
_RANGE = f"{_END} >= DATE '{YTD[0]}' AND bucket_start <= DATE '{YTD[1]}'"
_MONDAY = "DATE '2001-07-16'"

MART = f"mart AS ({sql_mart('week')})"
CUR = f"""rng AS (SELECT * FROM mart WHERE {_RANGE}),
    cur AS (SELECT * FROM rng WHERE bucket_start <> {_MONDAY} OR (SELECT max(bucket_start) FROM rng) <> {_MONDAY})"""
PAIRS = f"""{MART}, {CUR}, pairs AS (SELECT c.bucket_start, p.bucket_start AS prior_day,
      {', '.join(f'CAST(c.{m} AS DOUBLE) AS cur_{m}, CAST(p.{m} AS DOUBLE) AS prev_{m}' for m in kpi.SUMMED)}
    FROM cur c LEFT JOIN mart p ON p.bucket_start =
      (SELECT max(m.bucket_start) FROM mart m WHERE abs(m.bucket_start - (c.bucket_start - 364)) <= 3))"""
_SUM = lambda c: f"coalesce(CAST(SUM(CAST({c} AS DECIMAL(28,2))) AS DOUBLE), 0) AS {c}"
TOTALS = f"{PAIRS}, t AS (SELECT {', '.join(_SUM(f'{p}_{m}') for p in ('cur', 'prev') for m in kpi.SUMMED)} FROM pairs)"


def mart(f, start=START, end=None):
    return marts.channel_mart(inputs(f), "week", start, end=end)


def pairs(f):
    """Year to date beside the year before; only the days that these buckets need are read."""
    start, end = compare.fact_days("ytd", AS_OF)
    return compare.headline(compare.prior_year(mart(f, start, end), kpi.SUMMED), "ytd", AS_OF)


def pos(num, den, scale=None, other="0.0"):
    return f"CASE WHEN {den} > 0 THEN {sql_ratio(num, den, scale, 4)} ELSE {other} END"


def profit(p, c):
    income = "marketplace_net_proceeds" if c == "marketplace" else f"{c}_revenue"
    return f"ROUND({p}_{income} - {p}_{c}_cogs, 2)"


def margin(p, c):
    return pos(profit(p, c), f"{p}_{c}_revenue", 100, "NULL")


def orders(p):
    return f"({p}_storefront_orders + {p}_marketplace_orders + {p}_wholesale_orders)"


N = "CAST(NULL AS DOUBLE)"


def sql_selected(p, c):
    if c == "all":
        return {
            "total_revenue": N, "gross_revenue": N, "net_revenue": f"{p}_company_revenue",
            "gross_profit": f"{p}_estimated_profit",
            "contribution_margin": pos(f"{p}_estimated_profit", f"{p}_company_revenue", 100), "orders": orders(p),
            "aov": pos(f"{p}_company_revenue", orders(p)), "units": f"{p}_marketplace_units",
            "marketing_spend": f"{p}_total_ad_spend", "mer": pos(f"{p}_company_revenue", f"{p}_total_ad_spend"),
            "future_revenue": N,
        }
    m, w, rev = c == "marketplace", c == "wholesale", f"{p}_{c}_revenue"
    return {
        "total_revenue": f"ROUND({rev} + {p}_wholesale_future_revenue, 2)" if w else N,
        "gross_revenue": rev if m else N, "net_revenue": rev, "gross_profit": profit(p, c),
        "contribution_margin": margin(p, c), "orders": f"{p}_{c}_orders", "aov": pos(rev, f"{p}_{c}_orders"),
        "units": f"{p}_marketplace_units" if m else N, "marketing_spend": f"{p}_total_ad_spend" if m else N,
        "mer": pos(f"{p}_company_revenue", f"{p}_total_ad_spend") if m else N,
        "future_revenue": f"{p}_wholesale_future_revenue" if w else N,
    }


def union(head: str, table: str, records: list[dict]) -> str:
    body = " UNION ALL ".join(
        "SELECT " + ", ".join(f"{v} AS {k}" for k, v in r.items()) + f" FROM {table}" for r in records
    )
    return f"WITH {head} {body}"


ALL = ("all", *kpi.CHANNELS)


@query("bucket_overlap", f"""WITH a AS ({sql_storefront('week')}) SELECT bucket_start, {_END} AS bucket_end, storefront_orders
    FROM a WHERE {_END} >= DATE '1999-02-03' AND bucket_start <= DATE '2000-11-15'""")
def bucket_overlap(f):
    weekly = ch.storefront_sales(inputs(f).storefront_orders, "week", START)
    kept = compare.in_range(weekly, dt.date(1999, 2, 3), dt.date(2000, 11, 15))
    return kept.select("bucket_start", compare.bucket_end(F.col("bucket_start")).alias("bucket_end"), "storefront_orders")


@query("trim_incomplete_week", f"""WITH a AS ({sql_storefront('week')}) SELECT 'week' AS grain, bucket_start, storefront_orders FROM a
      WHERE {_RANGE} AND (bucket_start <> {_MONDAY} OR (SELECT max(bucket_start) FROM a WHERE {_RANGE}) <> {_MONDAY})
    UNION ALL SELECT 'day', bucket_start, storefront_orders FROM ({sql_storefront('day')}) b
      WHERE bucket_start BETWEEN DATE '{YTD[0]}' AND DATE '{YTD[1]}' AND bucket_start < {_MONDAY}""")
def trim_incomplete_week(f):
    o = inputs(f).storefront_orders
    parts = [
        compare.headline(ch.storefront_sales(o, g, START), "ytd", AS_OF, g).select(
            F.lit(g).alias("grain"), "bucket_start", "storefront_orders"
        )
        for g in ("week", "day")
    ]
    return parts[0].unionByName(parts[1])


def _yoy(f, grain, **kw):
    daily = ch.storefront_sales(inputs(f).storefront_orders, grain, START)
    out = compare.prior_year(daily, ["storefront_orders", "storefront_revenue"], **kw)
    return out.withColumns({c: F.col(c).cast("double") for c in ("cur_storefront_revenue", "prev_storefront_revenue")})


def _sql_yoy(grain, prev):
    return f"""WITH a AS ({sql_storefront(grain)}) SELECT c.bucket_start, p.bucket_start AS prior_day,
      c.storefront_orders AS cur_storefront_orders, CAST(c.storefront_revenue AS DOUBLE) AS cur_storefront_revenue,
      p.storefront_orders AS prev_storefront_orders, CAST(p.storefront_revenue AS DOUBLE) AS prev_storefront_revenue
    FROM a c LEFT JOIN a p ON p.bucket_start = {prev}"""


_CAND = "FROM a m WHERE abs(m.bucket_start - (c.bucket_start - 364)) <= 3"


@query("yoy_tolerance", _sql_yoy("day", f"(SELECT max(m.bucket_start) {_CAND})"))
def yoy_tolerance(f):
    return _yoy(f, "day")


@query("yoy_nearest", _sql_yoy("day", f"""(SELECT m.bucket_start {_CAND}
    ORDER BY abs(m.bucket_start - (c.bucket_start - 364)), m.bucket_start DESC LIMIT 1)"""))
def yoy_nearest(f):
    return _yoy(f, "day", pick="nearest")


@query("yoy_exact", _sql_yoy("week", "c.bucket_start - 364"))
def yoy_exact(f):
    return _yoy(f, "week", tolerance=0)


@query("prior_period", f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY bucket_start DESC) AS pos,
      {_END} >= DATE '2000-01-01' AND bucket_start <= DATE '2000-06-30' AS sel FROM ({sql_storefront('week')}) q)
    SELECT c.bucket_start, p.bucket_start AS prior_day, c.storefront_orders AS cur_storefront_orders,
      p.storefront_orders AS prev_storefront_orders
    FROM a c LEFT JOIN a p ON p.pos = c.pos + (SELECT COUNT(*) FROM a WHERE sel) WHERE c.sel""")
def prior_period(f):
    weekly = ch.storefront_sales(inputs(f).storefront_orders, "week", START)
    selected = compare.overlaps(
        F.col("bucket_start"), compare.bucket_end(F.col("bucket_start")), dt.date(2000, 1, 1), dt.date(2000, 6, 30)
    )
    return compare.prior_period(weekly, selected, ["storefront_orders"])


@query("kpi_totals", union(TOTALS, "t", [
    {"period": f"'{label}'", "channel": f"'{c}'", **sql_selected(p, c)}
    for p, label in (("cur", "current"), ("prev", "previous")) for c in ALL]))
def kpi_totals(f):
    return kpi.kpi_totals(pairs(f))


def _sql_bridge():
    out = []
    for c in ALL:
        a, b = sql_selected("cur", c), sql_selected("prev", c)
        aov = lambda m: f"coalesce({m['net_revenue']} / NULLIF({m['orders']}, 0), 0.0)"
        delta = f"({a['net_revenue']} - {b['net_revenue']})"
        volume = f"(({a['orders']} - {b['orders']}) * {aov(b)})"
        price = f"(({aov(a)} - {aov(b)}) * {b['orders']})"
        out.append({
            "channel": f"'{c}'", "volume_effect": f"ROUND({volume}, 2)", "price_effect": f"ROUND({price}, 2)",
            "mix_effect": f"ROUND({delta} - {volume} - {price}, 2)", "revenue_change": f"ROUND({delta}, 2)",
            "profit_change": f"ROUND({a['gross_profit']} - {b['gross_profit']}, 2)"})
    return union(TOTALS, "t", out)


@query("pvm_bridge", _sql_bridge())
def pvm_bridge(f):
    return kpi.price_volume_mix(pairs(f))


def _sql_efficiency():
    ads, out = {"storefront": "cur_search_ad_spend", "marketplace": "cur_marketplace_ad_spend"}, []
    for c in kpi.CHANNELS:
        rev, spend = f"cur_{c}_revenue", ads.get(c)
        out.append({
            "channel": f"'{c}'", "revenue": rev, "margin_pct": margin("cur", c),
            "order_share": pos(f"cur_{c}_orders", orders("cur"), 100), "revenue_change": f"ROUND({rev} - prev_{c}_revenue, 2)",
            "ad_spend": spend or N, "roas": pos(rev, spend) if spend else N,
            "future_revenue": "cur_wholesale_future_revenue" if c == "wholesale" else N})
    return union(TOTALS, "t", out)


@query("channel_efficiency", _sql_efficiency())
def channel_efficiency(f):
    return kpi.channel_efficiency(pairs(f))


def _sql_alerts():
    out = []
    for c, limit, severity, metric in kpi.ALERT_RULES:
        cvr = {p: pos(f"{p}_{c}_orders", f"{p}_{c}_sessions", 100) for p in ("cur", "prev")}
        change = f"ROUND({cvr['cur']} - {cvr['prev']}, 4)"
        out.append({
            "channel": f"'{c}'", "cvr": cvr["cur"], "previous_cvr": cvr["prev"], "cvr_change": change,
            "severity": f"'{severity}'", "metric": f"'{metric}'", "raised": f"{change} <= {limit}"})
    return union(TOTALS, "t", out)


@query("cvr_alerts", _sql_alerts())
def cvr_alerts(f):
    return kpi.cvr_alerts(pairs(f), only_raised=False)


def _sql_wow():
    cols = [f"{c}_{m}" for c, *_ in kpi.ALERT_RULES for m in ("orders", "sessions")]
    lag = ", ".join(f"lag({c}) OVER (ORDER BY bucket_start) AS prev_{c}" for c in cols)
    head = f"{MART}, l AS (SELECT *, {lag} FROM mart), n AS (SELECT * FROM l ORDER BY bucket_start DESC LIMIT 1)"
    out = []
    for c, limit, severity, metric in kpi.ALERT_RULES:
        cvr = {p: f"CASE WHEN {p}{c}_sessions <> 0 THEN {sql_ratio(f'{p}{c}_orders', f'{p}{c}_sessions', 100, 4)} ELSE 0.0 END"
               for p in ("", "prev_")}
        change = f"ROUND({cvr['']} - {cvr['prev_']}, 4)"
        out.append({"bucket_start": "bucket_start", "channel": f"'{c}'", "cvr": cvr[""], "cvr_change": change,
                    "severity": f"'{severity}'", "metric": f"'{metric}'", "raised": f"{change} <= {limit}"})
    return union(head, "n", out)


@query("wow_cvr_alert", _sql_wow())
def wow_cvr_alert(f):
    cols = [f"{c}_{m}" for c, *_ in kpi.ALERT_RULES for m in ("orders", "sessions")]
    return kpi.latest_week_alerts(compare.with_previous(mart(f).select("bucket_start", *cols), cols))


@query("marketing_breakdown", union(TOTALS, "t", [
    {"source": "'organic'", "amount": "cur_organic_revenue", "sessions": "cur_organic_sessions"},
    {"source": "'paid marketplace'", "amount": "cur_marketplace_ad_spend", "sessions": N}]))
def marketing_breakdown(f):
    return kpi.marketing_breakdown(pairs(f))


def _sql_by_channel():
    out = []
    for c in kpi.CHANNELS:
        m = c == "marketplace"
        vals = {"gross_revenue": "cur_marketplace_revenue" if m else N, "net_revenue": f"cur_{c}_revenue",
                "gross_profit": profit("cur", c), "contribution_margin": margin("cur", c), "orders": f"cur_{c}_orders",
                "aov": pos(f"cur_{c}_revenue", f"cur_{c}_orders"), "units": "cur_marketplace_units" if m else N}
        out += [{"channel": f"'{c}'", "metric": f"'{k}'", "value": v} for k, v in vals.items()]
    return union(TOTALS, "t", out)


@query("metric_by_channel", _sql_by_channel())
def metric_by_channel(f):
    return kpi.metric_by_channel(pairs(f))


@query("channel_mix", f"WITH {MART} " + " UNION ALL ".join(
    f"SELECT bucket_start, '{c}' AS channel, {c}_revenue AS revenue FROM mart" for c in kpi.CHANNELS))
def channel_mix(f):
    return kpi.channel_mix(mart(f))


# ------------------------------------------------------------------------ P&L
PL = f"pl AS ({sql_pl()})"


def pl(f):
    return marts.pl_monthly(inputs(f), AS_OF)


@query("trailing_12", f"""WITH {PL} SELECT month, CAST(SUM(CAST(net_sales AS DECIMAL(28,2))) OVER w AS DOUBLE) AS t12_net_sales,
    CAST(SUM(CAST(cogs AS DECIMAL(28,2))) OVER w AS DOUBLE) AS t12_cogs FROM pl
    WINDOW w AS (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def trailing_12(f):
    return compare.trailing_sum(pl(f), ["net_sales", "cogs"], "month").select("month", "t12_net_sales", "t12_cogs")


def _sql_variance():
    out = []
    for label, col, is_cost in kpi.PL_LINES:
        shape = "abs" if col in ("returns", "marketplace_fees") else ""
        cur, prev = f"{shape}(c.{col})", f"{shape}(p.{col})"
        delta = f"ROUND({cur} - {prev}, 2)"
        out.append({"line": f"'{label}'", "current": cur, "prior_year": prev, "delta": delta,
                    "delta_pct": sql_ratio(delta, f"abs({prev})", 100, 1), "favorable": f"{delta} {'<' if is_cost else '>'} 0"})
    return union(PL, "(SELECT * FROM pl ORDER BY month DESC LIMIT 1) c LEFT JOIN pl p ON p.month = '2000-07'", out)


@query("pl_variance", _sql_variance())
def pl_variance(f):
    return kpi.pl_variance(pl(f))


_NEWEST = "(SELECT * FROM pl ORDER BY month DESC LIMIT 1) m"


@query("pl_waterfall", union(PL, _NEWEST, [
    {"step": i + 1, "label": f"'{n}'", "start": f"ROUND({a}, 2)", '"end"': f"ROUND({b}, 2)"} for i, (n, a, b) in enumerate((
        ("Gross Sales", "CAST(0 AS DOUBLE)", "gross_sales"), ("Returns", "gross_sales + returns", "gross_sales"),
        ("Net Sales", "CAST(0 AS DOUBLE)", "net_sales"), ("COGS", "net_sales - cogs", "net_sales"),
        ("Gross Profit", "CAST(0 AS DOUBLE)", "gross_profit"),
        ("Marketplace Fees", "gross_profit - abs(marketplace_fees)", "gross_profit"),
        ("Ad Spend", "gross_profit - abs(marketplace_fees) - ad_spend", "gross_profit - abs(marketplace_fees)"),
        ("Contribution", "CAST(0 AS DOUBLE)", "contribution_profit")))]))
def pl_waterfall(f):
    return kpi.pl_waterfall(pl(f))


@query("pl_channel_stack", union(PL, _NEWEST, [
    {"channel": f"'{c}'", "component": f"'{n}'", "amount": v if n == "Revenue" else f"0 - {v}"}
    for c, vals in {
        "marketplace": ("marketplace_gross_sales", "marketplace_cogs", "abs(marketplace_fees)", "marketplace_ad_spend"),
        "storefront": ("storefront_revenue", "storefront_cogs", "CAST(0 AS DOUBLE)", "search_ad_spend"),
        "wholesale": ("wholesale_revenue", "wholesale_cogs", "CAST(0 AS DOUBLE)", "CAST(0 AS DOUBLE)")}.items()
    for n, v in zip(("Revenue", "COGS", "Fees", "Ad Spend"), vals)]))
def pl_channel_stack(f):
    return kpi.pl_channel_stack(pl(f))


@query("margin_trend", f"WITH {PL} SELECT month, gross_margin_pct, contribution_margin_pct FROM pl ORDER BY month DESC LIMIT 12")
def margin_trend(f):
    return kpi.margin_trend(pl(f))


# --------------------------------------------------------------------- checks
@query("mart_checks", f"""WITH {MART} SELECT year, CAST(COUNT(*) AS BIGINT) AS buckets,
      CAST(SUM(CAST(marketplace_net_proceeds AS DECIMAL(28,2))) AS DOUBLE) AS net_proceeds,
      SUM(CAST(marketplace_net_proceeds AS DECIMAL(28,2))) > 0 AS net_positive,
      bool_and(abs(total_ad_spend - (marketplace_ad_spend + search_ad_spend)) < 0.01) AS ads_add_up
    FROM mart GROUP BY 1""")
def mart_checks(f):
    net = F.sum(F.col("marketplace_net_proceeds").cast("decimal(28,2)"))
    gap = F.abs(F.col("total_ad_spend") - (F.col("marketplace_ad_spend") + F.col("search_ad_spend")))
    return mart(f).groupBy("year").agg(
        F.count("*").alias("buckets"),
        net.cast("double").alias("net_proceeds"),
        (net > 0).alias("net_positive"),
        F.bool_and(gap < 0.01).alias("ads_add_up"),
    )


@query("source_reconcile", """SELECT * FROM (SELECT CAST(SUM(gross_sales) AS DOUBLE) AS economics_sales, CAST(SUM(units) AS BIGINT) AS economics_units
      FROM v_sku_day WHERE business_date BETWEEN DATE '2001-06-19' AND DATE '2001-07-18') a
    CROSS JOIN (SELECT CAST(SUM(ordered_sales) AS DOUBLE) AS traffic_sales, CAST(SUM(units_ordered) AS BIGINT) AS traffic_units
      FROM v_traffic WHERE report_date BETWEEN DATE '2001-06-19' AND DATE '2001-07-18') b""")
def source_reconcile(f):
    """Two one-row totals side by side, through one tagged aggregate."""
    lo, hi = compare.range_bounds("last30", AS_OF)
    econ = ch.between_days(f.sku_day, "business_date", lo, hi).agg(
        F.sum("gross_sales").cast("double").alias("economics_sales"), F.sum("units").alias("economics_units")
    )
    traffic = ch.between_days(f.traffic, "report_date", lo, hi).agg(
        F.sum("ordered_sales").cast("double").alias("traffic_sales"), F.sum("units_ordered").alias("traffic_units")
    )
    return ch.combine([econ.withColumn("_k", F.lit(0)), traffic.withColumn("_k", F.lit(0))], ["_k"]).drop("_k")
