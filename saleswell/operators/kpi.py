"""KPI totals, bridges, alerts and breakdowns over paired periods.

Input rows carry ``cur_*`` and ``prev_*`` mart metrics (see ``compare``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from saleswell import config
from saleswell.functions.numeric import ratio

CHANNELS = ("storefront", "marketplace", "wholesale")
SUMMED = (
    "storefront_revenue marketplace_revenue wholesale_revenue marketplace_net_proceeds storefront_orders "
    "marketplace_orders wholesale_orders company_revenue estimated_profit storefront_cogs marketplace_cogs "
    "wholesale_cogs marketplace_units storefront_sessions marketplace_sessions organic_sessions organic_users "
    "organic_revenue total_ad_spend marketplace_ad_spend search_ad_spend wholesale_future_revenue"
).split()


def period_totals(pairs: DataFrame) -> DataFrame:
    """One row: every metric summed for the current and the comparison period."""
    exact = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(28,2)")), F.lit(0)).cast("double").alias(c)
    return pairs.agg(*[exact(f"{p}_{m}") for p in ("cur", "prev") for m in SUMMED])


def _positive(num: Column, den: Column, scale: float = 1.0, other: Column | None = None) -> Column:
    """Ratio when the denominator is positive, otherwise ``other`` (zero by default)."""
    return F.when(den > 0, ratio(num, den, scale, 4)).otherwise(F.lit(0.0) if other is None else other)


def _profit(p: str, channel: str) -> Column:
    """Channel profit; the marketplace counts net proceeds, not gross sales."""
    income = "marketplace_net_proceeds" if channel == "marketplace" else f"{channel}_revenue"
    return F.round(F.col(f"{p}_{income}") - F.col(f"{p}_{channel}_cogs"), 2)


def _total_orders(p: str) -> Column:
    return sum((F.col(f"{p}_{c}_orders") for c in CHANNELS), F.lit(0.0))


def _margin(p: str, channel: str) -> Column:
    return _positive(_profit(p, channel), F.col(f"{p}_{channel}_revenue"), 100.0, F.lit(None).cast("double"))


def selected_metrics(p: str, channel: str) -> dict[str, Column]:
    """The KPI cards of one channel view; cards that do not apply are NULL."""
    none = F.lit(None).cast("double")
    c = lambda m: F.col(f"{p}_{m}")
    if channel == "all":
        orders = _total_orders(p)
        return {
            "total_revenue": none, "gross_revenue": none, "net_revenue": c("company_revenue"),
            "gross_profit": c("estimated_profit"),
            "contribution_margin": _positive(c("estimated_profit"), c("company_revenue"), 100.0),
            "orders": orders, "aov": _positive(c("company_revenue"), orders), "units": c("marketplace_units"),
            "marketing_spend": c("total_ad_spend"), "mer": _positive(c("company_revenue"), c("total_ad_spend")),
            "future_revenue": none,
        }
    orders, revenue = c(f"{channel}_orders"), c(f"{channel}_revenue")
    out = {
        "total_revenue": none, "gross_revenue": none, "net_revenue": revenue, "gross_profit": _profit(p, channel),
        "contribution_margin": _margin(p, channel), "orders": orders, "aov": _positive(revenue, orders),
        "units": none, "marketing_spend": none, "mer": none, "future_revenue": none,
    }
    if channel == "marketplace":
        out.update(
            gross_revenue=revenue, units=c("marketplace_units"), marketing_spend=c("total_ad_spend"),
            mer=_positive(c("company_revenue"), c("total_ad_spend")),
        )
    if channel == "wholesale":
        future = c("wholesale_future_revenue")
        out.update(total_revenue=F.round(revenue + future, 2), future_revenue=future)
    return out


def _rows(totals: DataFrame, records: list[dict[str, Column]]) -> DataFrame:
    """Several named records out of the one totals row."""
    structs = [F.struct(*[v.alias(k) for k, v in r.items()]) for r in records]
    return totals.select(F.inline(F.array(*structs)))


def kpi_totals(pairs: DataFrame) -> DataFrame:
    """KPI cards per channel view for both periods."""
    records = [
        {"period": F.lit(label), "channel": F.lit(ch), **selected_metrics(p, ch)}
        for p, label in (("cur", "current"), ("prev", "previous"))
        for ch in ("all", *CHANNELS)
    ]
    return _rows(period_totals(pairs), records)


def price_volume_mix(pairs: DataFrame) -> DataFrame:
    """Split each channel view's revenue change into volume, price and mix."""
    totals = period_totals(pairs)
    records = []
    for ch in ("all", *CHANNELS):
        cur, prev = selected_metrics("cur", ch), selected_metrics("prev", ch)
        aov = lambda m: F.when(m["orders"] != 0, F.try_divide(m["net_revenue"], m["orders"])).otherwise(0.0)
        delta = cur["net_revenue"] - prev["net_revenue"]
        volume = (cur["orders"] - prev["orders"]) * aov(prev)
        price = (aov(cur) - aov(prev)) * prev["orders"]
        records.append({
            "channel": F.lit(ch),
            "volume_effect": F.round(volume, 2), "price_effect": F.round(price, 2),
            "mix_effect": F.round(delta - volume - price, 2), "revenue_change": F.round(delta, 2),
            "profit_change": F.round(cur["gross_profit"] - prev["gross_profit"], 2),
        })
    return _rows(totals, records)


def channel_efficiency(pairs: DataFrame) -> DataFrame:
    none = F.lit(None).cast("double")
    ads = {"storefront": "search_ad_spend", "marketplace": "marketplace_ad_spend"}
    records = []
    for ch in CHANNELS:
        revenue = F.col(f"cur_{ch}_revenue")
        spend = F.col(f"cur_{ads[ch]}") if ch in ads else none
        records.append({
            "channel": F.lit(ch), "revenue": revenue, "margin_pct": _margin("cur", ch),
            "order_share": _positive(F.col(f"cur_{ch}_orders"), _total_orders("cur"), 100.0),
            "revenue_change": F.round(revenue - F.col(f"prev_{ch}_revenue"), 2),
            "ad_spend": spend, "roas": _positive(revenue, spend) if ch in ads else none,
            "future_revenue": F.col("cur_wholesale_future_revenue") if ch == "wholesale" else none,
        })
    return _rows(period_totals(pairs), records)


# Which alert each channel raises.
ALERT_RULES = (
    ("marketplace", config.MARKETPLACE_CVR_DROP, "critical", "units"),
    ("storefront", config.STOREFRONT_CVR_DROP, "warning", "orders"),
)


def conversion(p: str, channel: str) -> Column:
    return _positive(F.col(f"{p}_{channel}_orders"), F.col(f"{p}_{channel}_sessions"), 100.0)


def cvr_alerts(pairs: DataFrame, only_raised: bool = True) -> DataFrame:
    """Conversion drops against the comparison period that pass the threshold."""
    records = []
    for ch, limit, severity, metric in ALERT_RULES:
        cur, prev = conversion("cur", ch), conversion("prev", ch)
        records.append({
            "channel": F.lit(ch), "cvr": cur, "previous_cvr": prev, "cvr_change": F.round(cur - prev, 4),
            "severity": F.lit(severity), "metric": F.lit(metric), "raised": F.round(cur - prev, 4) <= F.lit(limit),
        })
    rows = _rows(period_totals(pairs), records)
    return rows.where("raised") if only_raised else rows


def latest_week_alerts(mart_with_previous: DataFrame) -> DataFrame:
    """The same thresholds for the newest bucket against the one before it."""
    newest = mart_with_previous.orderBy(F.desc("bucket_start")).limit(1)
    records = []
    cvr = lambda pre, ch: F.when(
        F.col(f"{pre}{ch}_sessions") != 0, ratio(F.col(f"{pre}{ch}_orders"), F.col(f"{pre}{ch}_sessions"), 100.0, 4)
    ).otherwise(0.0)
    for ch, limit, severity, metric in ALERT_RULES:
        change = F.round(cvr("", ch) - cvr("prev_", ch), 4)
        records.append({
            "bucket_start": F.col("bucket_start"), "channel": F.lit(ch), "cvr": cvr("", ch),
            "cvr_change": change, "severity": F.lit(severity), "metric": F.lit(metric),
            "raised": change <= F.lit(limit),
        })
    return _rows(newest, records)


def marketing_breakdown(pairs: DataFrame) -> DataFrame:
    none = F.lit(None).cast("double")
    return _rows(period_totals(pairs), [
        {"source": F.lit("organic"), "amount": F.col("cur_organic_revenue"), "sessions": F.col("cur_organic_sessions")},
        {"source": F.lit("paid marketplace"), "amount": F.col("cur_marketplace_ad_spend"), "sessions": none},
    ])


def metric_by_channel(pairs: DataFrame) -> DataFrame:
    """Long form: channel, metric, value; NULL where a metric does not apply."""
    none = F.lit(None).cast("double")
    records = []
    for ch in CHANNELS:
        market = ch == "marketplace"
        values = {
            "gross_revenue": F.col("cur_marketplace_revenue") if market else none,
            "net_revenue": F.col(f"cur_{ch}_revenue"),
            "gross_profit": _profit("cur", ch),
            "contribution_margin": _margin("cur", ch),
            "orders": F.col(f"cur_{ch}_orders"),
            "aov": _positive(F.col(f"cur_{ch}_revenue"), F.col(f"cur_{ch}_orders")),
            "units": F.col("cur_marketplace_units") if market else none,
        }
        records += [{"channel": F.lit(ch), "metric": F.lit(k), "value": v} for k, v in values.items()]
    return _rows(period_totals(pairs), records)


def channel_mix(mart: DataFrame) -> DataFrame:
    """Revenue series per channel in long form."""
    return mart.unpivot(
        ["bucket_start"], [F.col(f"{c}_revenue").alias(c) for c in CHANNELS], "channel", "revenue"
    )


def ranked_drivers(drivers: DataFrame, k: int = 5) -> DataFrame:
    """Strongest ``k`` rises and ``k`` falls of ``label, delta`` rows.

    Two top-k selections, each kept small per partition before they meet.
    """
    up = drivers.where(F.col("delta") >= 0).orderBy(F.desc("delta"), "label").limit(k)
    down = drivers.where(F.col("delta") < 0).orderBy("delta", "label").limit(k)
    return up.withColumn("direction", F.lit("positive")).unionByName(down.withColumn("direction", F.lit("negative")))


# ------------------------------------------------------------------------- P&L
PL_LINES = (
    # fixed values: label, column, lower is better
    ("Gross Sales", "gross_sales", False),
    ("Returns", "returns", True),
    ("Net Sales", "net_sales", False),
    ("COGS", "cogs", True),
    ("Gross Profit", "gross_profit", False),
    ("Marketplace Fees", "marketplace_fees", True),
    ("Ad Spend", "ad_spend", True),
    ("Contribution Profit", "contribution_profit", False),
)
_SHOWN_ABSOLUTE = ("returns", "marketplace_fees")


def pl_variance(pl: DataFrame) -> DataFrame:
    """Newest month against the same month a year earlier, line by line."""
    lines = [c for _, c, _ in PL_LINES]
    newest = pl.agg(F.max(F.struct("month", *lines)).alias("cur"), F.collect_list(F.struct("month", *lines)).alias("all"))
    wanted = F.concat(
        (F.substring("cur.month", 1, 4).cast("int") - 1).cast("string"), F.substring("cur.month", 5, 3)
    )
    paired = newest.select("cur", F.get(F.filter("all", lambda m: m["month"] == wanted), F.lit(0)).alias("prev"))
    records = []
    for label, col, is_cost in PL_LINES:
        shape = F.abs if col in _SHOWN_ABSOLUTE else (lambda x: x)
        cur, prev = shape(F.col(f"cur.{col}")), shape(F.col(f"prev.{col}"))
        delta = F.round(cur - prev, 2)
        records.append({
            "line": F.lit(label), "current": cur, "prior_year": prev, "delta": delta,
            "delta_pct": ratio(delta, F.abs(prev), 100.0, 1),
            "favorable": (delta < 0) if is_cost else (delta > 0),
        })
    return _rows(paired, records)


def pl_waterfall(pl: DataFrame) -> DataFrame:
    """Bridge of the newest month: each bar from ``start`` to ``end``."""
    m = pl.orderBy(F.desc("month")).limit(1)
    c = F.col
    fees = F.abs(c("marketplace_fees"))
    bars = (
        ("Gross Sales", F.lit(0.0), c("gross_sales")),
        ("Returns", c("gross_sales") + c("returns"), c("gross_sales")),
        ("Net Sales", F.lit(0.0), c("net_sales")),
        ("COGS", c("net_sales") - c("cogs"), c("net_sales")),
        ("Gross Profit", F.lit(0.0), c("gross_profit")),
        ("Marketplace Fees", c("gross_profit") - fees, c("gross_profit")),
        ("Ad Spend", c("gross_profit") - fees - c("ad_spend"), c("gross_profit") - fees),
        ("Contribution", F.lit(0.0), c("contribution_profit")),
    )
    return _rows(m, [
        {"step": F.lit(i + 1), "label": F.lit(n), "start": F.round(a, 2), "end": F.round(b, 2)}
        for i, (n, a, b) in enumerate(bars)
    ])


def pl_channel_stack(pl: DataFrame) -> DataFrame:
    """Newest month: revenue up, costs down, per channel."""
    m = pl.orderBy(F.desc("month")).limit(1)
    zero = F.lit(0.0)
    c = F.col
    stack = {
        "marketplace": (c("marketplace_gross_sales"), c("marketplace_cogs"), F.abs(c("marketplace_fees")), c("marketplace_ad_spend")),
        "storefront": (c("storefront_revenue"), c("storefront_cogs"), zero, c("search_ad_spend")),
        "wholesale": (c("wholesale_revenue"), c("wholesale_cogs"), zero, zero),
    }
    return _rows(m, [
        {"channel": F.lit(ch), "component": F.lit(name), "amount": value if name == "Revenue" else zero - value}
        for ch, values in stack.items()
        for name, value in zip(("Revenue", "COGS", "Fees", "Ad Spend"), values)
    ])


def margin_trend(pl: DataFrame, months: int = 12) -> DataFrame:
    return pl.orderBy(F.desc("month")).limit(months).select("month", "gross_margin_pct", "contribution_margin_pct")
