"""Registered queries: SKU, category, customer and report analytics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from saleswell.functions.keys import canonical_sku, has_prefix
from saleswell.functions.numeric import as_double
from saleswell.operators import channels as ch, compare, kpi, sku
from saleswell.operators.settlements import unpivot
from saleswell.plans.queries_channels import AS_OF, inputs, sql_settlement
from saleswell.plans.queries_kpi import pairs, TOTALS
from saleswell.plans.registry import query, sql_ratio, sql_round

CUR = (dt.date(2000, 1, 1), dt.date(2000, 12, 31))
PREV = (dt.date(1999, 1, 1), dt.date(1999, 12, 31))
PERIODS = {"current": CUR, "previous": PREV}
SINCE = dt.date(1999, 7, 19)
_C, _P = [f"BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in (CUR, PREV)]
_S = f"DATE '{SINCE}'"
_U = f"DATE '{AS_OF}'"
_SKU = "upper(trim(coalesce(nullif(v.variant_sku, ''), nullif(p.product_name, ''), nullif(p.sku, ''))))"
_QTY = "CAST(li.quantity AS DECIMAL(12,0))"


def d2(e):
    return f"CAST(ROUND({e}, 2) AS DOUBLE)"


def sql_sales(name: str, span: str) -> str:
    """CTE body: SKU sales of the three channels in one period."""
    def part(channel, statuses, first, second):
        costs = {"line": f"WHEN li.base_cost_price > 0 THEN li.base_cost_price * {_QTY}",
                 "dim": f"WHEN c.cost_per_unit IS NOT NULL THEN c.cost_per_unit * {_QTY}"}
        return f"""SELECT '{channel}' AS channel, {_SKU} AS sku, SUM(li.total_ex_tax) AS revenue, SUM(li.quantity) AS units,
            SUM(CASE {costs[first]} {costs[second]} ELSE 0 END) AS cogs
          FROM v_line li JOIN v_order o ON o.order_id = li.order_id LEFT JOIN v_product p ON p.product_id = li.product_id
          LEFT JOIN v_variant v ON v.variant_id = li.variant_id AND v.product_id = li.product_id
          LEFT JOIN v_cost c ON {_SKU} = upper(trim(c.msku))
          WHERE o.channel = '{channel}' AND o.order_date {span} AND o.status IN ({statuses}) GROUP BY 1, 2"""
    market = f"""SELECT 'marketplace', upper(trim(a.msku)), SUM(a.gross_sales), SUM(a.units),
            SUM(CASE WHEN c.cost_per_unit IS NOT NULL THEN c.cost_per_unit * CAST(a.units AS DECIMAL(12,0)) ELSE 0 END)
          FROM v_sku_day a LEFT JOIN v_cost c ON upper(trim(a.msku)) = upper(trim(c.msku)) WHERE a.business_date {span} GROUP BY 1, 2"""
    return f"""{name} AS (SELECT sku, SUM(revenue) AS revenue, CAST(SUM(units) AS BIGINT) AS units, SUM(cogs) AS cogs,
          CAST(COUNT(DISTINCT channel) AS BIGINT) AS channel_count
        FROM ({part('storefront', '2, 10, 11, 3', 'line', 'dim')} UNION ALL {market}
              UNION ALL {part('wholesale', '2, 10', 'dim', 'line')}) u
        WHERE sku IS NOT NULL AND sku <> '' GROUP BY 1)"""


def sales(f, channel="all", periods=PERIODS):
    return sku.sales_by_sku(inputs(f), f.variant, periods, channel)


def shown(df):
    return df.select("period", "sku", as_double(F.col("revenue")).alias("revenue"), F.col("units").cast("bigint").alias("units"),
                     as_double(F.col("cogs")).alias("cogs"), "channel_count")


@query("sales_by_sku", f"""WITH {sql_sales('c', _C)}, {sql_sales('p', _P)}
    SELECT 'current' AS period, sku, {d2('revenue')} AS revenue, units, {d2('cogs')} AS cogs, channel_count FROM c
    UNION ALL SELECT 'previous', sku, {d2('revenue')}, units, {d2('cogs')}, channel_count FROM p""")
def sales_by_sku(f):
    return shown(sales(f))


@query("channel_filter", f"""SELECT 'marketplace' AS asked, 'current' AS period, upper(trim(a.msku)) AS sku, {d2('SUM(a.gross_sales)')} AS revenue
    FROM v_sku_day a LEFT JOIN v_cost c ON upper(trim(a.msku)) = upper(trim(c.msku)) WHERE a.business_date {_C} GROUP BY 3""")
def channel_filter(f):
    """An asked channel without rows ('retail') adds nothing to the union."""
    rows = [
        sales(f, c, {"current": CUR}).select(
            F.lit(c).alias("asked"), "period", "sku", as_double(F.col("revenue")).alias("revenue"))
        for c in ("marketplace", "retail")
    ]
    return rows[0].unionByName(rows[1])


_MAP = "m AS (SELECT upper(trim(sku)) AS sku, max(category) AS category FROM v_sku_category GROUP BY 1)"
_CATS = f"""{sql_sales('c', _C)}, {sql_sales('p', _P)}, {_MAP},
  j AS (SELECT category, 'c' AS k, revenue, units, cogs FROM c JOIN m USING (sku)
        UNION ALL SELECT category, 'p', revenue, units, cogs FROM p JOIN m USING (sku)),
  a AS (SELECT category, {', '.join(f"SUM(CASE WHEN k = '{k}' THEN {m} ELSE 0 END) AS {pre}{m}" for k, pre in (('c', ''), ('p', 'previous_')) for m in ('revenue', 'units', 'cogs'))},
        COUNT(*) FILTER (k = 'c') AS sku_count, COUNT(*) FILTER (k = 'p') AS previous_sku_count FROM j GROUP BY 1),
  cats AS (SELECT category, sku_count, previous_sku_count,
        {', '.join(f"{d2(pre + m)} AS {pre}{m}" for pre in ('', 'previous_') for m in ('revenue', 'units', 'cogs'))},
        {d2('revenue - cogs')} AS profit, {d2('previous_revenue - previous_cogs')} AS previous_profit,
        {sql_ratio('(revenue - cogs)', 'revenue', 100, 1)} AS gm_pct, {d2('revenue - previous_revenue')} AS delta,
        {sql_ratio('(revenue - previous_revenue)', 'abs(previous_revenue)', 100, 1)} AS delta_pct FROM a)"""


def cats(f):
    return sku.category_totals(sales(f), sku.category_map(f.sku_category))


@query("top_categories", f"WITH {_CATS} SELECT * FROM cats ORDER BY revenue DESC, category LIMIT 8")
def top_categories(f):
    return sku.top_categories(cats(f))


@query("category_movers", f"""WITH {_CATS} (SELECT 'positive' AS direction, category, delta FROM cats WHERE delta > 0 ORDER BY delta DESC, category LIMIT 1)
    UNION ALL (SELECT 'negative', category, delta FROM cats WHERE delta < 0 ORDER BY delta, category LIMIT 1)""")
def category_movers(f):
    return sku.category_movers(cats(f))


@query("category_coverage", f"""WITH {sql_sales('c', _C)}, {_MAP}, j AS (SELECT c.revenue, m.category FROM c LEFT JOIN m USING (sku)),
    s AS (SELECT COUNT(*) AS n, COUNT(category) AS k, SUM(revenue) AS t, SUM(CASE WHEN category IS NOT NULL THEN revenue ELSE 0 END) AS m FROM j)
    SELECT n AS total_skus, k AS matched_skus, n - k AS unmapped_skus, {d2('t')} AS total_revenue, {d2('m')} AS matched_revenue,
      {d2('t - m')} AS unmapped_revenue, coalesce({sql_ratio('m', 't', 100, 1)}, 0) AS matched_revenue_pct FROM s""")
def category_coverage(f):
    return sku.category_coverage(sales(f, periods={"current": CUR}), sku.category_map(f.sku_category))


@query("category_rename", """SELECT CASE category WHEN 'Brand#1' THEN 'Brand#10' WHEN 'Brand#11' THEN 'Brand#12' ELSE category END AS category,
    CAST(COUNT(*) AS BIGINT) AS skus FROM v_sku_category GROUP BY 1""")
def category_rename(f):
    renames = f.spark.createDataFrame([("Brand#1", "Brand#10"), ("Brand#11", "Brand#12")], "old_name string, new_name string")
    return sku.rename_categories(f.sku_category, renames).groupBy("category").agg(F.count("*").alias("skus"))


_NOT_WEB = "p.sku <> '' AND NOT (lower(p.sku) LIKE 'web%' OR lower(p.sku) LIKE 'tweb%')"
_TOPSKU = f"""SELECT p.sku, p.product_name, CAST(SUM(li.quantity) AS BIGINT) AS units, SUM(li.total_ex_tax) AS revenue
    FROM v_line li JOIN v_order o ON o.order_id = li.order_id JOIN v_product p ON p.product_id = li.product_id
    WHERE o.channel = 'storefront' AND o.order_date {{span}} AND o.status IN (2, 10, 11, 3) AND {_NOT_WEB} GROUP BY 1, 2"""


@query("top_sku", f"SELECT sku, product_name, units, CAST(revenue AS DOUBLE) AS revenue FROM ({_TOPSKU.format(span=_C)}) q ORDER BY revenue DESC, sku LIMIT 1")
def top_sku(f):
    x = inputs(f)
    out = sku.top_sku(x.storefront_lines, x.storefront_orders, f.product, CUR)
    return out.withColumns({"revenue": as_double(F.col("revenue")), "units": F.col("units").cast("bigint")})


@query("top_sku_compare", f"""WITH a AS (SELECT * FROM ({_TOPSKU.format(span=_C)}) q ORDER BY revenue DESC, sku LIMIT 1),
      b AS ({_TOPSKU.format(span=_P)})
    SELECT a.sku, a.product_name, {d2('a.revenue')} AS current_revenue, {d2('coalesce(b.revenue, 0)')} AS previous_revenue,
      a.units AS current_units, coalesce(b.units, 0) AS previous_units FROM a LEFT JOIN b ON b.sku = a.sku""")
def top_sku_compare(f):
    x = inputs(f)
    return sku.top_sku_compare(x.storefront_lines, x.storefront_orders, f.product, CUR, PREV)


@query("top_skus_channel", f"""(SELECT 'storefront' AS channel, sku, product_name, units, {d2('revenue')} AS revenue FROM ({_TOPSKU.format(span=_C)}) q ORDER BY q.revenue DESC, sku LIMIT 5)
    UNION ALL (SELECT 'marketplace', msku, msku, CAST(SUM(units_ordered) AS BIGINT), {d2('SUM(ordered_sales)')} FROM v_traffic WHERE report_date {_C}
      GROUP BY msku ORDER BY SUM(ordered_sales) DESC, msku LIMIT 5)""")
def top_skus_channel(f):
    x = inputs(f)
    return sku.top_skus_per_channel(x.storefront_lines, x.storefront_orders, f.product, f.traffic, CUR)


@query("sku_variations", f"""SELECT li.product_id, li.variant_id, coalesce(v.variant_sku, 'No SKU') AS sku, CAST(SUM(li.quantity) AS BIGINT) AS units,
      {d2('SUM(li.total_ex_tax)')} AS revenue
    FROM v_line li LEFT JOIN v_variant v ON v.variant_id = li.variant_id
    WHERE li.product_id IN (SELECT product_id FROM v_product WHERE product_type = 'PROMO') AND EXISTS (SELECT 1 FROM v_order o
      WHERE o.order_id = li.order_id AND o.channel = 'storefront' AND o.order_date {_C} AND o.status IN (2, 10)) GROUP BY 1, 2, 3""")
def sku_variations(f):
    x = inputs(f)
    wanted = f.product.where("product_type = 'PROMO'")
    return sku.sku_variations(x.storefront_lines, x.storefront_orders, f.variant, wanted, CUR)


@query("top_wholesale_customers", f"""WITH k AS (SELECT coalesce(nullif(company, ''), full_name) AS company_name, full_name, order_id, status, sub_total
      FROM v_order LEFT JOIN v_billing USING (order_id) WHERE channel = 'wholesale' AND status NOT IN (0, 5, 6) AND order_date >= DATE '1999-01-01'),
    n AS (SELECT company_name, string_agg(full_name, ', ' ORDER BY full_name) AS customer_name FROM (SELECT DISTINCT company_name, full_name FROM k) q GROUP BY 1),
    s AS (SELECT company_name, CAST(COUNT(DISTINCT order_id) AS BIGINT) AS total_orders, SUM(CASE WHEN status IN (2, 10) THEN sub_total ELSE 0 END) AS r,
      SUM(CASE WHEN status IN (8, 11) THEN sub_total ELSE 0 END) AS f FROM k GROUP BY 1)
    SELECT company_name, customer_name, total_orders, {d2('r')} AS total_revenue, {d2('f')} AS future_revenue FROM s JOIN n USING (company_name)
    ORDER BY r + f DESC, company_name LIMIT 20""")
def top_wholesale_customers(f):
    return sku.top_customers(inputs(f).wholesale_orders, f.billing, dt.date(1999, 1, 1))


def _sql_drivers():
    chans = " UNION ALL ".join(
        f"SELECT '{c}' AS label, ROUND(cur_{c}_revenue - prev_{c}_revenue, 2) AS delta FROM t" for c in kpi.CHANNELS)
    return f"""{TOTALS}, {_CATS}, drv AS ({chans} UNION ALL SELECT 'category ' || category, delta FROM cats)
      (SELECT label, delta, 'positive' AS direction FROM drv WHERE delta >= 0 ORDER BY delta DESC, label LIMIT 5)
      UNION ALL (SELECT label, delta, 'negative' FROM drv WHERE delta < 0 ORDER BY delta, label LIMIT 5)"""


@query("revenue_drivers", "WITH " + _sql_drivers())
def revenue_drivers(f):
    totals = kpi.period_totals(pairs(f))
    rows = [
        F.struct(F.lit(c).alias("label"), F.round(F.col(f"cur_{c}_revenue") - F.col(f"prev_{c}_revenue"), 2).alias("delta"))
        for c in kpi.CHANNELS
    ]
    by_category = cats(f).select(F.concat(F.lit("category "), "category").alias("label"), "delta")
    return kpi.ranked_drivers(totals.select(F.inline(F.array(*rows))).unionByName(by_category))


# ------------------------------------------------------------------- SKU report
_PFX = lambda c: "(" + " OR ".join(f"lower({c}) LIKE '{p}%'" for p in ("btkn", "bta", "btc", "btd", "tr-", "trk-")) + ")"
_VS = "coalesce(v.variant_sku, p.sku)"
_ALIAS = "al AS (SELECT lower(sku) || '-m' AS raw, lower(sku) AS canonical FROM v_product WHERE product_id % 10 = 3)"
_LINES = """v_line li JOIN v_order o ON o.order_id = li.order_id JOIN v_product p ON p.product_id = li.product_id
      LEFT JOIN v_variant v ON v.variant_id = li.variant_id AND v.product_id = li.product_id"""
_SETTLED = """st AS (SELECT order_id, sku, transaction_type, coalesce(try_cast(substr(coalesce(nullif(posted_date, ''), posted_date_time), 1, 10) AS DATE),
      CAST(try_strptime(posted_date, '%d.%m.%Y') AS DATE)) AS posted FROM v_settle_wide
      WHERE try_cast(CASE WHEN quantity_purchased = '' THEN '0' ELSE quantity_purchased END AS BIGINT) IS NOT NULL
        AND (coalesce(try_cast(price_amount AS DECIMAL(18,2)), 0) <> 0 OR (price_type = '' AND coalesce(try_cast(quantity_purchased AS BIGINT), 0) > 0)
          OR coalesce(try_cast(item_fee_amount AS DECIMAL(18,2)), 0) + coalesce(try_cast(order_fee_amount AS DECIMAL(18,2)), 0) + coalesce(try_cast(shipment_fee_amount AS DECIMAL(18,2)), 0) <> 0
          OR coalesce(try_cast(promotion_amount AS DECIMAL(18,2)), 0) <> 0
          OR coalesce(try_cast(other_fee_amount AS DECIMAL(18,2)), 0) + coalesce(try_cast(other_amount AS DECIMAL(18,2)), 0) <> 0))"""
_REPORT_CTES = f"""{_ALIAS}, {_SETTLED},
  cat AS (SELECT lower(sku) AS sku, product_name, coalesce(brand, 'Other') AS brand, price, cost_price, coalesce(inventory_level, 0) AS inv FROM v_product WHERE {_PFX('sku')}),
  cg AS (SELECT sku, cost_per_unit FROM (SELECT lower(msku) AS sku, cost_per_unit, row_number() OVER (PARTITION BY lower(msku) ORDER BY valid_from DESC) AS rn
        FROM v_cost WHERE valid_to >= {_U} OR valid_to IS NULL) q WHERE rn = 1),
  bcr AS (SELECT lower({_VS}) AS sku, SUM(CASE WHEN li.base_total > 0 THEN li.quantity ELSE 0 END) AS units,
        SUM(CASE WHEN li.base_total > 0 THEN li.base_total ELSE 0 END) AS gross, COUNT(DISTINCT CASE WHEN li.base_total > 0 THEN li.order_id END) AS orders,
        SUM(CASE WHEN li.base_total = 0 THEN li.quantity ELSE 0 END) AS bundled
      FROM {_LINES} WHERE o.channel = 'storefront' AND o.order_date >= {_S} AND o.status NOT IN (4, 6) AND {_PFX(_VS)} GROUP BY 1),
  rf AS (SELECT lower({_VS}) AS sku, SUM(coalesce(r.quantity, 0)) AS units, SUM(coalesce(r.requested_amount, 0)) AS amount
      FROM v_refund r JOIN v_line li ON li.line_id = r.line_id JOIN v_product p ON p.product_id = li.product_id
      LEFT JOIN v_variant v ON v.variant_id = li.variant_id AND v.product_id = li.product_id JOIN v_order o ON o.order_id = r.order_id
      WHERE r.channel = 'storefront' AND o.order_date >= {_S} AND {_PFX(_VS)} GROUP BY 1),
  bcw AS (SELECT lower({_VS}) AS sku, SUM(li.quantity) AS units, SUM(li.base_total) AS gross, COUNT(DISTINCT li.order_id) AS orders
      FROM {_LINES} WHERE o.channel = 'wholesale' AND o.order_date >= {_S} AND o.status NOT IN (4, 6) AND {_PFX(_VS)} GROUP BY 1),
  amz AS (SELECT coalesce(al.canonical, lower(e.msku)) AS sku, SUM(units) AS units, SUM(gross_sales) AS gross, SUM(abs(refunds)) AS refunds,
        SUM(fees) AS fees, SUM(ad_spend) AS ads, SUM(net_proceeds) AS net
      FROM v_sku_day e LEFT JOIN al ON lower(e.msku) = al.raw WHERE business_date BETWEEN {_S} AND {_U} AND {_PFX('e.msku')} GROUP BY 1),
  ao AS (SELECT coalesce(al.canonical, lower(s.sku)) AS sku, COUNT(DISTINCT order_id) AS orders FROM st s LEFT JOIN al ON lower(s.sku) = al.raw
      WHERE posted BETWEEN {_S} AND {_U} AND transaction_type = 'Order' AND {_PFX('s.sku')} GROUP BY 1),
  uni AS (SELECT sku FROM cat UNION SELECT sku FROM bcr UNION SELECT sku FROM bcw UNION SELECT sku FROM amz)"""
_b = lambda e: f"CAST(coalesce({e}, 0) AS BIGINT)"
_d = lambda e: d2(f"coalesce({e}, 0)")
_UNITS = "(coalesce(bcr.units, 0) + coalesce(bcw.units, 0) + coalesce(amz.units, 0))"
_COST = "coalesce(cg.cost_per_unit, cat.cost_price)"
_REPORT = f"""{_REPORT_CTES}, rep AS (SELECT uni.sku, coalesce(cat.product_name, uni.sku) AS product_name, coalesce(cat.brand, 'Other') AS brand,
    CAST(cat.price AS DOUBLE) AS list_price, CAST({_COST} AS DOUBLE) AS cost_per_unit, {_b('cat.inv')} AS inventory_on_hand,
    {_b('bcr.units')} AS retail_units, {_b('bcr.orders')} AS retail_orders, {_b('bcr.bundled')} AS retail_bundled_units, {_b('rf.units')} AS retail_refund_units,
    {_b('bcw.units')} AS wholesale_units, {_b('bcw.orders')} AS wholesale_orders, {_b('amz.units')} AS marketplace_units, {_b('ao.orders')} AS marketplace_orders,
    {_d('bcr.gross')} AS retail_gross_sales, {_d('rf.amount')} AS retail_refund_amount, {_d('bcw.gross')} AS wholesale_gross_sales,
    {_d('amz.gross')} AS marketplace_gross_sales, {_d('amz.net')} AS marketplace_net_proceeds, {_d('amz.fees')} AS marketplace_fees,
    {_d('amz.ads')} AS marketplace_ad_spend, {_d('amz.refunds')} AS marketplace_refunds, {sql_ratio('rf.amount', 'bcr.gross', digits=4)} AS retail_refund_rate,
    CAST({_UNITS} AS BIGINT) AS total_units, {d2('coalesce(bcr.gross, 0) + coalesce(bcw.gross, 0) + coalesce(amz.gross, 0)')} AS total_gross_sales,
    {_b('bcr.orders')} + {_b('bcw.orders')} + {_b('ao.orders')} AS total_orders,
    CASE WHEN {_COST} IS NOT NULL AND {_UNITS} > 0 THEN {d2(f"coalesce(bcr.gross, 0) + coalesce(bcw.gross, 0) + coalesce(amz.net, 0) - {_COST} * CAST({_UNITS} AS DECIMAL(12,0))")} END AS gross_margin
  FROM uni LEFT JOIN cat USING (sku) LEFT JOIN cg USING (sku) LEFT JOIN bcr USING (sku) LEFT JOIN rf USING (sku) LEFT JOIN bcw USING (sku)
    LEFT JOIN amz USING (sku) LEFT JOIN ao USING (sku) WHERE cat.product_name IS NOT NULL OR bcr.units > 0 OR bcw.units > 0 OR amz.units > 0)"""


def aliases(f):
    return f.product.where("product_id % 10 = 3").select(
        F.concat(F.lower("sku"), F.lit("-m")).alias("raw"), F.lower("sku").alias("canonical"))


def report(f):
    return sku.sku_report(inputs(f), f.variant, f.refund.where("channel = 'storefront'"), aliases(f), SINCE, AS_OF)


@query("sku_report", f"WITH {_REPORT} SELECT * FROM rep")
def sku_report(f):
    return report(f)


@query("channel_split", f"""WITH {_REPORT}, s AS (SELECT SUM(CAST(retail_gross_sales AS DECIMAL(28,2))) AS retail, SUM(CAST(wholesale_gross_sales AS DECIMAL(28,2))) AS wholesale,
      SUM(CAST(marketplace_gross_sales AS DECIMAL(28,2))) AS marketplace FROM rep WHERE total_units > 0 OR total_gross_sales > 0)
    """ + " UNION ALL ".join(f"SELECT '{n}' AS channel, CAST({n} AS DOUBLE) AS gross_sales, {sql_ratio(n, '(retail + wholesale + marketplace)', 100, 1)} AS share_pct FROM s"
                             for n in ("retail", "wholesale", "marketplace")))
def channel_split(f):
    return sku.channel_split(report(f))


@query("sku_universe", f"WITH {_REPORT_CTES} SELECT sku FROM uni")
def sku_universe(f):
    x = inputs(f)
    return sku.sku_universe([
        sku.report_catalog(x.products),
        sku.retail_sales(x.storefront_lines, x.storefront_orders, x.products, f.variant, SINCE),
        sku.wholesale_sku_sales(x.wholesale_lines, x.wholesale_orders, x.products, f.variant, SINCE),
        sku.marketplace_sku_sales(x.sku_day, aliases(f), SINCE, AS_OF),
    ])


@query("refunds_by_sku", f"WITH {_REPORT_CTES} SELECT sku, {_b('units')} AS retail_refund_units, {_d('amount')} AS retail_refund_amount FROM rf")
def refunds_by_sku(f):
    x = inputs(f)
    out = sku.refunds_by_sku(f.refund.where("channel = 'storefront'"), x.storefront_lines, x.storefront_orders, x.products, f.variant, SINCE)
    return out.withColumns({"retail_refund_units": F.col("retail_refund_units").cast("bigint"),
                            "retail_refund_amount": as_double(F.col("retail_refund_amount"))})


@query("latest_cost", f"""SELECT cost_key, CAST(cost_per_unit AS DOUBLE) AS cost_per_unit FROM (SELECT lower(msku) AS cost_key, cost_per_unit,
      row_number() OVER (PARTITION BY lower(msku) ORDER BY valid_from DESC) AS rn FROM v_cost WHERE valid_to >= {_U} OR valid_to IS NULL) q WHERE rn = 1""")
def latest_cost(f):
    return ch.cost_lookup(f.cost, "latest_valid", AS_OF, case="lower").withColumn("cost_per_unit", F.col("cost_per_unit").cast("double"))


@query("sku_alias", f"""WITH {_ALIAS} SELECT coalesce(al.canonical, lower(e.msku)) AS sku, CAST(SUM(units) AS BIGINT) AS units
    FROM v_sku_day e LEFT JOIN al ON al.raw = lower(e.msku) GROUP BY 1""")
def sku_alias(f):
    per = f.sku_day.groupBy("msku").agg(F.sum("units").alias("u"))
    return sku.resolve_aliases(per, aliases(f), "msku").groupBy("sku").agg(F.sum("u").alias("units"))


@query("alias_relation", """SELECT CASE lower(sku) WHEN 'trk-5' THEN 'trk-05b' WHEN 'trk-9' THEN 'trk-09b' ELSE lower(sku) END AS sku,
    CAST(SUM(CAST(total AS DECIMAL(28,2))) AS DOUBLE) AS total FROM (SELECT p.sku, li.base_total AS total FROM v_line li JOIN v_product p USING (product_id)) q GROUP BY 1""")
def alias_relation(f):
    """A constant alias relation over all line sales."""
    table = sku.constant_aliases(f.spark, {"trk-5": "trk-05b", "trk-9": "trk-09b"})
    per = f.line.groupBy("product_id").agg(F.sum("base_total").alias("t")).join(f.product.select("product_id", "sku"), "product_id")
    return sku.resolve_aliases(per.withColumnRenamed("sku", "s"), table, "s").groupBy("sku").agg(F.sum("t").cast("double").alias("total"))


@query("item_year_rollup", f"""WITH y AS (SELECT asin, CAST(year(business_date) AS VARCHAR) AS year, SUM(units) AS units, SUM(gross_sales) AS gross_sales, SUM(fees) AS fees,
      SUM(ad_spend) AS ad_spend, SUM(net_proceeds) AS net_proceeds FROM v_sku_day GROUP BY ROLLUP (asin, 2) HAVING grouping(asin) = 0)
    SELECT asin, coalesce(year, 'Total') AS year, CAST(units AS BIGINT) AS units, {', '.join(f'{d2(c)} AS {c}' for c in ('gross_sales', 'fees', 'ad_spend', 'net_proceeds'))},
      CASE WHEN units > 0 THEN {sql_ratio('net_proceeds', 'units', digits=4)} ELSE 0 END AS net_per_unit,
      CASE WHEN units > 0 THEN {sql_ratio('gross_sales', 'units', digits=4)} ELSE 0 END AS revenue_per_unit FROM y""".replace("ROLLUP (asin, 2)", "ROLLUP (asin, CAST(year(business_date) AS VARCHAR))"))
def item_year_rollup(f):
    return sku.item_year_rollup(f.sku_day)


# -------------------------------------------------------------- revenue analysis
_CLASS = """CASE WHEN (n LIKE '%workshop%' OR n LIKE '%seminar%' OR (n LIKE '%class%' AND n NOT LIKE '%classic%')) AND n NOT LIKE '%book%' THEN 'Workshops'
    WHEN n LIKE '%boarding%' OR n LIKE '%repotting service%' OR n LIKE '%consult%' THEN 'Services'
    WHEN lower(src) IN ('manual', 'pos') THEN 'Retail' ELSE '.Com' END"""
_NAMED = """named AS (SELECT li.order_id, li.product_id, li.quantity, li.total_ex_tax, p.sku, p.product_name,
      lower(p.product_name || CASE p.product_id % 12 WHEN 0 THEN ' Workshop' WHEN 1 THEN ' Classic' WHEN 2 THEN ' class' WHEN 3 THEN ' workshop book' WHEN 4 THEN ' consult' ELSE '' END) AS n,
      CASE o.customer_id % 5 WHEN 0 THEN 'POS' WHEN 1 THEN 'manual' ELSE 'www' END AS src, o.order_date, o.channel, o.status
    FROM v_line li JOIN v_order o USING (order_id) JOIN v_product p USING (product_id))"""


def named_sales(f):
    """Realised order lines with a business line, as the revenue recap reads them."""
    suffix = F.expr("CASE product_id % 12 WHEN 0 THEN ' Workshop' WHEN 1 THEN ' Classic' WHEN 2 THEN ' class' "
                    "WHEN 3 THEN ' workshop book' WHEN 4 THEN ' consult' ELSE '' END")
    source = F.expr("CASE customer_id % 5 WHEN 0 THEN 'POS' WHEN 1 THEN 'manual' ELSE 'www' END")
    orders = f.order.where(F.col("status").isin(2, 10, 11, 3)).select("order_id", "order_date", source.alias("source"))
    rows = f.line.join(orders, "order_id").join(f.product.select("product_id", "sku", "product_name"), "product_id")
    name = F.concat("product_name", suffix)
    line = F.when(F.col("channel") == "storefront", sku.classify_line(name, F.col("source"))).otherwise("Wholesale")
    return rows.where(F.col("channel") != "marketplace").select(
        "sku", "product_name", "quantity", F.col("total_ex_tax").alias("revenue"), F.col("total_ex_tax").alias("income"),
        line.alias("channel"), F.year("order_date").alias("year"),
    )


def market_sales(f):
    return f.sku_day.select(
        F.col("msku").alias("sku"), F.col("msku").alias("product_name"), F.col("units").alias("quantity"),
        F.col("gross_sales").alias("revenue"), F.col("net_proceeds").alias("income"), F.lit("Marketplace").alias("channel"),
        F.year("business_date").alias("year"))


_ALLSALES = f"""{_NAMED}, alls AS (SELECT sku, product_name, quantity, total_ex_tax AS revenue, total_ex_tax AS income,
      CASE WHEN channel = 'storefront' THEN {_CLASS} ELSE 'Wholesale' END AS channel, year(order_date) AS year FROM named
      WHERE status IN (2, 10, 11, 3) AND channel <> 'marketplace'
    UNION ALL SELECT msku, msku, units, gross_sales, net_proceeds, 'Marketplace', year(business_date) FROM v_sku_day),
  fc AS (SELECT product_id, min_by(category_name, category_id) AS category_name FROM v_product_category GROUP BY 1),
  lk AS (SELECT lower(sku) AS k, cost_price, category_name FROM v_product LEFT JOIN fc USING (product_id)),
  enr AS (SELECT a.*, coalesce(lk.category_name, 'Uncategorized') AS category_name,
      income - coalesce(lk.cost_price, 0) * CAST(quantity AS DECIMAL(12,0)) AS margin FROM alls a LEFT JOIN lk ON lk.k = lower(a.sku))"""


def enriched(f):
    both = named_sales(f).unionByName(market_sales(f))
    return sku.margin_enrich(both, sku.master_lookup(f.product, f.product_category))


@query("classify_line", f"WITH {_ALLSALES} SELECT channel, CAST(COUNT(*) AS BIGINT) AS n, {d2('SUM(revenue)')} AS revenue FROM alls GROUP BY 1")
def classify_line(f):
    both = named_sales(f).unionByName(market_sales(f))
    return both.groupBy("channel").agg(F.count("*").alias("n"), as_double(F.sum("revenue")).alias("revenue"))


@query("category_list", "SELECT product_id, string_agg(category_name, ', ' ORDER BY category_id) AS category_names FROM v_product_category GROUP BY 1")
def category_list(f):
    return sku.category_list(f.product_category)


@query("margin_enrich", f"WITH {_ALLSALES} SELECT channel, category_name, CAST(SUM(quantity) AS BIGINT) AS quantity, {d2('SUM(margin)')} AS margin FROM enr GROUP BY 1, 2")
def margin_enrich(f):
    return enriched(f).groupBy("channel", "category_name").agg(F.sum("quantity").alias("quantity"), as_double(F.sum("margin")).alias("margin"))


@query("channel_yoy", f"""WITH {_ALLSALES}, s AS (SELECT channel, coalesce(SUM(revenue) FILTER (year = 2000), 0) AS a, coalesce(SUM(revenue) FILTER (year = 1999), 0) AS b FROM alls GROUP BY 1)
    SELECT channel, {d2('a')} AS this_year, {d2('b')} AS last_year, {sql_ratio('(a - b)', 'b', 100, 1)} AS yoy_pct, {d2('a - b')} AS delta FROM s""")
def channel_yoy(f):
    return sku.channel_yoy(named_sales(f).unionByName(market_sales(f)), 2000, 1999)


@query("margin_drivers", f"WITH {_ALLSALES} SELECT product_name, category_name, {d2('SUM(margin)')} AS margin, {d2('SUM(revenue)')} AS revenue FROM enr WHERE year = 2000 GROUP BY 1, 2")
def margin_drivers(f):
    return sku.margin_drivers(enriched(f).where("year = 2000"), ["product_name", "category_name"])


@query("margin_drivers_all_years", f"WITH {_ALLSALES} SELECT product_name, category_name, {d2('SUM(margin)')} AS margin, {d2('SUM(revenue)')} AS revenue FROM enr GROUP BY 1, 2")
def margin_drivers_all_years(f):
    return sku.margin_drivers(enriched(f), ["product_name", "category_name"])


@query("noise_products", f"""WITH {_ALLSALES}, s AS (SELECT product_name, channel, CAST(SUM(quantity) AS BIGINT) AS quantity, SUM(revenue) AS r, SUM(margin) AS m FROM enr WHERE year = 2000 GROUP BY 1, 2)
    SELECT product_name, channel, quantity, {d2('r')} AS revenue, {d2('m')} AS margin, {sql_ratio('m', 'r', digits=6)} AS margin_pct FROM s WHERE r > 500 ORDER BY margin_pct, product_name, channel LIMIT 5""")
def noise_products(f):
    return sku.noise_products(enriched(f).where("year = 2000"))


@query("noise_products_all_years", f"""WITH {_ALLSALES}, s AS (SELECT product_name, channel, CAST(SUM(quantity) AS BIGINT) AS quantity, SUM(revenue) AS r, SUM(margin) AS m FROM enr GROUP BY 1, 2)
    SELECT product_name, channel, quantity, {d2('r')} AS revenue, {d2('m')} AS margin, {sql_ratio('m', 'r', digits=6)} AS margin_pct FROM s WHERE r > 500 ORDER BY margin_pct, product_name, channel LIMIT 5""")
def noise_products_all_years(f):
    return sku.noise_products(enriched(f))


_VARIANTS = f"""vs AS (SELECT lower(trim(p.sku)) AS parent_sku, p.product_name, trim(coalesce(v.variant_sku, 'Unknown')) AS variant_sku, o.order_date, li.quantity, li.total_ex_tax AS revenue
    FROM v_line li JOIN v_order o USING (order_id) JOIN v_product p ON p.product_id = li.product_id LEFT JOIN v_variant v ON v.variant_id = li.variant_id
    WHERE o.channel = 'storefront' AND o.status IN (2, 10, 11, 3) AND o.order_date {_C} AND {_PFX('p.sku')}),
  stk AS (SELECT lower(trim(sku)) AS k, max(opening_qty) AS stock FROM (SELECT sku, opening_qty FROM v_part_master UNION ALL SELECT sku || '-v1', opening_qty + 20 FROM v_part_master) q GROUP BY 1)"""


def variant_rows(f):
    x = inputs(f)
    from saleswell.config import REPORT_PREFIXES
    return sku.variant_sales(x.storefront_lines, x.storefront_orders, f.product, f.variant, CUR, REPORT_PREFIXES)


def stock(f):
    parts = f.part_master
    return parts.select("sku", F.col("opening_qty").alias("quantity")).unionByName(
        parts.select(F.concat("sku", F.lit("-v1")).alias("sku"), (F.col("opening_qty") + 20).alias("quantity")))


@query("top_parent_variants", f"""WITH {_VARIANTS}, tp AS (SELECT parent_sku, SUM(revenue) AS pr FROM vs GROUP BY 1 ORDER BY pr DESC, parent_sku LIMIT 10)
    SELECT vs.parent_sku, product_name, variant_sku, coalesce(max(stk.stock), 0) AS stock, CAST(SUM(quantity) AS BIGINT) AS quantity, {d2('SUM(revenue)')} AS revenue, {d2('max(pr)')} AS parent_revenue
    FROM vs JOIN tp USING (parent_sku) LEFT JOIN stk ON stk.k = lower(trim(variant_sku)) GROUP BY 1, 2, 3""")
def top_parent_variants(f):
    return sku.top_parent_variants(variant_rows(f), stock(f))


@query("parent_variant_ranks", f"""WITH {_VARIANTS}, tp AS (SELECT parent_sku, SUM(revenue) AS pr FROM vs GROUP BY 1 ORDER BY pr DESC, parent_sku LIMIT 10),
    t AS (SELECT vs.parent_sku, product_name, variant_sku, {d2('SUM(revenue)')} AS revenue, {d2('max(pr)')} AS parent_revenue FROM vs JOIN tp USING (parent_sku) GROUP BY 1, 2, 3)
    SELECT parent_sku, variant_sku, product_name, revenue, CAST(row_number() OVER (PARTITION BY parent_sku ORDER BY revenue DESC, variant_sku, product_name) AS INTEGER) AS rank_in_parent,
      {sql_ratio('revenue', 'parent_revenue', 100)} AS share FROM t""")
def parent_variant_ranks(f):
    """Variants of the best parents in order, with their share of the parent."""
    ranked = sku.rank_in_parent(sku.top_parent_variants(variant_rows(f), stock(f)))
    return ranked.select("parent_sku", "variant_sku", "product_name", "revenue", "rank_in_parent", "share")


@query("buy_forecast", f"""WITH {_VARIANTS}, s AS (SELECT parent_sku, product_name, variant_sku,
      CAST(SUM(CASE WHEN order_date BETWEEN DATE '2000-01-01' AND DATE '2000-05-31' THEN quantity ELSE 0 END) AS BIGINT) AS a,
      CAST(SUM(CASE WHEN order_date BETWEEN DATE '2000-06-01' AND DATE '2000-12-31' THEN quantity ELSE 0 END) AS BIGINT) AS b FROM vs GROUP BY 1, 2, 3)
    SELECT parent_sku, variant_sku, product_name, coalesce(stock, 0) AS stock, a AS sales_before, greatest(coalesce(stock, 0) - a, 0) AS projected_stock, b AS sales_after,
      greatest(b - greatest(coalesce(stock, 0) - a, 0), 0) AS buy_recommendation FROM s LEFT JOIN stk ON stk.k = lower(trim(variant_sku)) WHERE a <> 0 OR b <> 0""")
def buy_forecast(f):
    spans = (dt.date(2000, 1, 1), dt.date(2000, 5, 31)), (dt.date(2000, 6, 1), dt.date(2000, 12, 31))
    return sku.buy_forecast(variant_rows(f), stock(f), *spans)


@query("sku_totals", f"""WITH {_ALLSALES} SELECT lower(trim(sku)) AS sku, min(product_name) AS product_name, CAST(SUM(quantity) AS BIGINT) AS quantity, {d2('SUM(revenue)')} AS revenue
    FROM alls WHERE year = 2000 AND {_PFX('sku')} GROUP BY 1 ORDER BY SUM(revenue) DESC, 1 LIMIT 10""")
def sku_totals(f):
    from saleswell.config import REPORT_PREFIXES
    both = named_sales(f).unionByName(market_sales(f)).where("year = 2000")
    return sku.sku_totals(both.where(has_prefix(F.col("sku"), REPORT_PREFIXES)))


@query("sku_totals_all_years", f"""WITH {_ALLSALES} SELECT lower(trim(sku)) AS sku, min(product_name) AS product_name, CAST(SUM(quantity) AS BIGINT) AS quantity, {d2('SUM(revenue)')} AS revenue
    FROM alls WHERE {_PFX('sku')} GROUP BY 1 ORDER BY SUM(revenue) DESC, 1 LIMIT 10""")
def sku_totals_all_years(f):
    from saleswell.config import REPORT_PREFIXES
    both = named_sales(f).unionByName(market_sales(f))
    return sku.sku_totals(both.where(has_prefix(F.col("sku"), REPORT_PREFIXES)))


@query("sku_lifetime", f"""SELECT lower({_VS}) AS sku, p.product_name, p.brand, CAST(SUM(li.quantity) AS BIGINT) AS units, {d2('SUM(li.base_total)')} AS gross_sales,
      COUNT(DISTINCT li.order_id) AS orders, min(o.order_date) AS first_sale, max(o.order_date) AS last_sale
    FROM {_LINES} WHERE o.channel = 'storefront' AND o.order_date >= {_S} AND o.status NOT IN (4, 6) AND {_PFX(_VS)} GROUP BY 1, 2, 3""")
def sku_lifetime(f):
    x = inputs(f)
    return sku.sku_lifetime(x.storefront_lines, x.storefront_orders, f.product, f.variant, SINCE)


@query("cost_asof", f"""WITH d AS (SELECT upper(p.sku) AS k, o.order_date AS od, SUM(li.quantity) AS q FROM v_line li JOIN v_order o USING (order_id) JOIN v_product p ON p.product_id = li.product_id GROUP BY 1, 2),
      j AS (SELECT d.k, d.od, d.q, max_by(c.cost_per_unit, c.valid_from) AS cost FROM d LEFT JOIN v_cost c ON upper(c.msku) = d.k AND d.od >= c.valid_from AND (c.valid_to IS NULL OR d.od <= c.valid_to) GROUP BY 1, 2, 3)
    SELECT k AS sku, CAST(SUM(q) AS BIGINT) AS units, {d2('SUM(cost * CAST(q AS DECIMAL(12,0)))')} AS cogs, CAST(SUM(CASE WHEN cost IS NULL THEN q ELSE 0 END) AS BIGINT) AS units_without_cost FROM j GROUP BY 1""")
def cost_asof(f):
    return sku.cost_at_sale(f.line, f.order, f.product, f.cost)


# ------------------------------------------------------------------------ joins
@query("canonical_sku", f"""SELECT {_SKU} AS sku, CAST(COUNT(*) AS BIGINT) AS n FROM v_line li LEFT JOIN v_product p ON p.product_id = li.product_id
    LEFT JOIN v_variant v ON v.variant_id = li.variant_id AND v.product_id = li.product_id GROUP BY 1""")
def canonical_sku_query(f):
    grouped = f.line.groupBy("product_id", "variant_id").agg(F.count("*").alias("n"))
    named = grouped.join(f.product.select("product_id", "product_name", "sku"), "product_id", "left").join(f.variant, ["variant_id", "product_id"], "left")
    key = canonical_sku(F.col("variant_sku"), F.col("product_name"), F.col("sku"))
    return named.groupBy(key.alias("sku")).agg(F.sum("n").alias("n"))


@query("prefix_filter", f"""SELECT sku, product_name FROM v_product WHERE {_PFX('sku')} AND NOT (lower(sku) LIKE 'web%' OR lower(sku) LIKE 'tweb%')""")
def prefix_filter(f):
    from saleswell.config import REPORT_PREFIXES, WEB_ONLY_PREFIXES
    c = F.col("sku")
    return f.product.where(has_prefix(c, REPORT_PREFIXES) & ~has_prefix(c, WEB_ONLY_PREFIXES)).select("sku", "product_name")


@query("line_order_product", """SELECT o.channel, p.product_type, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(li.total_ex_tax) AS DOUBLE) AS revenue
    FROM v_line li JOIN v_order o USING (order_id) JOIN v_product p USING (product_id) GROUP BY 1, 2""")
def line_order_product(f):
    per = f.line.drop("channel").join(f.order.select("order_id", "channel"), "order_id").groupBy("channel", "product_id").agg(
        F.count("*").alias("n"), F.sum("total_ex_tax").alias("r"))
    return per.join(f.product.select("product_id", "product_type"), "product_id").groupBy("channel", "product_type").agg(
        F.sum("n").alias("n"), F.sum("r").cast("double").alias("revenue"))


@query("variant_left_join", """SELECT v.variant_sku, CAST(SUM(li.quantity) AS BIGINT) AS units FROM v_line li
    LEFT JOIN v_variant v ON v.variant_id = li.variant_id AND v.product_id = li.product_id GROUP BY 1""")
def variant_left_join(f):
    per = f.line.groupBy("variant_id", "product_id").agg(F.sum("quantity").alias("u"))
    return per.join(f.variant, ["variant_id", "product_id"], "left").groupBy("variant_sku").agg(F.sum("u").alias("units"))


@query("cost_join", """SELECT p.sku, CAST(c.cost_per_unit AS DOUBLE) AS cost_per_unit, CAST(SUM(li.quantity) AS BIGINT) AS units
    FROM v_line li JOIN v_product p USING (product_id) LEFT JOIN v_cost c ON upper(trim(p.sku)) = upper(trim(c.msku)) GROUP BY 1, 2""")
def cost_join(f):
    per = f.line.groupBy("product_id").agg(F.sum("quantity").alias("u"))
    keyed = per.join(f.product.select("product_id", "sku", F.upper(F.trim("sku")).alias("cost_key")), "product_id")
    priced = keyed.join(ch.cost_lookup(f.cost, trim=True), "cost_key", "left")
    return priced.groupBy("sku", F.col("cost_per_unit").cast("double").alias("cost_per_unit")).agg(F.sum("u").alias("units"))
