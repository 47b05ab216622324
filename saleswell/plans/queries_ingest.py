"""Registered queries: landed feeds, parsing, reloads, data quality.

Raw text feeds (JSON, CSV, XML, Markdown) are rendered from the canonical views
by Spark and parsed back by the readers' own parsing columns.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from saleswell.functions import text as tx
from saleswell.functions.numeric import as_double, parse_decimal, parse_number
from saleswell.operators import maintenance as mt, quality as dq
from saleswell.operators.settlements import unparsable_rows, unpivot
from saleswell.plans.registry import query, sql_ratio, sql_round
from saleswell.sources import accounting, files, invoices, marketplace, parts

LOADED = dt.datetime(2001, 7, 18)


# ------------------------------------------------------------------- economics
def economics_text(f):
    """Economics documents as JSON lines."""
    amount = lambda c: F.struct(F.col(c).cast("double").alias("amount")) if isinstance(c, str) else F.struct(c.alias("amount"))
    charge = lambda v: F.struct(F.struct(amount(v.cast("double")).alias("totalAmount")).alias("aggregatedDetail"))
    fees = F.array(
        F.struct(F.lit("Referral").alias("feeTypeName"), F.array(charge(F.col("fees"))).alias("charges")),
        F.struct(F.lit("Storage").alias("feeTypeName"), F.array(charge(F.lit(-1.25)), charge(F.lit(1.0)), charge(F.lit(None))).alias("charges")),
    )
    ads = F.array(F.struct(F.lit("SP").alias("adTypeName"), F.struct(amount("ad_spend").alias("totalAmount")).alias("charge")))
    doc = F.struct(
        F.col("business_date").cast("string").alias("startDate"), F.col("msku"), F.col("asin").alias("childAsin"),
        F.lit("US").alias("marketplaceId"), F.lit("ignored").alias("unknownField"),
        F.struct(
            F.col("units").alias("unitsOrdered"), amount("gross_sales").alias("orderedProductSales"),
            F.when(F.col("refunds") != 0, amount("refunds")).alias("refundedProductSales"),
            amount("net_sales").alias("netProductSales"),
        ).alias("sales"),
        F.when(F.col("units") % 7 != 0, fees).alias("fees"),
        F.when(F.col("units") % 5 != 0, ads).alias("ads"),
        F.struct(amount("net_proceeds").alias("total")).alias("netProceeds"),
    )
    return f.sku_day.select(F.to_json(doc).alias("value"))


def economics_raw(f):
    return economics_text(f).select(F.from_json("value", marketplace.ECONOMICS_SCHEMA).alias("r")).select("r.*")


_FEES = "CAST(CASE WHEN units % 7 <> 0 THEN fees - 0.25 ELSE 0 END AS DOUBLE)"
_ADS = "CAST(CASE WHEN units % 5 <> 0 THEN ad_spend ELSE 0 END AS DOUBLE)"


@query("economics_flatten", f"""SELECT business_date, 'US' AS marketplace, msku, asin, CAST(NULL AS VARCHAR) AS fnsku, units, CAST(gross_sales AS DOUBLE) AS gross_sales,
      CAST(refunds AS DOUBLE) AS refunds, CAST(net_sales AS DOUBLE) AS net_sales, {_FEES} AS fees, {_ADS} AS ad_spend, CAST(net_proceeds AS DOUBLE) AS net_proceeds FROM v_sku_day""")
def economics_flatten(f):
    flat = marketplace.flatten_economics(economics_raw(f), "q1", "d1", LOADED)
    cols = ("gross_sales", "refunds", "net_sales", "fees", "ad_spend", "net_proceeds")
    return flat.withColumns({c: F.col(c).cast("double") for c in cols}).drop("source_query_id", "source_document_id", "ingested_at")


@query("nested_fee_sum", f"SELECT msku, business_date, {_FEES} AS fees, {_ADS} AS ads FROM v_sku_day")
def nested_fee_sum(f):
    return economics_raw(f).select(
        "msku", F.col("startDate").cast("date").alias("business_date"),
        marketplace.fee_total(F.col("fees")).cast("double").alias("fees"), marketplace.ad_total(F.col("ads")).cast("double").alias("ads"))


@query("scan_economics_json", """SELECT CAST(business_date AS VARCHAR) AS start_date, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(units) AS BIGINT) AS units,
    CAST(COUNT(CASE WHEN units % 7 <> 0 THEN 1 END) AS BIGINT) AS with_fees FROM v_sku_day GROUP BY 1""")
def scan_economics_json(f):
    return economics_raw(f).groupBy(F.col("startDate").alias("start_date")).agg(
        F.count("*").alias("n"), F.sum("sales.unitsOrdered").alias("units"), F.count("fees").alias("with_fees"))


# --------------------------------------------------------------------- traffic
def traffic_documents(f):
    entry = lambda date, sku, sessions: F.struct(
        date.alias("date"), F.col("asin").alias("childAsin"), F.lit("P1").alias("parentAsin"), sku.alias("sku"),
        F.struct(sessions.alias("sessions"), F.col("page_views").alias("pageViews"), F.lit(55.5).alias("buyBoxPercentage")).alias("trafficByAsin"),
        F.struct(F.col("units_ordered").alias("unitsOrdered"), F.struct(F.col("ordered_sales").cast("double").alias("amount")).alias("orderedProductSales")).alias("salesByAsin"),
    )
    day, none = F.col("report_date").cast("string"), F.lit(None).cast("string")
    first = entry(day, F.col("msku"), F.col("sessions"))
    second = entry(none, none, F.lit(None).cast("bigint"))
    broken = entry(F.lit("not a date"), F.col("msku"), F.col("sessions"))
    doc = F.struct(
        F.struct(day.alias("dataStartTime")).alias("reportSpecification"),
        F.when(F.col("sessions") % 3 == 0, F.array(first, second)).when(F.col("sessions") % 3 == 1, F.array(first, broken)).otherwise(F.array(first)).alias("salesAndTrafficByAsin"),
    )
    text = f.traffic.select(F.to_json(doc).alias("value"))
    return text.select(F.from_json("value", marketplace.TRAFFIC_SCHEMA).alias("r")).select("r.*")


@query("flatten_traffic_report", """WITH e AS (SELECT report_date, msku, asin, sessions, page_views, units_ordered, ordered_sales FROM v_traffic
      UNION ALL SELECT report_date, asin, asin, 0, page_views, units_ordered, ordered_sales FROM v_traffic WHERE sessions % 3 = 0)
    SELECT report_date, msku, asin, sessions, page_views, CAST(55.5 AS DOUBLE) AS buy_box_percentage, CAST(0 AS DOUBLE) AS unit_session_percentage, units_ordered,
      CAST(ordered_sales AS DOUBLE) AS ordered_sales FROM e""")
def flatten_traffic_report(f):
    return marketplace.flatten_traffic(traffic_documents(f)).withColumn("ordered_sales", F.col("ordered_sales").cast("double"))


# ------------------------------------------------------------------ settlements
_Q = "CASE WHEN quantity_purchased = '' THEN '0' ELSE quantity_purchased END"
_A = lambda c: f"coalesce(try_cast({c} AS DECIMAL(18,2)), 0)"
_POSTED = "coalesce(try_cast(substr(posted_date, 1, 10) AS DATE), CAST(try_strptime(posted_date, '%d.%m.%Y') AS DATE))"
_TIME = lambda c: f"coalesce(try_cast(replace({c}, 'Z', '') AS TIMESTAMP), try_strptime({c}, '%d.%m.%Y'))"
_COMP = f"""w AS (SELECT *, try_cast({_Q} AS BIGINT) AS qty, {_TIME("coalesce(nullif(posted_date, ''), posted_date_time)")} AS posted FROM v_settle_wide),
  c AS (SELECT *, 'Price' AS amount_type, coalesce(nullif(price_type, ''), 'Principal') AS amount_description, {_A('price_amount')} AS amount FROM w
    UNION ALL SELECT *, 'Fee', coalesce(nullif(item_fee_type, ''), nullif(order_fee_type, ''), nullif(shipment_fee_type, ''), 'Fee'),
      {_A('item_fee_amount')} + {_A('order_fee_amount')} + {_A('shipment_fee_amount')} FROM w
    UNION ALL SELECT *, 'Promotion', coalesce(nullif(promotion_type, ''), 'Promotion'), {_A('promotion_amount')} FROM w
    UNION ALL SELECT *, 'Other', coalesce(nullif(other_reason, ''), 'Other'), {_A('other_fee_amount')} + {_A('other_amount')} + {_A('misc_fee_amount')} FROM w),
  st AS (SELECT * FROM c WHERE qty IS NOT NULL AND (amount <> 0 OR (amount_type = 'Price' AND amount_description = 'Principal' AND qty > 0)))"""


@query("settlement_unpivot", f"""WITH {_COMP} SELECT settlement_id, currency, transaction_type, order_id, merchant_order_id, adjustment_id, shipment_id, marketplace_name, fulfillment_id, sku,
    {', '.join(f"CAST({_TIME(c)} AS VARCHAR) AS {c}" for c in ('settlement_start_date', 'settlement_end_date', 'deposit_date'))}, CAST({_A('total_amount')} AS DOUBLE) AS total_amount,
    CAST(posted AS VARCHAR) AS posted_date_time, CAST(posted AS DATE) AS posted_date, qty AS quantity_purchased, '2002-01-01 00:00:00' AS ingested_at,
    amount_type, amount_description, CAST(amount AS DOUBLE) AS amount FROM st""")
def settlement_unpivot(f):
    """All columns of the settlement fact; times as text, which both engines print alike."""
    out = unpivot(f.settle_wide, ingested_at=dt.datetime(2002, 1, 1))
    times = ("settlement_start_date", "settlement_end_date", "deposit_date", "posted_date_time", "ingested_at")
    return out.withColumns({**{c: F.col(c).cast("string") for c in times}, **{c: F.col(c).cast("double") for c in ("amount", "total_amount")}})


@query("settlement_quarantine", f"SELECT shipment_id, quantity_purchased FROM v_settle_wide WHERE try_cast({_Q} AS BIGINT) IS NULL")
def settlement_quarantine(f):
    return unparsable_rows(f.settle_wide).select("shipment_id", "quantity_purchased")


@query("scan_settlement_tsv", "SELECT settlement_id, order_id, shipment_id, nullif(posted_date, '') AS posted_date, nullif(price_amount, '') AS price_amount FROM v_settle_wide")
def scan_settlement_tsv(f):
    cols = ["settlement_id", "order_id", "shipment_id", "posted_date", "price_amount"]
    text = f.settle_wide.select(F.concat_ws("\t", *cols).alias("value"))
    schema = ", ".join(f"{c} string" for c in cols)
    return text.select(F.from_csv("value", schema, {"sep": "\t"}).alias("r")).select(
        *[F.nullif(f"r.{c}", F.lit("")).alias(c) for c in cols])


@query("parse_dates", f"SELECT posted_date, {_POSTED} AS parsed, CAST(COUNT(*) AS BIGINT) AS n FROM v_settle_wide GROUP BY 1, 2")
def parse_dates(f):
    parsed = tx.parse_timestamp(F.col("posted_date")).cast("date")
    return f.settle_wide.groupBy("posted_date").agg(F.count("*").alias("n")).select("posted_date", parsed.alias("parsed"), "n")


@query("manifest_since", f"""SELECT settlement_id, min({_POSTED}) AS created FROM v_settle_wide GROUP BY 1 HAVING min({_POSTED}) >= DATE '1999-06-15'""")
def manifest_since(f):
    created = F.min(tx.parse_timestamp(F.col("posted_date"))).alias("created_time")
    manifest = f.settle_wide.groupBy("settlement_id").agg(created)
    return files.created_since(manifest, dt.datetime(1999, 6, 15)).select("settlement_id", F.col("created_time").cast("date").alias("created"))


# ------------------------------------------------------------------ parts file
def parts_file(f):
    """The master file as landed: messy money, padded text, some blank SKUs."""
    p = f.part_master
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 2), F.lit(" "))
    return p.select(
        F.when(F.col("reorder_point") == 13, F.lit("  ")).otherwise(F.concat(F.lit(" "), "sku")).alias("Sku"),
        F.col("active_status").alias("Active Status"), F.concat("description", F.lit("  ")).alias("Description"),
        F.when(F.col("reorder_point") == 7, F.lit("n/a")).otherwise(money("cost")).alias("Cost"), money("price").alias("Price"),
        F.col("reorder_point").cast("int").cast("string").alias("Reorder Pt (Min)"), F.lit("").alias("Quantity On Hand (2025)"),
        F.col("cogs_account").alias("COGS Account"), F.lit("x").alias("Unmapped Column"),
    )


_PARTS = """SELECT sku, active_status, description, CASE WHEN reorder_point = 7 THEN 0 ELSE cost END AS cost, price, reorder_point,
    CAST(0 AS DOUBLE) AS opening_qty, cogs_account, active_status = 'Active' AS is_active FROM v_part_master WHERE reorder_point <> 13"""


@query("clean_parts", _PARTS)
def clean_parts(f):
    return parts.clean_parts(parts_file(f))


@query("load_parts_csv", _PARTS)
def load_parts_csv(f):
    """Round trip through CSV text with quoting."""
    raw = parts_file(f).drop("Unmapped Column")
    cols = raw.columns
    text = raw.select(F.to_csv(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]),
                               {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("v"))
    parsed = text.select(F.from_csv("v", ", ".join(f"c{i} string" for i in range(len(cols)))).alias("r")).select("r.*").toDF(*cols)
    return parts.clean_parts(parsed)


@query("clean_money", """SELECT p_partkey, round(p_retailprice * 3, 2) AS amount, round(p_retailprice * 3, 2) AS exact, CAST(NULL AS DOUBLE) AS bad, CAST(0 AS DOUBLE) AS blank FROM part""")
def clean_money(f):
    text = F.concat(F.lit(" $"), F.format_number(F.round(F.col("p_retailprice") * 3, 2), 2), F.lit(" "))
    return f.part.select("p_partkey", parse_number(text).alias("amount"), parse_decimal(text).cast("double").alias("exact"),
                         parse_number(F.concat(F.lit("("), text), None).alias("bad"), parse_number(F.lit("")).alias("blank"))


@query("skip_rules", """SELECT sku, CAST(price AS DOUBLE) AS price FROM (SELECT CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN ' ' ELSE p_name END AS sku,
    CASE WHEN p_size % 5 IN (0, 1) OR p_size % 7 = 0 THEN NULL ELSE p_retailprice END AS price FROM part) q WHERE trim(sku) <> '' AND price IS NOT NULL""")
def skip_rules(f):
    """All-empty rows, rows without a key and rows that do not parse are left out."""
    size = F.col("p_size")
    raw = f.part.select(
        F.when(size % 5 == 1, F.lit(" ")).when(size % 5 != 0, F.col("p_name")).alias("sku"),
        F.when((size % 5 > 1) & (size % 7 != 0), F.col("p_retailprice").cast("string")).when(size % 5 > 1, F.lit("oops")).alias("price"))
    return dq.skip_rows(raw, "sku", ["price"])[0]


@query("skip_quarantine", """SELECT sku, price, CASE WHEN coalesce(trim(sku), '') = '' AND price IS NULL THEN 'empty' ELSE 'not a number' END AS reason FROM (SELECT CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN ' ' ELSE p_name END AS sku,
    CASE WHEN p_size % 5 IN (0, 1) THEN NULL WHEN p_size % 7 = 0 THEN 'oops' ELSE 'n' END AS price FROM part) q WHERE coalesce(trim(sku), '') = '' OR price = 'oops'""")
def skip_quarantine(f):
    """The rows that the skip rules leave out, each with its reason."""
    size = F.col("p_size")
    raw = f.part.select(
        F.when(size % 5 == 1, F.lit(" ")).when(size % 5 != 0, F.col("p_name")).alias("sku"),
        F.when((size % 5 > 1) & (size % 7 != 0), F.col("p_retailprice").cast("string")).when(size % 5 > 1, F.lit("oops")).alias("price"))
    return dq.skip_rows(raw, "sku", ["price"])[1]


@query("dates_from_filename", """SELECT o_orderkey AS order_id, CAST(o_orderdate + INTERVAL 8 YEAR AS DATE) AS report_start_date, CAST(o_orderdate + INTERVAL 8 YEAR AS DATE) + 6 AS report_end_date
    FROM orders WHERE o_orderkey % 3 <> 2""")
def dates_from_filename(f):
    day = F.col("o_orderdate").cast("date")
    # Report names write years with two digits, from 2000 on; the orders are moved there.
    day = F.add_months(day, 96)
    rows = f.orders.select("o_orderkey", day.alias("a"), F.date_add(day, 6).alias("b"))
    dash = F.concat(F.lit("Econ "), F.date_format("a", "M-d-yy"), F.lit(" to "), F.date_format("b", "M-d-yy"), F.lit(".csv"))
    line = F.concat(F.lit("econ_"), F.date_format("a", "M_d_yy"), F.lit("_to_"), F.date_format("b", "M_d_yy"), F.lit(".csv"))
    name = F.when(F.col("o_orderkey") % 3 == 0, dash).when(F.col("o_orderkey") % 3 == 1, line).otherwise(F.lit("econ latest.csv"))
    start, end = files.report_period(name)
    out = rows.select(F.col("o_orderkey").alias("order_id"), start.alias("report_start_date"), end.alias("report_end_date"))
    return out.where(F.col("report_start_date").isNotNull())


@query("audit_tail", """SELECT event_id, event_type AS action, CAST(user_id AS VARCHAR) AS actor, CAST(ts AS VARCHAR) AS timestamp FROM events
    WHERE event_id % 10 <> 3 ORDER BY ts DESC, event_id DESC LIMIT 50""")
def audit_tail(f):
    e = f.events
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    body = F.to_json(F.struct(stamp.alias("timestamp"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("actor"), "event_id"))
    # DuckDB prints no trailing zeros; neither does the log.
    log = e.select(F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{broken "), body)).otherwise(body).alias("value"))
    tail = files.read_audit_tail(log, "timestamp string, action string, actor string, event_id bigint", "timestamp", 50)
    trimmed = F.regexp_replace(F.regexp_replace("timestamp", r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return tail.select("event_id", "action", "actor", trimmed.alias("timestamp"))


# -------------------------------------------------------------------- documents
def invoice_documents(f):
    """Markdown invoices of every wholesale order, ten consecutive orders per file.

    One order in three uses bold labels and a four-column table; every second
    file carries a page marker.  An order is one document section, however many lines it has.
    """
    sku = f.product.select("product_id", "sku")
    lines = f.line.where("channel = 'wholesale'").join(sku, "product_id")
    amount = lambda c: F.concat(F.lit("$"), F.format_number(c, 2), F.lit(" USD"))
    plain = F.concat(F.lit("| "), F.col("quantity").cast("string"), F.lit(" | "), "sku", F.lit(".x | Item "), F.col("product_id").cast("string"),
                     F.lit(" | some, detail | "), amount("base_cost_price"), F.lit(" | "), amount("base_total"), F.lit(" |"))
    bold = F.concat(F.lit("| "), F.col("quantity").cast("string"), F.lit(" | "), "sku", F.lit(".x | Item "), F.col("product_id").cast("string"),
                    F.lit(" | **"), amount("base_cost_price"), F.lit("** | **"), amount("base_total"), F.lit("** |"))
    row = F.when(F.col("order_id") % 9 == 2, bold).otherwise(plain)
    table = lines.groupBy("order_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_id", row.alias("t")))), lambda r: r["t"]), "\n").alias("rows"),
        F.sum("base_total").alias("total"))
    o = f.order.where("channel = 'wholesale'").drop("total").join(table, "order_id")
    day = F.dayofmonth("order_date")
    suffix = F.when(day.isin(1, 21, 31), "st").when(day.isin(2, 22), "nd").when(day.isin(3, 23), "rd").otherwise("th")
    date = F.concat(day.cast("string"), suffix, F.date_format("order_date", " MMM yyyy"))
    name = F.concat(F.lit("Customer "), F.col("customer_id").cast("string"))
    is_bold = F.col("order_id") % 9 == 2
    label = lambda k, v: F.concat(F.when(is_bold, F.lit(f"**{k}:** ")).otherwise(F.lit(f"* {k}: ")), v, F.lit("\n"))
    text = F.concat(
        F.lit("## Order #"), F.col("order_id").cast("string"), F.lit("\n\n### Billing Details\n"), label("Name", name),
        label("Organization", F.concat(F.lit("Org "), (F.col("customer_id") % 50).cast("string"))), label("Email", F.concat(F.lit("c"), F.col("customer_id").cast("string"), F.lit("@example.com"))),
        label("Phone", F.when(F.col("order_id") % 2 == 0, F.lit("555-0100")).otherwise(F.lit("(not given)"))),
        F.lit("\n### Order Information\n"), label("Order Date", date), label("Payment Method", F.concat(F.lit("Net30 ("), F.lit("$"), F.format_number("total", 2), F.lit(")"))),
        label("Shipping Method", F.lit("UPS")), F.lit("\n### Order Items\n\n| Qty | Code/SKU | Product Name | Price | Total |\n|---|---|---|---|---|\n"), "rows",
        F.lit("\n\n### Summary\n"), label("Subtotal", amount("total")), label("Shipping", F.lit("$12.50 USD")), label("Tax", F.lit("$0.00 USD")),
        label("Grand total", amount(F.col("total") + F.lit(12.5).cast("decimal(4,2)"))), F.lit("\n---\n"),
    )
    file_no = F.floor(F.col("order_id") / 30)
    head = F.when(F.col("file_no") % 2 == 0, F.lit("# Invoices\n\n## Page 1\n\n")).otherwise(F.lit("# Invoices\n\n"))
    docs = o.select(file_no.alias("file_no"), "order_id", text.alias("t")).groupBy("file_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order_id", "t"))), lambda r: r["t"]), "\n").alias("body"))
    return docs.select(F.concat(F.lit("inv"), F.col("file_no").cast("string"), F.lit(".md")).alias("file_name"), F.concat(head, "body").alias("content"))


@query("scan_invoices", """SELECT 'inv' || CAST(order_id // 30 AS VARCHAR) || '.md' AS file_name, CAST(COUNT(DISTINCT order_id) AS BIGINT) AS orders
    FROM v_line WHERE channel = 'wholesale' GROUP BY 1""")
def scan_invoices(f):
    return invoices.split_orders(invoice_documents(f)).groupBy("file_name").agg(F.count("*").alias("orders"))


@query("invoice_parse", """SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(row_number() OVER (PARTITION BY order_id ORDER BY line_id) AS INTEGER) AS line_number,
    p.sku || '.x' AS sku, 'Item ' || CAST(product_id AS VARCHAR) AS product_name, CAST(quantity AS INTEGER) AS quantity, CAST(base_cost_price AS DOUBLE) AS unit_price,
    CAST(base_total AS DOUBLE) AS line_total FROM v_line JOIN v_product p USING (product_id) WHERE channel = 'wholesale'""")
def invoice_parse(f):
    rows = invoices.parse_lines(invoices.split_orders(invoice_documents(f)))
    return rows.withColumns({"unit_price": F.col("unit_price").cast("double"), "line_total": F.col("line_total").cast("double")})


@query("invoice_headers", """WITH t AS (SELECT order_id, SUM(base_total) AS total FROM v_line WHERE channel = 'wholesale' GROUP BY 1)
    SELECT CAST(order_id AS VARCHAR) AS order_id, order_date, 'Customer ' || CAST(customer_id AS VARCHAR) AS customer_name, 'Org ' || CAST(customer_id % 50 AS VARCHAR) AS company_name,
      'c' || CAST(customer_id AS VARCHAR) || '@example.com' AS customer_email, CASE WHEN order_id % 2 = 0 THEN '555-0100' ELSE '' END AS customer_phone,
      'UPS' AS shipping_method, 'Net30' AS payment_method, CAST(t.total AS DOUBLE) AS subtotal, CAST(12.5 AS DOUBLE) AS shipping, CAST(0 AS DOUBLE) AS tax, CAST(t.total + 12.5 AS DOUBLE) AS grand_total
    FROM v_order JOIN t USING (order_id)""")
def invoice_headers(f):
    h = invoices.parse_headers(invoices.split_orders(invoice_documents(f)))
    money = {c: F.col(c).cast("double") for c in ("subtotal", "shipping", "tax", "grand_total")}
    return h.withColumns(money).drop("file_name", "block_no", "billing_address", "shipping_address")


def item_xml(f):
    """Item snapshot elements as XML text."""
    from saleswell.operators.generators import xml_escape
    tag = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{name}>"), xml_escape(F.col(c).cast("string")), F.lit(f"</{name}>"))).otherwise("")
    ref = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"<{name}><ListID>1</ListID><FullName>"), xml_escape(F.col(c)), F.lit(f"</FullName></{name}>"))).otherwise("")
    return f.item.select(F.concat(
        F.lit("<ItemInventoryRet>"), tag("ListID", "list_id"), tag("EditSequence", "edit_sequence"), tag("FullName", "item_full_name"),
        F.lit("<IsActive>true</IsActive>"), tag("QuantityOnHand", "quantity"), tag("SalesPrice", "sales_price"), tag("PurchaseCost", "purchase_cost"),
        ref("IncomeAccountRef", "income_account"), ref("COGSAccountRef", "cogs_account"), ref("AssetAccountRef", "asset_account"),
        F.lit("</ItemInventoryRet>")).alias("xml"))


@query("parse_item_snapshot", """SELECT item_full_name, CAST(NULL AS VARCHAR) AS item_name, list_id, edit_sequence, true AS is_active, quantity, sales_price, purchase_cost,
    nullif(trim(income_account), '') AS income_account, nullif(cogs_account, '') AS cogs_account, nullif(asset_account, '') AS asset_account FROM v_item""")
def parse_item_snapshot(f):
    return accounting.item_columns(item_xml(f).select(accounting.parse_item_xml(F.col("xml")).alias("r")).select("r.*"))


@query("parse_responses", """SELECT o_orderkey AS event_id, CASE o_orderkey % 6 WHEN 0 THEN 'EMPTY_RESPONSE' WHEN 1 THEN 'PARSE_ERROR' WHEN 2 THEN 'NO_RS_NODE' WHEN 3 THEN '3100' ELSE '0' END AS status_code,
    CASE WHEN o_orderkey % 6 < 4 THEN 'Error' ELSE 'Info' END AS status_severity,
    CASE o_orderkey % 6 WHEN 0 THEN 'Empty response.' WHEN 1 THEN 'Unable to parse response.' WHEN 2 THEN 'No status node found in response.' WHEN 3 THEN 'name "a & b" in use' ELSE 'Status OK' END AS status_message,
    CASE WHEN o_orderkey % 6 >= 4 THEN 'T' || CAST(o_orderkey AS VARCHAR) END AS txn_id, CASE WHEN o_orderkey % 6 >= 3 THEN 'InventoryAdjustmentAdd' END AS txn_type, o_orderkey % 6 >= 4 AS success FROM orders""")
def parse_responses(f):
    k = F.col("o_orderkey") % 6
    ok = F.concat(F.lit('<?xml version="1.0"?><Q><M><InventoryAdjustmentAddRs requestID="1" statusCode="0" statusSeverity="Info" statusMessage="Status OK"><R><TxnID> T'),
                  F.col("o_orderkey").cast("string"), F.lit(" </TxnID></R></InventoryAdjustmentAddRs></M></Q>"))
    bad = F.lit('<Q><M><InventoryAdjustmentAddRs statusCode="3100" statusSeverity="Error" statusMessage="name &quot;a &amp; b&quot; in use"/></M></Q>')
    text = F.when(k == 0, F.lit("  ")).when(k == 1, F.lit("<Q><M></Q>")).when(k == 2, F.lit("<Q><M/></Q>")).when(k == 3, bad).otherwise(ok)
    rows = f.orders.select(F.col("o_orderkey").alias("event_id"), text.alias("response_xml"))
    return accounting.parse_response(rows).drop("response_xml")


@query("assemble_snapshot", "SELECT item_full_name, CAST(CASE WHEN length(item_full_name) % 2 = 0 THEN 3 ELSE 1 END AS INTEGER) AS page_no, CASE WHEN length(item_full_name) % 2 = 0 THEN quantity + 5 ELSE quantity END AS quantity, true AS complete FROM v_item")
def assemble_snapshot(f):
    """Three pages; items of even name length come again on the last one."""
    i = f.item.select("item_full_name", "quantity")
    one = i.select("item_full_name", "quantity", F.lit(1).alias("page_no"), F.lit(200).alias("remaining"))
    last = i.where(F.length("item_full_name") % 2 == 0).select("item_full_name", (F.col("quantity") + 5).alias("quantity"), F.lit(3).alias("page_no"), F.lit(0).alias("remaining"))
    return accounting.assemble_snapshot(one.unionByName(last))


# ---------------------------------------------------------------- text functions
_REPAIR = "text || ' ' || chr(8220) || 'it' || chr(8217) || 's' || chr(160) || chr(194) || chr(183) || chr(8221) || chr(7)"
_SANE = f"""replace(replace(replace(replace(replace({_REPAIR}, chr(194) || chr(183), chr(183)), chr(8217), ''''), chr(8220), '"'), chr(8221), '"'), chr(160), ' ')"""


@query("sanitize_text", f"""SELECT doc_id, length(clean) AS n, sha1(clean) AS digest FROM (SELECT doc_id,
    regexp_replace(replace(replace({_SANE}, chr(8216), ''''), chr(226) || chr(8364) || chr(8482), ''''), '[^\\x{{9}}\\x{{A}}\\x{{D}}\\x{{20}}-\\x{{D7FF}}\\x{{E000}}-\\x{{FFFD}}\\x{{10000}}-\\x{{10FFFF}}]', '', 'g') AS clean FROM documents) q""")
def sanitize_text(f):
    noise = F.lit(" “it’s Â·”\x07")
    clean = tx.sanitize_text(F.concat("text", noise))
    return f.documents.select("doc_id", F.length(clean).cast("bigint").alias("n"), F.sha1(clean).alias("digest"))


@query("truncate_hash", """SELECT p_partkey, CASE WHEN length(n) <= 31 THEN n ELSE substr(n, 1, 24) || '-' || upper(substr(sha1(n), 1, 6)) END AS name
    FROM (SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' account for wholesale sales' ELSE '' END || ' ' || p_type AS n FROM part) q""")
def truncate_hash(f):
    extra = F.when(F.col("p_partkey") % 2 == 0, F.lit(" account for wholesale sales")).otherwise(F.lit(""))
    return f.part.select("p_partkey", tx.truncate_name(F.concat("p_name", extra, F.lit(" "), "p_type")).alias("name"))


@query("deterministic_id", """SELECT o_orderkey, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substr('89ab', CAST(strpos('0123456789abcdef', h[17:17]) - 1 AS INTEGER) % 4 + 1, 1) || h[18:20], h[21:32]) AS id
    FROM (SELECT o_orderkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('order:' || CAST(o_orderkey AS VARCHAR))) AS h FROM orders) q""")
def deterministic_id(f):
    return f.orders.select("o_orderkey", tx.name_uuid(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))).alias("id"))


# ------------------------------------------------------------------ maintenance
_LO, _HI = dt.date(1999, 1, 1), dt.date(1999, 1, 31)
_IN = f"BETWEEN DATE '{_LO}' AND DATE '{_HI}'"


@query("window_reload", f"""SELECT business_date, msku, units FROM v_sku_day WHERE business_date NOT {_IN}
    UNION ALL SELECT business_date, msku, units + 1000 FROM v_sku_day WHERE business_date {_IN} AND day(business_date) % 2 = 0""")
def window_reload(f):
    old = f.sku_day.select("business_date", "msku", "units")
    inside = old.where(F.col("business_date").between(F.lit(_LO), F.lit(_HI)) & (F.dayofmonth("business_date") % 2 == 0))
    return mt.replace_window(old, inside.withColumn("units", F.col("units") + 1000), "business_date", _LO, _HI)


@query("key_reload", """SELECT settlement_id, shipment_id, 'old' AS origin FROM v_settle_wide WHERE settlement_id NOT LIKE 'S2000%'
    UNION ALL SELECT settlement_id, shipment_id, 'new' FROM v_settle_wide WHERE settlement_id LIKE 'S2000%' AND transaction_type = 'Order'""")
def key_reload(f):
    base = f.settle_wide.select("settlement_id", "shipment_id", "transaction_type")
    new = base.where(F.col("settlement_id").startswith("S2000") & (F.col("transaction_type") == "Order"))
    shape = lambda df, o: df.select("settlement_id", "shipment_id", F.lit(o).alias("origin"))
    return mt.replace_keys(shape(base, "old"), shape(new, "new"), ["settlement_id"])


@query("dim_refresh", """SELECT sku AS msku, CASE WHEN reorder_point = 7 THEN 0 ELSE cost END AS cost_per_unit, 'USD' AS currency, DATE '2020-01-01' AS valid_from,
    DATE '2099-12-31' AS valid_to, CAST(NULL AS DATE) AS updated_on, cogs_account, description, price FROM v_part_master WHERE reorder_point <> 13""")
def dim_refresh(f):
    from pyspark.sql import types as T
    target = T._parse_datatype_string("msku string, cost_per_unit double, currency string, valid_from date, valid_to date, updated_on date")
    new = parts.cost_dimension(parts.clean_parts(parts_file(f))).withColumn("price", F.col("price").cast("double"))
    return mt.refresh_dimension(new, target)


@query("upsert_parts", """WITH s AS (SELECT trim(sku) AS sku, max_by(cost, n) AS cost FROM (SELECT sku, cost + 1 AS cost, 1 AS n FROM v_part_master WHERE reorder_point > 20
      UNION ALL SELECT ' ' || sku, cost + 2, 2 FROM v_part_master WHERE reorder_point > 35 UNION ALL SELECT 'NEW-' || sku, cost, 3 FROM v_part_master WHERE reorder_point = 5) q GROUP BY 1)
    SELECT coalesce(t.sku, s.sku) AS sku, CASE WHEN s.sku IS NULL THEN t.cost ELSE s.cost END AS cost, t.description,
      CASE WHEN t.sku IS NULL THEN 'inserted' WHEN s.sku IS NULL THEN 'kept' ELSE 'updated' END AS change
    FROM (SELECT sku, cost, description FROM v_part_master) t FULL JOIN s ON s.sku = t.sku""")
def upsert_parts(f):
    return mt.upsert(f.part_master.select("sku", "cost", "description"), part_changes(f), "sku", "n")


def part_changes(f):
    """Cost changes of some parts, padded names among them, and new parts; the highest ``n`` counts."""
    p = f.part_master.select("sku", "cost", "description", "reorder_point")
    batch = lambda cond, sku, cost, n: p.where(cond).select(sku.alias("sku"), cost.alias("cost"), F.lit(n).alias("n"))
    return (
        batch("reorder_point > 20", F.col("sku"), F.col("cost") + 1, 1)
        .unionByName(batch("reorder_point > 35", F.concat(F.lit(" "), "sku"), F.col("cost") + 2, 2))
        .unionByName(batch("reorder_point = 5", F.concat(F.lit("NEW-"), "sku"), F.col("cost"), 3))
    )


# ---------------------------------------------------------------------- quality
def fact(f):
    return f.sku_day


_DAY = dt.date(2000, 5, 17)


@query("dq_partition", f"SELECT 'partition_present' AS check_name, CAST(COUNT(*) AS DOUBLE) AS value, COUNT(*) > 0 AS passed FROM v_sku_day WHERE business_date = DATE '{_DAY}'")
def dq_partition(f):
    return dq.partition_present(fact(f), _DAY)


@query("dq_volume", """SELECT business_date, COUNT(*) AS rows, COUNT(DISTINCT msku) AS skus, abs(COUNT(*) - COUNT(DISTINCT msku)) <= COUNT(DISTINCT msku) * 0.2 AS passed FROM v_sku_day GROUP BY 1""")
def dq_volume(f):
    return dq.volume_per_sku(fact(f))


@query("dq_zero_sum", """SELECT 'units_positive' AS check_name, CAST(SUM(units) AS DOUBLE) AS value, SUM(units) > 0 AS passed FROM v_sku_day
    UNION ALL SELECT 'net_sales_positive', CAST(SUM(net_sales) AS DOUBLE), SUM(net_sales) > 0 FROM v_sku_day""")
def dq_zero_sum(f):
    return dq.non_zero_totals(fact(f))


@query("dq_key_rate", f"""SELECT 'key_rate' AS check_name, {sql_ratio('COUNT(m)', 'COUNT(*)', digits=6)} AS value, {sql_ratio('COUNT(m)', 'COUNT(*)', digits=6)} > 0.99 AS passed
    FROM (SELECT CASE WHEN units % 40 = 0 THEN NULL ELSE msku END AS m FROM v_sku_day) q""")
def dq_key_rate(f):
    return dq.key_rate(fact(f).withColumn("msku", F.when(F.col("units") % 40 != 0, F.col("msku"))))


@query("dq_unique", """SELECT 'unique_key' AS check_name, CAST(COUNT(*) AS DOUBLE) AS value, COUNT(*) = 0 AS passed FROM (SELECT 1 FROM v_sku_day GROUP BY business_date, msku HAVING COUNT(*) > 1) q""")
def dq_unique(f):
    return dq.uniqueness(fact(f))


@query("dq_duplicates", "SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def dq_duplicates(f):
    return dq.duplicate_keys(f.lineitem, ["l_orderkey", "l_linenumber"])


@query("drift_checks", f"""WITH d AS (SELECT business_date, CAST(SUM(net_sales) AS DOUBLE) AS net, {sql_ratio('abs(SUM(fees))', 'SUM(net_sales)', digits=6)} AS fr FROM v_sku_day GROUP BY 1),
    j AS (SELECT a.business_date, a.net, a.fr, median(b.net) AS mn, median(b.fr) AS mf, COUNT(b.business_date) AS past FROM d a LEFT JOIN d b
      ON b.business_date BETWEEN a.business_date - 14 AND a.business_date - 1 GROUP BY 1, 2, 3)
    SELECT business_date, net AS net_sales, {sql_round('mn', 2)} AS median_net, past AS past_days, fr AS fee_ratio, {sql_round('mf', 6)} AS median_fee_ratio,
      coalesce(abs(net - mn) > abs(mn) * 0.5, false) AS sales_alert, coalesce(fr > mf * 1.5, false) AS fee_alert FROM j""")
def drift_checks(f):
    return dq.drift(fact(f))


@query("ad_budget", "SELECT business_date, CAST(SUM(ad_spend) AS DOUBLE) AS ad_spend, CAST(SUM(ad_spend) AS DOUBLE) > 5000 AS over_budget FROM v_sku_day GROUP BY 1")
def ad_budget(f):
    return dq.ad_budget(fact(f), 5000)
