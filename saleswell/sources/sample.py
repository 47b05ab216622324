"""Canonical commerce views over the star-schema test tables.

The test tables are not commerce feeds, so each feed the operators read is
derived from them by a deterministic projection.  One portable SELECT per view
serves Spark and the SQL oracle; ``@table`` marks a base table.  The operators
never see this module: they take DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _sku(key: str) -> str:
    return (
        f"(CASE {key} % 6 WHEN 0 THEN 'BTKN-' WHEN 1 THEN 'bta-' WHEN 2 THEN 'TR-' "
        f"WHEN 3 THEN 'trk-' WHEN 4 THEN 'web-' ELSE 'tweb-' END || CAST({key} AS STRING))"
    )


def _channel(key: str) -> str:
    return f"CASE {key} % 3 WHEN 0 THEN 'storefront' WHEN 1 THEN 'marketplace' ELSE 'wholesale' END"


def _pick(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


_THIRD = "CAST(({k} - {k} % 3) / 3 AS BIGINT)"
_EXT = "CAST(l_extendedprice AS DECIMAL(18,2))"
_DISC = "CAST(l_discount AS DECIMAL(4,2))"
_TAX = "CAST(l_tax AS DECIMAL(4,2))"
_RETAIL = "CAST(p_retailprice AS DECIMAL(18,2))"
_LINE_ID = (
    "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || "
    "CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)"
)
_SHIP = "CAST(l_shipdate AS DATE)"
_SHIP_TEXT = f"CAST({_SHIP} AS STRING)"
_WEB_DAY = "CAST(ts - INTERVAL '276' MONTH AS DATE)"
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_DAY_MS = {
    "spark": "unix_date(CAST({d} AS DATE)) * CAST(86400000 AS BIGINT)",
    "duck": "CAST(epoch_ms(CAST(CAST({d} AS DATE) AS TIMESTAMP)) AS BIGINT)",
}

# view -> portable SELECT, or {"spark": ..., "duck": ...} where the dialects part.
VIEWS: dict[str, str | dict[str, str]] = {
    "v_order": f"""
        SELECT o_orderkey AS order_id, {_channel('o_orderkey')} AS channel, o_custkey AS customer_id,
               CAST(o_orderdate AS DATE) AS order_date,
               {_pick(_THIRD.format(k='o_orderkey') + ' % 9', ['2', '10', '11', '3', '8', '0', '5', '6', '4'])} AS status,
               CAST(o_totalprice AS DECIMAL(18,2)) AS total,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) - 1.25 AS DECIMAL(18,2)) AS sub_total
        FROM @orders""",
    "v_line": f"""
        SELECT {_LINE_ID} AS line_id, l_orderkey AS order_id, {_channel('l_orderkey')} AS channel,
               l_partkey AS product_id, l_partkey * 4 + l_suppkey % 4 AS variant_id,
               CAST(l_quantity AS BIGINT) AS quantity,
               CASE WHEN l_linenumber = 7 THEN CAST(0 AS DECIMAL(18,2))
                    ELSE CAST({_EXT} * (1 - {_DISC}) AS DECIMAL(18,2)) END AS total_ex_tax,
               CASE WHEN l_linenumber = 7 THEN CAST(0 AS DECIMAL(18,2)) ELSE {_EXT} END AS base_total,
               CASE WHEN l_returnflag = 'A' THEN CAST(0 AS DECIMAL(18,2))
                    ELSE CAST(100 + (l_partkey % 1000) * 0.5 AS DECIMAL(18,2)) END AS base_cost_price
        FROM @lineitem""",
    "v_refund": f"""
        SELECT l_orderkey AS order_id, {_channel('l_orderkey')} AS channel, {_LINE_ID} AS line_id,
               CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS quantity,
               {_EXT} AS requested_amount
        FROM @lineitem WHERE l_returnflag = 'R'""",
    "v_product": f"""
        SELECT p_partkey AS product_id, {_sku('p_partkey')} AS sku, p_name AS product_name,
               CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS brand,
               {_RETAIL} AS price, CAST({_RETAIL} * 0.6 AS DECIMAL(18,2)) AS cost_price,
               CAST(p_size AS BIGINT) AS inventory_level, p_type AS product_type
        FROM @part""",
    "v_variant": {
        dialect: f"""
        SELECT p_partkey * 4 + i AS variant_id, p_partkey AS product_id,
               CASE i WHEN 0 THEN '' WHEN 1 THEN {_sku('p_partkey')} || '-v1'
                      WHEN 2 THEN upper({_sku('p_partkey')}) || '-V2' END AS variant_sku
        FROM {source}"""
        for dialect, source in {
            "spark": "(SELECT p_partkey, explode(array(0, 1, 2, 3)) AS i FROM @part)",
            "duck": "(SELECT p_partkey, unnest([0, 1, 2, 3]) AS i FROM @part)",
        }.items()
    },
    "v_cost": f"""
        SELECT CASE WHEN p_partkey % 2 = 1 THEN upper({_sku('p_partkey')}) ELSE lower({_sku('p_partkey')}) END AS msku,
               CAST({_RETAIL} * 0.5 AS DECIMAL(18,2)) AS cost_per_unit, DATE '1990-01-01' AS valid_from,
               CASE WHEN p_partkey % 5 = 1 THEN DATE '1998-06-30' END AS valid_to
        FROM @part WHERE p_partkey % 5 <> 0
        UNION ALL
        SELECT lower({_sku('p_partkey')}), CAST({_RETAIL} * 0.6 AS DECIMAL(18,2)), DATE '1998-07-01', CAST(NULL AS DATE)
        FROM @part WHERE p_partkey % 5 = 1
        UNION ALL
        SELECT ' ' || upper({_sku('p_partkey')}) || '-V1 ', CAST({_RETAIL} * 0.45 AS DECIMAL(18,2)),
               DATE '1990-01-01', CAST(NULL AS DATE)
        FROM @part WHERE p_partkey % 5 = 2""",
    "v_sku_day": f"""
        SELECT business_date, msku, asin, units, gross_sales, refunds,
               CAST(gross_sales + refunds AS DECIMAL(18,2)) AS net_sales, fees, ad_spend,
               CAST(gross_sales + refunds + fees - ad_spend AS DECIMAL(18,2)) AS net_proceeds
        FROM (SELECT business_date, msku, asin, units, gross_sales, refunds,
                     CAST(gross_sales * -0.15 AS DECIMAL(18,2)) AS fees,
                     CAST(gross_sales * 0.05 AS DECIMAL(18,2)) AS ad_spend
              FROM (SELECT {_SHIP} AS business_date,
                           {_sku('l_partkey')} || CASE WHEN l_partkey % 10 = 3 THEN '-m' ELSE '' END AS msku,
                           'B' || CAST(l_partkey AS STRING) AS asin,
                           CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units,
                           CAST(SUM({_EXT}) AS DECIMAL(18,2)) AS gross_sales,
                           CAST(-SUM(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN {_EXT} ELSE 0 END)
                                AS DECIMAL(18,2)) AS refunds
                    FROM @lineitem WHERE l_orderkey % 3 = 1
                    GROUP BY {_SHIP}, l_partkey) g) h""",
    "v_traffic": f"""
        SELECT {_SHIP} AS report_date, {_sku('l_partkey')} AS msku, 'B' || CAST(l_partkey AS STRING) AS asin,
               CAST(SUM(CAST(l_quantity AS BIGINT) * 4 + l_suppkey % 7) AS BIGINT) AS sessions,
               CAST(SUM(CAST(l_quantity AS BIGINT) * 9) AS BIGINT) AS page_views,
               CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units_ordered,
               CAST(SUM({_EXT}) AS DECIMAL(18,2)) AS ordered_sales
        FROM @lineitem WHERE l_orderkey % 3 = 1 AND l_partkey % 4 <> 0
        GROUP BY {_SHIP}, l_partkey""",
    "v_settle_wide": f"""
        SELECT 'S' || substr({_SHIP_TEXT}, 1, 4) || substr({_SHIP_TEXT}, 6, 2) AS settlement_id,
               substr({_SHIP_TEXT}, 1, 8) || '01T00:00:00Z' AS settlement_start_date, substr({_SHIP_TEXT}, 1, 8) || '28T00:00:00Z' AS settlement_end_date,
               CASE WHEN l_linenumber = 5 THEN '' ELSE '03.' || substr({_SHIP_TEXT}, 6, 2) || '.' || substr({_SHIP_TEXT}, 1, 4) END AS deposit_date,
               CASE WHEN l_linenumber = 1 THEN CAST({_EXT} AS STRING) ELSE '' END AS total_amount, 'USD' AS currency,
               'M' || CAST(l_orderkey AS STRING) AS merchant_order_id, CASE WHEN l_returnflag = 'R' THEN 'A' || CAST(l_suppkey AS STRING) ELSE '' END AS adjustment_id,
               CASE WHEN l_suppkey % 2 = 0 THEN 'us' ELSE 'ca' END AS marketplace_name, CASE WHEN l_suppkey % 4 = 0 THEN 'MFN' ELSE 'AFN' END AS fulfillment_id,
               CASE WHEN l_returnflag = 'R' THEN 'Refund' ELSE 'Order' END AS transaction_type,
               CAST(l_orderkey AS STRING) AS order_id, {_LINE_ID} AS shipment_id,
               CASE WHEN l_partkey % 5 = 0
                    THEN substr({_SHIP_TEXT}, 9, 2) || '.' || substr({_SHIP_TEXT}, 6, 2) || '.' || substr({_SHIP_TEXT}, 1, 4)
                    WHEN l_partkey % 97 = 13 THEN 'soon' WHEN l_partkey % 7 = 3 THEN '' ELSE {_SHIP_TEXT} || 'T00:00:00Z' END AS posted_date,
               CASE WHEN l_partkey % 7 = 3 THEN {_SHIP_TEXT} || 'T06:30:00Z' ELSE '' END AS posted_date_time,
               {_sku('l_partkey')} AS sku,
               CASE WHEN l_partkey % 50 = 7 THEN 'x' WHEN l_linenumber = 6 THEN ''
                    ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS quantity_purchased,
               CASE WHEN l_linenumber = 3 THEN 'Shipping' ELSE '' END AS price_type,
               CASE WHEN l_linenumber = 7 THEN '' WHEN l_partkey % 50 = 9 THEN 'n/a' ELSE CAST({_EXT} AS STRING) END AS price_amount,
               CASE WHEN l_linenumber % 2 = 0 THEN 'Commission' ELSE '' END AS item_fee_type,
               CASE WHEN l_tax = 0 THEN '' ELSE CAST(CAST({_EXT} * {_TAX} * -1 AS DECIMAL(18,2)) AS STRING) END AS item_fee_amount,
               CASE WHEN l_linenumber = 1 THEN 'ShippingHB' ELSE '' END AS order_fee_type,
               CASE WHEN l_linenumber = 1 THEN '-1.50' ELSE '' END AS order_fee_amount,
               CASE WHEN l_suppkey % 3 = 0 THEN 'FBA transport' ELSE '' END AS shipment_fee_type,
               CASE WHEN l_suppkey % 3 = 0 THEN '-0.75' ELSE '' END AS shipment_fee_amount,
               CASE WHEN l_linenumber = 2 THEN 'Coupon' ELSE '' END AS promotion_type,
               CASE WHEN l_discount = 0 THEN '' ELSE CAST(CAST({_EXT} * {_DISC} * -1 AS DECIMAL(18,2)) AS STRING) END AS promotion_amount,
               CASE WHEN l_suppkey % 5 = 0 THEN 'Storage' ELSE '' END AS other_reason,
               CASE WHEN l_suppkey % 5 = 0 THEN '-2.00' ELSE '' END AS other_fee_amount,
               CASE WHEN l_suppkey % 10 = 0 THEN '2.00' ELSE '' END AS other_amount, '' AS misc_fee_amount
        FROM @lineitem WHERE l_orderkey % 3 = 1""",
    "v_web": f"""
        SELECT event_id, {_WEB_DAY} AS event_day, replace(CAST({_WEB_DAY} AS STRING), '-', '') AS event_date,
               CASE event_type WHEN 'view' THEN 'session_start' ELSE event_type END AS event_name,
               'u' || CAST(user_id AS STRING) AS user_pseudo_id,
               CASE WHEN {_K} BETWEEN 20 AND 29 THEN 'Organic' WHEN {_K} = 30 THEN NULL ELSE 'cpc' END AS medium,
               CASE WHEN {_K} < 10 THEN 'Organic Search' WHEN {_K} < 20 THEN 'Organic Social'
                    WHEN {_K} = 31 THEN NULL ELSE 'Paid Search' END AS channel_group,
               CAST(value AS DECIMAL(18,2)) AS purchase_revenue,
               't' || CAST(event_id - event_id % 2 AS STRING) AS transaction_id
        FROM @events""",
    "v_backfill": """
        SELECT CAST(o_orderdate AS DATE) AS day, CAST(COUNT(*) * 10 AS BIGINT) AS sessions,
               CAST(COUNT(*) * 7 AS BIGINT) AS users
        FROM @orders WHERE o_orderdate < TIMESTAMP '2001-01-11 00:00:00' GROUP BY CAST(o_orderdate AS DATE)""",
    "v_ads": f"""
        SELECT {_WEB_DAY} AS segments_date,
               CAST(CAST(value AS DECIMAL(18,2)) * 1000000 AS BIGINT) AS cost_micros
        FROM @events WHERE event_type = 'click'""",
    "v_billing": """
        SELECT o_orderkey AS order_id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE n_name END AS company, c_name AS full_name
        FROM @orders JOIN @customer ON c_custkey = o_custkey JOIN @nation ON n_nationkey = c_nationkey""",
    "v_sku_category": f"""
        SELECT {_sku('p_partkey')} AS sku, p_brand AS category FROM @part WHERE p_partkey % 7 <> 0
        UNION ALL
        SELECT upper({_sku('p_partkey')}) || '-V1', p_brand FROM @part WHERE p_partkey % 7 <> 0""",
    "v_product_category": {
        dialect: f"""
        SELECT p_partkey AS product_id, i AS category_id,
               CASE i WHEN 0 THEN p_type WHEN 1 THEN 'Sale' ELSE p_brand END AS category_name
        FROM {source} WHERE p_partkey % 7 <> 0"""
        for dialect, source in {
            "spark": "(SELECT p_partkey, p_type, p_brand, explode(array(0, 1, 2)) AS i FROM @part)",
            "duck": "(SELECT p_partkey, p_type, p_brand, unnest([0, 1, 2]) AS i FROM @part)",
        }.items()
    },
    # --- inventory side -----------------------------------------------------
    "v_part_master": f"""
        SELECT {_sku('p_partkey')} AS sku, p_name AS description, p_brand AS category,
               CASE WHEN p_partkey % 9 = 2 THEN ' ' ELSE 'Sales:' || p_type END AS income_account,
               CASE WHEN p_partkey % 5 = 0 THEN 'COG''s:' || p_brand ELSE 'COGS:Parts & Labor' END AS cogs_account,
               '12100 · Inventory Asset' AS asset_account,
               CAST(CAST({_RETAIL} * 0.6 AS DECIMAL(18,2)) AS DOUBLE) AS cost, p_retailprice AS price,
               CAST(p_size AS DOUBLE) AS reorder_point,
               CASE WHEN p_partkey % 8 = 0 THEN 'Inactive' ELSE 'Active' END AS active_status,
               CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 = 0 END AS is_active,
               CASE p_partkey % 4 WHEN 0 THEN 'Parts:' || {_sku('p_partkey')} WHEN 1 THEN NULL
                    WHEN 2 THEN {_sku('p_partkey')} ELSE 'Old:' || {_sku('p_partkey')} END AS item_full_name,
               CAST(p_size * 2 - 10 AS DOUBLE) AS opening_qty,
               CASE WHEN p_partkey % 13 = 0 THEN 'Service' WHEN p_partkey % 13 = 1 THEN 'Inventory Assembly'
                    ELSE 'Inventory Part' END AS item_type
        FROM @part""",
    "v_item": f"""
        SELECT CASE WHEN p_partkey % 4 = 0 THEN 'Parts:' || {_sku('p_partkey')} ELSE upper({_sku('p_partkey')}) END AS item_full_name,
               'L' || CAST(p_partkey AS STRING) AS list_id,
               CASE WHEN p_partkey % 21 = 5 THEN NULL ELSE 'E' || CAST(p_partkey % 10 AS STRING) END AS edit_sequence,
               CAST(p_size * 2 - 10 AS DOUBLE) + CASE WHEN p_partkey % 6 = 1 THEN 1.0 WHEN p_partkey % 6 = 2 THEN 0.0000001 ELSE 0.0 END AS quantity,
               CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE p_retailprice END AS sales_price,
               CAST(CAST({_RETAIL} * 0.6 AS DECIMAL(18,2)) AS DOUBLE) AS purchase_cost,
               CASE WHEN p_partkey % 9 = 2 THEN '' WHEN p_partkey % 3 = 0 THEN 'Sales' ELSE ' sales : ' || p_type END AS income_account,
               CASE WHEN p_partkey % 5 = 0 THEN 'COGS' ELSE '5000 - COGS:Parts and Labor-1A2B3C' END AS cogs_account,
               'Inventory  Asset' AS asset_account
        FROM @part WHERE p_partkey % 9 <> 4
        UNION ALL
        SELECT 'Only:' || s_name, 'S' || CAST(s_suppkey AS STRING), 'E0', s_acctbal, CAST(NULL AS DOUBLE),
               CAST(NULL AS DOUBLE), '', '', ''
        FROM @supplier""",
    "v_location": """
        SELECT s_suppkey AS location_id, 'LOC-' || CAST(s_suppkey AS STRING) AS code, s_name AS display_name,
               s_suppkey % 10 <> 3 AS active,
               CASE WHEN s_suppkey % 6 = 5 THEN NULL ELSE 'Site ' || CAST(s_suppkey % 4 AS STRING) END AS site_name,
               s_suppkey % 12 = 1 AS is_virtual
        FROM @supplier""",
    "v_event": {
        dialect: f"""
        SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 4 = 0 THEN 'transfer' ELSE 'adjustment' END AS event_type,
               CASE WHEN o_orderkey % 17 = 0 THEN 'voided' WHEN o_orderkey % 19 = 0 THEN 'draft' ELSE 'committed' END AS status,
               CAST(o_orderdate AS DATE) AS effective_date,
               {ms.format(d='o_orderdate')} + o_orderkey AS created_at,
               CASE WHEN o_orderkey % 5 = 0 THEN 'zero-cleanup' ELSE 'user' || CAST(o_custkey % 7 AS STRING) END AS created_by,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'memo ' || CAST(o_custkey % 50 AS STRING) END AS memo,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'pending' WHEN '2' THEN 'in_flight' WHEN '3' THEN 'applied'
                    WHEN '4' THEN 'error' ELSE 'not_ready' END AS qb_status,
               CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '4') THEN {_pick('o_orderkey % 4', ["'3100'", "'500'", "'3140'", 'NULL'])} END AS error_code,
               CAST(o_orderkey % 11 AS INT) AS retry_count,
               {ms.format(d='o_orderdate')} + o_custkey * 1000 AS retry_at,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE {ms.format(d='o_orderdate')} + o_orderkey * 2 END AS last_attempt_at
        FROM @orders"""
        for dialect, ms in _DAY_MS.items()
    },
    "v_event_line": f"""
        SELECT {_LINE_ID} AS line_id, l_orderkey AS event_id, {_sku('l_partkey')} AS sku,
               CASE WHEN l_orderkey % 5 = 0 AND l_orderkey % 4 <> 0 THEN 0.0
                    WHEN l_orderkey % 4 = 0 OR l_returnflag <> 'R' THEN l_quantity ELSE -l_quantity END AS qty,
               CASE WHEN l_orderkey % 4 = 0 THEN NULL WHEN l_orderkey % 5 = 0 THEN 0.0
                    WHEN l_orderkey % 4 = 1 THEN l_quantity END AS new_qty,
               CASE WHEN l_orderkey % 4 = 0 THEN l_suppkey END AS from_location_id,
               CASE WHEN l_orderkey % 4 = 0 THEN l_partkey % 10 END AS to_location_id,
               CASE WHEN l_orderkey % 4 <> 0 THEN l_suppkey END AS location_id,
               CASE WHEN l_linenumber = 1 THEN NULL ELSE 'R' || CAST(l_linenumber AS STRING) END AS reason_code
        FROM @lineitem""",
    "v_reason": """
        SELECT 'R' || CAST(r_regionkey + 2 AS STRING) AS reason_code, 'COGS:Shrink ' || r_name AS account_full_name
        FROM @region""",
}


def view_sql(name: str, dialect: str) -> str:
    body = VIEWS[name]
    return body if isinstance(body, str) else body[dialect]


def _used_views(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def oracle(sql: str) -> str:
    """Complete a DuckDB query: define the canonical views it mentions."""
    body = sql.strip()
    ctes = [f"{v} AS ({view_sql(v, 'duck').replace('@', '').strip()})" for v in _used_views(body)]
    if not ctes:
        return body
    head = ",\n".join(ctes)
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(opening):
            return f"{opening}{head},\n{body[len(opening):]}"
    return f"WITH {head}\n{body}"


class Feeds:
    """Lazily opened canonical views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._open: dict[str, DataFrame] = {}

    def base(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def view(self, name: str) -> DataFrame:
        sql = view_sql(name, "spark")
        return self.spark.sql(re.sub(r"@(\w+)", lambda m: f"parquet.`{self.folder}/{m.group(1)}.parquet`", sql))

    def __getattr__(self, name: str) -> DataFrame:
        view = f"v_{name}"
        if view not in VIEWS and name not in BASE_TABLES:
            raise AttributeError(name)
        if name not in self._open:
            self._open[name] = self.view(view) if view in VIEWS else self.base(name)
        return self._open[name]
