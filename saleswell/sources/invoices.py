"""Markdown invoices: one or many orders per document, parsed with columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from saleswell.functions.text import parse_ordinal_date

# How an order header and an order number read.
ORDER_HEADER = r"(?i)\n(?=#{1,3}[^\n]*order #\d+)"
ORDER_ID = r"(?i)(?:order #|order: #)(\d+)"


def split_orders(documents: DataFrame) -> DataFrame:
    """One row per order block: ``file_name, block_no, block``.

    Blocks start at every order header, whether or not the file also has page
    markers, so each order keeps its own lines.
    """
    blocks = documents.select(
        "file_name", F.posexplode(F.split(F.concat(F.lit("\n"), "content"), ORDER_HEADER)).alias("block_no", "block")
    )
    return blocks.where(F.contains(F.lower("block"), F.lit("order #")) & (order_id(F.col("block")) != ""))


def order_id(block: Column) -> Column:
    return F.regexp_extract(block, ORDER_ID, 1)


def _label(block: Column, *labels: str) -> Column:
    """Value after ``* Label:`` or ``**Label:**``; NULL when absent or blank."""
    names = "|".join(labels)
    found = F.regexp_extract(block, rf"(?im)^[*\s]*(?:\*\*)?(?:{names}):(?:\*\*)?[ \t]*([^\n]*)$", 1)
    return F.nullif(F.trim(F.regexp_replace(found, r"^\*+|\*+$", "")), F.lit(""))


def _section(block: Column, heading: str) -> Column:
    """Text under a heading, up to the next heading, rule or bold order label."""
    titled = F.filter(F.split(block, r"\n#+[ \t]*"), lambda part: F.lower(part).startswith(heading))
    body = F.coalesce(F.get(titled, F.lit(0)), F.lit(""))
    for mark in ("\n---", "\n**Order"):
        body = F.substring_index(body, mark, 1)
    return F.substring(body, len(heading) + 1, 1 << 30)


def _amount(block: Column, label: str) -> Column:
    text = F.regexp_extract(block, rf"(?i){label}.*?\$?([\d,]*\d[\d,.]*)", 1)
    return F.coalesce(F.regexp_replace(text, r"[^\d.]", "").try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def parse_headers(blocks: DataFrame) -> DataFrame:
    b = F.col("block")
    # Cut once, as five values are read from it.
    blocks = blocks.withColumn("_billing", _section(b, "billing details"))
    billing = F.col("_billing")
    name, company = _label(billing, "Name"), _label(billing, "Company", "Organization")
    email = F.regexp_extract(billing, r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})", 1)
    phone = F.regexp_extract(billing, r"(?im)^[*\s]*(?:\*\*)?Phone:(?:\*\*)?[ \t]*([\d\-() +]*\d[\d\-() +]*)", 1)
    date = F.regexp_extract(b, r"(?i)Order Date:.*?(\d+(?:st|nd|rd|th)?\s+\w+\s+\d{4})", 1)
    shipping_method = _label(b, "Shipping Method")
    # An amount in brackets may follow the method.
    payment = F.rtrim(F.substring_index(_label(b, "Payment Method"), "($", 1))
    summary = F.regexp_extract(b, r"(?is)(Subtotal.*)\z", 1)
    address = _label(billing, "Address")
    return blocks.select(
        "file_name", "block_no",
        order_id(b).alias("order_id"),
        parse_ordinal_date(date).alias("order_date"),
        F.coalesce(name, company, F.lit("")).alias("customer_name"),
        F.coalesce(company, F.lit("")).alias("company_name"),
        email.alias("customer_email"), F.trim(phone).alias("customer_phone"),
        F.coalesce(address, F.lit("")).alias("billing_address"), F.coalesce(address, F.lit("")).alias("shipping_address"),
        F.coalesce(shipping_method, F.lit("")).alias("shipping_method"),
        _amount(summary, "Subtotal").alias("subtotal"), _amount(summary, "Shipping").alias("shipping"),
        _amount(summary, "Tax").alias("tax"), _amount(summary, "Grand total").alias("grand_total"),
        F.coalesce(payment, F.lit("")).alias("payment_method"),
    )


def parse_lines(blocks: DataFrame) -> DataFrame:
    """Line rows of every block, numbered in table order.

    A table row is cut at its bars: quantity, SKU and name come first, price and
    total last, whatever stands between.  Heads, rules and other tables have no whole
    number in the first cell or no amounts in the last two.
    """
    b = F.col("block")
    cells = lambda row: F.transform(F.split(F.trim(F.trim(row), F.lit("|")), r"\|"), lambda cell: F.trim(cell))
    money = lambda cell: F.trim(F.translate(F.replace(cell, F.lit("USD"), F.lit("")), "*$,", "")).try_cast("decimal(18,2)")
    parsed = lambda c: F.struct(
        F.get(c, F.lit(1)).alias("sku"), F.get(c, F.lit(2)).alias("product_name"), F.get(c, F.lit(0)).try_cast("int").alias("quantity"),
        money(F.get(c, F.size(c) - 2)).alias("unit_price"), money(F.get(c, F.size(c) - 1)).alias("line_total"),
    )
    rows = F.filter(F.split(b, "\n"), lambda line: F.startswith(line, F.lit("|")))
    # Heads and rules go before their amounts are read: a text that is no number costs far more than one that is.
    is_line = lambda c: (F.size(c) >= 5) & F.get(c, F.lit(0)).try_cast("int").isNotNull() & F.get(c, F.lit(1)).rlike(r"^[\w.\-]+$")
    priced = lambda r: r["unit_price"].isNotNull() & r["line_total"].isNotNull()
    lines = F.filter(F.transform(F.filter(F.transform(rows, cells), is_line), parsed), priced)
    return blocks.select(order_id(b).alias("order_id"), F.posexplode(lines).alias("pos", "r")).select(
        "order_id", (F.col("pos") + 1).alias("line_number"), "r.*"
    )
