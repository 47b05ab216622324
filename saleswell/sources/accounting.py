"""Accounting-side feeds: item snapshots and response documents (XML)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from saleswell.functions.numeric import parse_bool

_REF = "struct<FullName: string>"
ITEM_SCHEMA = (
    "ListID string, EditSequence string, Name string, FullName string, IsActive string, QuantityOnHand string, "
    f"SalesPrice string, PurchaseCost string, IncomeAccountRef {_REF}, COGSAccountRef {_REF}, AssetAccountRef {_REF}"
)


def read_item_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Inventory items of a snapshot file set; other item types are not read."""
    raw = spark.read.format("xml").option("rowTag", "ItemInventoryRet").schema(ITEM_SCHEMA).load(path)
    return item_columns(raw)


def parse_item_xml(text: Column) -> Column:
    return F.from_xml(text, ITEM_SCHEMA)


def item_columns(raw: DataFrame) -> DataFrame:
    """Typed item columns; unreadable numbers and flags are NULL, nameless items go."""
    clean = lambda path: F.nullif(F.trim(F.col(path)), F.lit(""))
    number = lambda path: F.trim(F.col(path)).try_cast("double")
    return raw.select(
        F.coalesce(clean("FullName"), clean("Name")).alias("item_full_name"),
        clean("Name").alias("item_name"), clean("ListID").alias("list_id"), clean("EditSequence").alias("edit_sequence"),
        parse_bool(F.col("IsActive")).alias("is_active"), number("QuantityOnHand").alias("quantity"),
        number("SalesPrice").alias("sales_price"), number("PurchaseCost").alias("purchase_cost"),
        clean("IncomeAccountRef.FullName").alias("income_account"),
        clean("COGSAccountRef.FullName").alias("cogs_account"),
        clean("AssetAccountRef.FullName").alias("asset_account"),
    ).where(F.col("item_full_name").isNotNull())


def assemble_snapshot(pages: DataFrame) -> DataFrame:
    """Union of snapshot pages: the latest page wins per item.

    ``pages`` carries ``page_no, remaining``.  ``complete`` tells on every row whether the last page
    (remaining = 0) has come; an unfinished list is returned as far as it is known.
    """
    # The completeness flag is one row, so broadcasting it is bounded.
    done = pages.agg(F.coalesce(F.min("remaining") == 0, F.lit(False)).alias("complete"))
    others = [c for c in pages.columns if c not in ("item_full_name", "remaining")]
    latest = pages.groupBy("item_full_name").agg(F.max(F.struct("page_no", *[c for c in others if c != "page_no"])).alias("r"))
    flagged = latest.withColumn("_k", F.lit(0)).join(F.broadcast(done.withColumn("_k", F.lit(0))), "_k")
    return flagged.select("item_full_name", "r.*", "complete")


def parse_response(responses: DataFrame, column: str = "response_xml") -> DataFrame:
    """Status of each response text; empty, malformed and status-less ones become errors."""
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    # Fixed value: a response node name ends in Rs and carries statusCode.
    node = r"<(?:\w+:)?(\w+)Rs\b([^>]*\bstatusCode\s*=[^>]*)>"
    attrs = F.regexp_extract(text, node, 2)
    attr = lambda name: F.regexp_extract(attrs, name + r'\s*=\s*["\']([^"\']*)["\']', 1)
    kind = F.regexp_extract(text, node, 1)
    probe = F.from_xml(
        text, "_corrupt string, _probe string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    body = F.regexp_extract(text, r"<TxnID>\s*([^<]*?)\s*</TxnID>", 1)
    balanced = probe["_corrupt"].isNull()
    failure = (
        F.when(text == "", F.lit("EMPTY_RESPONSE")).when(~balanced, F.lit("PARSE_ERROR")).when(kind == "", F.lit("NO_RS_NODE"))
    )
    fixed = {
        "EMPTY_RESPONSE": "Empty response.",
        "PARSE_ERROR": "Unable to parse response.",
        "NO_RS_NODE": "No status node found in response.",
    }
    message = F.coalesce(*[F.when(failure == k, F.lit(v)) for k, v in fixed.items()], _unescape(attr("statusMessage")))
    code = F.coalesce(failure, attr("statusCode"))
    severity = F.when(failure.isNotNull(), F.lit("Error")).otherwise(F.coalesce(F.nullif(attr("statusSeverity"), F.lit("")), F.lit("Error")))
    ok = failure.isNull()
    return responses.withColumns({
        "status_code": code,
        "status_severity": severity,
        "status_message": message,
        "txn_id": F.when(ok, F.nullif(body, F.lit(""))),
        "txn_type": F.when(ok, kind),
        "success": code.isin("0", "1") & (F.lower(severity) != "error"),
    })


def _unescape(text: Column) -> Column:
    for entity, char in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text
