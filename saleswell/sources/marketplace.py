"""Marketplace feeds: nested economics rows and traffic report documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from saleswell.sources.files import read_jsonl

_MONEY = "struct<amount: double>"
ECONOMICS_SCHEMA = (
    "startDate string, endDate string, msku string, childAsin string, fnsku string, marketplaceId string, "
    f"sales struct<unitsOrdered: bigint, orderedProductSales: {_MONEY}, refundedProductSales: {_MONEY}, netProductSales: {_MONEY}>, "
    f"fees array<struct<feeTypeName: string, charges: array<struct<aggregatedDetail: struct<totalAmount: {_MONEY}>>>>>, "
    f"ads array<struct<adTypeName: string, charge: struct<totalAmount: {_MONEY}>>>, "
    f"netProceeds struct<total: {_MONEY}>"
)
TRAFFIC_SCHEMA = (
    "reportSpecification struct<dataStartTime: string>, salesAndTrafficByAsin array<struct<date: string, parentAsin: string, "
    "childAsin: string, sku: string, trafficByAsin: struct<sessions: bigint, pageViews: bigint, buyBoxPercentage: double, "
    f"unitSessionPercentage: double>, salesByAsin: struct<unitsOrdered: bigint, orderedProductSales: {_MONEY}>>>"
)
MONEY = "decimal(38,9)"


def _sum(items: Column, pick) -> Column:
    """Exact sum of an array; a missing array or amount counts as zero."""
    zero = F.lit(0).cast(MONEY)
    values = F.transform(F.coalesce(items, F.array()), lambda x: F.coalesce(pick(x).cast(MONEY), zero))
    return F.aggregate(values, zero, lambda a, v: (a + v).cast(MONEY))


def fee_total(fees: Column) -> Column:
    charges = F.flatten(F.transform(fees, lambda f: F.coalesce(f["charges"], F.array())))
    return F.when(fees.isNull(), F.lit(0).cast(MONEY)).otherwise(
        _sum(charges, lambda c: c["aggregatedDetail"]["totalAmount"]["amount"])
    )


def ad_total(ads: Column) -> Column:
    return F.when(ads.isNull(), F.lit(0).cast(MONEY)).otherwise(_sum(ads, lambda a: a["charge"]["totalAmount"]["amount"]))


def flatten_economics(raw: DataFrame, query_id: str, document_id: str, ingested_at) -> DataFrame:
    """Typed SKU-day rows from nested economics; amounts default to zero."""
    amount = lambda path: F.coalesce(F.col(path).cast(MONEY), F.lit(0).cast(MONEY))
    return raw.select(
        F.col("startDate").cast("date").alias("business_date"),
        F.col("marketplaceId").alias("marketplace"),
        "msku", F.col("childAsin").alias("asin"), "fnsku",
        F.col("sales.unitsOrdered").alias("units"),
        amount("sales.orderedProductSales.amount").alias("gross_sales"),
        amount("sales.refundedProductSales.amount").alias("refunds"),
        amount("sales.netProductSales.amount").alias("net_sales"),
        fee_total(F.col("fees")).alias("fees"),
        ad_total(F.col("ads")).alias("ad_spend"),
        amount("netProceeds.total.amount").alias("net_proceeds"),
        F.lit(query_id).alias("source_query_id"),
        F.lit(document_id).alias("source_document_id"),
        F.lit(ingested_at).cast("timestamp").alias("ingested_at"),
    )


def read_economics(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, ECONOMICS_SCHEMA)


def read_traffic(spark: SparkSession, path: str) -> DataFrame:
    """Report documents, one JSON object per file."""
    return spark.read.schema(TRAFFIC_SCHEMA).option("multiLine", True).json(path)


def flatten_traffic(documents: DataFrame) -> DataFrame:
    """One row per entry.  The report's start date and the ASIN fill what an entry lacks.

    Entries whose date does not parse are left out.
    """
    e = documents.select(
        F.col("reportSpecification.dataStartTime").alias("spec"), F.explode("salesAndTrafficByAsin").alias("e")
    )
    text = F.coalesce(F.nullif("e.date", F.lit("")), F.col("spec"))
    day = F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    asin = F.coalesce(F.nullif("e.childAsin", F.lit("")), F.nullif("e.parentAsin", F.lit("")))
    num = lambda path, kind: F.coalesce(F.col(path), F.lit(0)).cast(kind)
    return e.where(text.isNull() | day.isNotNull()).select(
        day.alias("report_date"),
        F.coalesce(F.nullif("e.sku", F.lit("")), asin).alias("msku"),
        asin.alias("asin"),
        num("e.trafficByAsin.sessions", "bigint").alias("sessions"),
        num("e.trafficByAsin.pageViews", "bigint").alias("page_views"),
        num("e.trafficByAsin.buyBoxPercentage", "double").alias("buy_box_percentage"),
        num("e.trafficByAsin.unitSessionPercentage", "double").alias("unit_session_percentage"),
        num("e.salesByAsin.unitsOrdered", "bigint").alias("units_ordered"),
        num("e.salesByAsin.orderedProductSales.amount", MONEY).alias("ordered_sales"),
    )
