"""Parts master file: column map, cleaning, export shape."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from saleswell.functions.numeric import parse_number

# Source header -> field of the master file.
PART_COLUMNS = {
    "Active Status": "active_status",
    "Type": "item_type",
    "Sku": "sku",
    "Description": "description",
    "Sales Tax Code": "sales_tax_code",
    "Account": "income_account",
    "COGS Account": "cogs_account",
    "Asset Account": "asset_account",
    "Accumulated Depreciation": "accumulated_depreciation",
    "Purchase Description": "purchase_description",
    "Quantity On Hand (2025)": "opening_qty",
    "U/M": "unit",
    "U/M Set": "unit_set",
    "Cost": "cost",
    "Preferred Vendor": "preferred_vendor",
    "Tax Agency": "tax_agency",
    "Price": "price",
    "Reorder Pt (Min)": "reorder_point",
    "MPN": "mpn",
    "Category": "category",
}
NUMERIC_PARTS = ("accumulated_depreciation", "opening_qty", "cost", "price", "reorder_point")


def _typed(raw: DataFrame) -> DataFrame:
    present = {h: f for h, f in PART_COLUMNS.items() if h in raw.columns}
    return raw.select(*[
        (parse_number(F.col(f"`{h}`")) if f in NUMERIC_PARTS else F.trim(F.coalesce(F.col(f"`{h}`"), F.lit("")))).alias(f)
        for h, f in present.items()
    ])


def clean_parts(raw: DataFrame) -> DataFrame:
    """Trimmed strings, tolerant numbers, rows without a SKU dropped.

    Works on whichever mapped columns the file has; SKUs stay text even when
    they look like numbers.
    """
    return _typed(raw).where(F.col("sku") != "").withColumn("is_active", F.lower("active_status") == "active")


def export_parts(raw: DataFrame, path: str, kind: str = "json") -> tuple[int, int]:
    """Write the cleaned file as ``json`` lines (types kept, every field present) or ``csv``; (rows written, rows without a SKU).

    Both counts are observed in the write itself.
    """
    if kind not in ("json", "csv"):
        raise ValueError(f"kind must be json or csv: {kind!r}")
    seen = Observation(f"parts-{uuid.uuid4().hex}")
    named = F.col("sku") != ""
    rows = _typed(raw).observe(seen, F.count_if(named).alias("written"), F.count_if(~named).alias("skipped")).where(named)
    writer = rows.write.mode("overwrite")
    writer.option("ignoreNullFields", False).json(path) if kind == "json" else writer.options(header=True, escape='"', emptyValue="").csv(path)
    return seen.get["written"], seen.get["skipped"]


def read_parts(spark: SparkSession, path: str, fields: list[str], kind: str = "json") -> DataFrame:
    """An export read back, numbers as numbers and all else as text."""
    schema = ", ".join(f"{c} {'double' if c in NUMERIC_PARTS else 'string'}" for c in fields)
    reader = spark.read.schema(schema)
    df = reader.json(path) if kind == "json" else reader.options(header=True, escape='"').csv(path)
    return df.fillna("", [c for c in fields if c not in NUMERIC_PARTS])


def cost_dimension(parts: DataFrame, valid_from: str = "2020-01-01", valid_to: str = "2099-12-31") -> DataFrame:
    """Cost dimension rows from a cleaned master file."""
    return parts.select(
        F.col("sku").alias("msku"), F.col("cost").cast("decimal(38,9)").alias("cost_per_unit"), F.lit("USD").alias("currency"),
        F.lit(valid_from).cast("date").alias("valid_from"), F.lit(valid_to).cast("date").alias("valid_to"),
        "cogs_account", "description", F.col("price").cast("decimal(38,9)").alias("price"),
    )
