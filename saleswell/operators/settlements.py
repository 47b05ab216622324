"""Settlement flat files: wide rows to one row per amount component."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from saleswell.functions.text import parse_timestamp

_AMOUNT = "decimal(18,2)"


def _amount(name: str) -> Column:
    """Blank or non-numeric text counts as zero.

    Blanks, the common case, become NULL before the cast: a failing cast costs
    an exception per value.
    """
    return F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")).try_cast(_AMOUNT), F.lit(0).cast(_AMOUNT))


def _first_text(*parts: str | Column) -> Column:
    cols = [F.nullif(F.col(p), F.lit("")) if isinstance(p, str) else p for p in parts]
    return F.coalesce(*cols)


def _quantity() -> Column:
    return F.coalesce(F.nullif(F.trim("quantity_purchased"), F.lit("")), F.lit("0")).try_cast("bigint")


def unparsable_rows(wide: DataFrame) -> DataFrame:
    """Rows whose quantity is not an integer; the unpivot leaves them out whole."""
    return wide.where(_quantity().isNull())


def _posted(wide: DataFrame) -> Column:
    """Posting time; the older column name is the fall-back where the newer one is blank."""
    return parse_timestamp(_first_text(*[c for c in ("posted_date", "posted_date_time") if c in wide.columns]))


def _cells() -> dict[str, tuple[Column, Column]]:
    """Label and amount of each component."""
    return {
        "Price": (_first_text("price_type", F.lit("Principal")), _amount("price_amount")),
        "Fee": (
            _first_text("item_fee_type", "order_fee_type", "shipment_fee_type", F.lit("Fee")),
            _amount("item_fee_amount") + _amount("order_fee_amount") + _amount("shipment_fee_amount"),
        ),
        "Promotion": (_first_text("promotion_type", F.lit("Promotion")), _amount("promotion_amount")),
        "Other": (
            _first_text("other_reason", F.lit("Other")),
            _amount("other_fee_amount") + _amount("other_amount") + _amount("misc_fee_amount"),
        ),
    }


def settled_orders(wide: DataFrame) -> DataFrame:
    """``order_id, posted_date`` of the rows that keep any component: the count needs no unpivoting."""
    cells = _cells()
    sold = (cells["Price"][0] == "Principal") & (_quantity() > 0)
    kept = sold
    for _, amount in cells.values():
        kept = kept | (amount != 0)
    return wide.where(_quantity().isNotNull() & kept).select("order_id", _posted(wide).cast("date").alias("posted_date"))


TEXTS = (
    "settlement_id", "currency", "transaction_type", "order_id", "merchant_order_id", "adjustment_id", "shipment_id",
    "marketplace_name", "fulfillment_id", "sku",
)
TIMES = ("settlement_start_date", "settlement_end_date", "deposit_date")


def unpivot(wide: DataFrame, keep: tuple[str, ...] | None = None, ingested_at: dt.datetime | None = None) -> DataFrame:
    """Up to four components per row: price, fee, promotion, other.

    Zero components vanish, except the principal price of a row that sold
    something.  No shuffle, no UDF.
    Settlement period, deposit time and total come along where the file has them; ``ingested_at`` is the caller's.
    """
    has = lambda names: [c for c in names if c in wide.columns]
    keep = keep or tuple(has(TEXTS))
    cells = _cells()
    parts = F.array(*[
        F.struct(F.lit(kind).alias("amount_type"), label.alias("amount_description"), amount.cast(_AMOUNT).alias("amount"))
        for kind, (label, amount) in cells.items()
    ])
    qty = F.col("quantity_purchased")
    # Times are parsed beside the array, once a row: what stands beside ``inline`` itself is computed for each component.
    # Components go after it, not by a filter over the array, which no generated code evaluates.  The array is never
    # empty: ``inline_outer`` keeps the optimizer from building it once more, below, to ask for its size.
    rows = wide.withColumn("quantity_purchased", _quantity()).where(qty.isNotNull()).select(
        *keep,
        *[parse_timestamp(F.col(c)).alias(c) for c in has(TIMES)],
        *[_amount(c).alias(c) for c in has(("total_amount",))],
        _posted(wide).alias("posted_date_time"),
        qty,
        parts.alias("_parts"),
    )
    beside = [c for c in rows.columns if c != "_parts"]
    stamped = [F.lit(ingested_at).alias("ingested_at")] if ingested_at else []
    keeps = (F.col("amount") != 0) | ((F.col("amount_type") == "Price") & (F.col("amount_description") == "Principal") & (qty > 0))
    out = rows.select(*beside, F.inline_outer("_parts")).where(keeps)
    return out.select(*beside, *stamped, F.col("posted_date_time").cast("date").alias("posted_date"), "amount_type", "amount_description", "amount")
