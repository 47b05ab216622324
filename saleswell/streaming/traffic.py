"""Windowed web-traffic KPIs.  Every function takes a static or a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LATE_DAYS = "7 days"  # fixed value: the re-read window of the batch loads


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp; the feed's is local wall-clock time."""
    return df.withColumn("event_time", F.col(column).cast("timestamp"))


def _kpis() -> list[Column]:
    money = F.col("value").cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    return [
        F.count_if(F.col("event_type") == "view").alias("sessions"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.sum(F.when(F.col("event_type") == "purchase", money).otherwise(zero)).alias("revenue"),
    ]


def daily_kpi(events: DataFrame, watermark: str | None = LATE_DAYS) -> DataFrame:
    """Tumbling day.  In append mode a day comes out once the watermark has passed it."""
    e = event_time(events)
    e = e.withWatermark("event_time", watermark) if watermark else e
    return e.groupBy(F.window("event_time", "1 day").alias("w")).agg(*_kpis())


def sliding_kpi(events: DataFrame, width: str = "7 days", step: str = "1 day", watermark: str | None = LATE_DAYS) -> DataFrame:
    e = event_time(events)
    e = e.withWatermark("event_time", watermark) if watermark else e
    return e.groupBy(F.window("event_time", width, step).alias("w")).agg(*_kpis())


def session_kpi(events: DataFrame, gap: str = "30 minutes", watermark: str | None = "1 day") -> DataFrame:
    """Sessions per user; a session's state goes as soon as the watermark closes it."""
    e = event_time(events)
    e = e.withWatermark("event_time", watermark) if watermark else e
    return e.groupBy("user_id", F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("events"), *_kpis())


def unique_orders(events: DataFrame, key: str = "transaction_id", watermark: str = "1 day") -> DataFrame:
    """First row per key; a key is remembered for the watermark delay only."""
    return event_time(events).withWatermark("event_time", watermark).dropDuplicatesWithinWatermark([key])


def window_columns(df: DataFrame) -> DataFrame:
    """Window bounds as wall-clock timestamps and revenue as a number."""
    wall = lambda c: F.col(c).cast("timestamp_ntz")
    return df.select(
        wall("w.start").alias("window_start"), wall("w.end").alias("window_end"), *[c for c in df.columns if c not in ("w", "revenue")],
        F.col("revenue").cast("double").alias("revenue"),
    )
