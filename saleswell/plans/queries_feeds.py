"""Registered queries that land feeds as files and take them in with the readers, exports and streams of the library."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from saleswell.functions import keys
from saleswell.functions.numeric import parse_bool
from saleswell.plans import queries_ingest as ingest
from saleswell.plans.registry import REGISTRY, query
from saleswell.session import work_folder
from saleswell.sources import files, invoices, parts
from saleswell.streaming import jobs

_EXPORTED = f"SELECT * EXCLUDE (is_active) FROM ({REGISTRY['clean_parts'].source}) q"
_MONEY = ("unit_price", "line_total")


def _exported(f, kind):
    path, raw = work_folder(f.spark, f"parts-{kind}"), ingest.parts_file(f)
    parts.export_parts(raw, path, kind)
    # JSON is read by name, CSV by place: both in the order of the file's headers.
    return parts.read_parts(f.spark, path, [field for header, field in parts.PART_COLUMNS.items() if header in raw.columns], kind)


@query("parts_jsonl", _EXPORTED)
def parts_jsonl(f):
    """The cleaned master file as typed JSON lines, read back."""
    return _exported(f, "json")


@query("parts_csv", _EXPORTED)
def parts_csv(f):
    """The cleaned master file as CSV, read back with its types."""
    return _exported(f, "csv")


@query("parts_export_counts", """SELECT CAST(COUNT(*) FILTER (reorder_point <> 13) AS BIGINT) AS written, CAST(COUNT(*) FILTER (reorder_point = 13) AS BIGINT) AS skipped FROM v_part_master""")
def parts_export_counts(f):
    """What an export wrote and left out, counted by the write."""
    counts = parts.export_parts(ingest.parts_file(f), work_folder(f.spark, "parts-counted"))
    return f.spark.createDataFrame([counts], "written bigint, skipped bigint")


_FIELDS = {"item_full_name": ("qbItemFullName", "Full Name"), "cogs_account": ("cogsAccountFullName", "COGS Account"), "purchase_cost": ("Purchase Cost", "Cost"), "sales_price": ("salesPrice", "Price"), "quantity": ("Quantity On Hand", "TOTAL")}


@query("resolved_headers", """SELECT item_full_name, cogs_account, CAST(CAST(cost AS DECIMAL(18,2)) AS VARCHAR) AS purchase_cost, CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR) AS sales_price, CAST(NULL AS VARCHAR) AS quantity FROM v_part_master""")
def resolved_headers(f):
    """A file whose headers differ in case and marks from the wanted ones, and which lacks a required one: taken in part."""
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    raw = f.part_master.select(F.col("item_full_name").alias("FULL_NAME"), F.col("cogs_account").alias("c.o.g.s. account"), money("cost").alias("Cost "), money("price").alias("sales-price"), F.col("sku").alias("other"))
    return keys.with_fields(raw, _FIELDS, ["item_full_name", "quantity"], allow_partial=True)


_TOKENS = (" TRUE", "1", "yes ", "Y", "False", "0", "no", "N", "", "2", "maybe")


@query("parse_bools", f"""SELECT p_partkey, CASE WHEN p_partkey % {len(_TOKENS)} < 4 THEN true WHEN p_partkey % {len(_TOKENS)} < 8 THEN false END AS flag FROM part""")
def parse_bools(f):
    token = F.get(F.array(*map(F.lit, _TOKENS)), (F.col("p_partkey") % len(_TOKENS)).cast("int"))
    return f.part.select("p_partkey", parse_bool(token).alias("flag"))


def _landed_invoices(f):
    """The invoices as whole-text files of up to a thousand documents: a few megabytes, so that there are few to list and open."""
    path = work_folder(f.spark, "invoices")
    ingest.invoice_documents(f).select("content").write.option("maxRecordsPerFile", 1000).text(path)
    return path


def _money(rows):
    return rows.withColumns({c: F.col(c).cast("double") for c in _MONEY})


@query("invoice_files", REGISTRY["invoice_parse"].source)
def invoice_files(f):
    """Invoice files read whole, split at their orders and parsed."""
    return _money(invoices.parse_lines(invoices.split_orders(files.read_documents(f.spark, _landed_invoices(f), "*.txt"))))


@query("invoice_stream", REGISTRY["invoice_parse"].source)
def invoice_stream(f):
    """A folder of invoices as a stream of new files, into the line table."""
    path, out = _landed_invoices(f), work_folder(f.spark, "invoice-lines")
    jobs.ingest_invoices(jobs.invoice_stream(f.spark, path, pattern="*.txt"), f"{out}/headers", f"{out}/lines", f"{out}/ckpt")
    return _money(f.spark.read.parquet(f"{out}/lines").drop("batch"))


@query("queue_snapshots", """SELECT 0 AS batch, qb_status, CAST(COUNT(*) AS BIGINT) AS events FROM v_event WHERE event_id % 2 = 0 GROUP BY 2 UNION ALL SELECT 1, qb_status, COUNT(*) FROM v_event GROUP BY 2""")
def queue_snapshots(f):
    """Counts by status after each of two batches of the queue."""
    path = work_folder(f.spark, "snapshots")
    for half in (0, 1):  # a file stream takes files in the order they appear
        f.event.where(F.col("event_id") % 2 == half).select("event_id", "qb_status").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stamps = itertools.count()
    jobs.status_snapshots(jobs.parquet_stream(f.spark, f"{path}/in", files_per_trigger=1), f"{path}/out", f"{path}/ckpt", lambda: str(next(stamps)))
    return f.spark.read.schema("qb_status string, events bigint, taken_at string, batch int").json(f"{path}/out").select("batch", "qb_status", "events")


@query("load_json_inferred", "SELECT event_id, user_id, event_type, CAST(value AS DOUBLE) AS value FROM events")
def load_json_inferred(f):
    """JSON lines staged with the schema they show."""
    path = work_folder(f.spark, "staged")
    f.events.select("event_id", "user_id", "event_type", F.col("value").cast("double").alias("value")).write.json(f"{path}/in")
    rows = files.load_jsonl_inferred(f.spark, f"{path}/in", f"{path}/out")
    return rows.select("event_id", "user_id", "event_type", "value")


@query("latest_report", "SELECT order_date, CAST(COUNT(*) AS BIGINT) AS orders FROM v_order WHERE channel = 'wholesale' GROUP BY 1")
def latest_report(f):
    """Of three daily reports in a folder the one written last."""
    path = work_folder(f.spark, "latest")
    for channel in ("storefront", "marketplace", "wholesale"):
        daily = f.order.where(F.col("channel") == channel).groupBy("order_date").agg(F.count("*").alias("orders"))
        daily.coalesce(1).write.mode("append").parquet(path)
    return f.spark.read.parquet(files.latest_file(f.spark, path, "*.parquet"))
