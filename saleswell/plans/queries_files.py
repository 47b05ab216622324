"""Registered queries that write files to the work folder and read them back with the real readers and sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from saleswell.operators import maintenance as mt, runs, sketches, versions as vs
from saleswell.operators.settlements import unpivot
from saleswell.plans import queries_ingest as ingest
from saleswell.plans.registry import REGISTRY, query
from saleswell.session import work_folder
from saleswell.sources import accounting, files, marketplace

ITEMS_PER_FILE = 100_000  # about 60 MB of XML
TIMES = ("settlement_start_date", "settlement_end_date", "deposit_date", "posted_date_time", "ingested_at")


def _again(name: str) -> str:
    """SQL of another query, over the raw views it names."""
    return REGISTRY[name].source


@query("economics_gz", _again("economics_flatten"))
def economics_gz(f):
    """Gzip JSON lines, read with the feed's schema."""
    path = work_folder(f.spark, "economics")
    ingest.economics_text(f).write.option("compression", "gzip").text(path)
    flat = marketplace.flatten_economics(files.read_jsonl(f.spark, path, marketplace.ECONOMICS_SCHEMA), "q1", "d1", ingest.LOADED)
    cols = ("gross_sales", "refunds", "net_sales", "fees", "ad_spend", "net_proceeds")
    return flat.withColumns({c: F.col(c).cast("double") for c in cols}).drop("source_query_id", "source_document_id", "ingested_at")


@query("settlement_tsv_file", f"SELECT * REPLACE (nullif(adjustment_id, '') AS adjustment_id) FROM ({_again('settlement_unpivot')}) q")
def settlement_tsv_file(f):
    """Tab-separated settlement files with dashed column names."""
    path = work_folder(f.spark, "settlements")
    wide = f.settle_wide
    wide.toDF(*[c.replace("_", "-") for c in wide.columns]).write.options(sep="\t", header=True, quote="\u0000", emptyValue="").csv(path)
    out = unpivot(files.read_tsv(f.spark, path), ingested_at=dt.datetime(2002, 1, 1))
    return out.withColumns({**{c: F.col(c).cast("string") for c in TIMES}, **{c: F.col(c).cast("double") for c in ("amount", "total_amount")}})


@query("item_xml_file", _again("parse_item_snapshot"))
def item_xml_file(f):
    """XML files, one element per item, cut at the row tag by the reader."""
    path = work_folder(f.spark, "items")
    ref = lambda c: F.when(F.col(c) != "", F.struct(F.col(c).alias("FullName")))
    rows = f.item.select(
        F.col("list_id").alias("ListID"), F.col("edit_sequence").alias("EditSequence"), F.col("item_full_name").alias("FullName"), F.lit("true").alias("IsActive"),
        F.col("quantity").alias("QuantityOnHand"), F.col("sales_price").alias("SalesPrice"), F.col("purchase_cost").alias("PurchaseCost"),
        ref("income_account").alias("IncomeAccountRef"), ref("cogs_account").alias("COGSAccountRef"), ref("asset_account").alias("AssetAccountRef"))
    # A file of elements over several lines is read by one task, so its size is bounded, and the rows of one small table file are dealt first.
    writer = rows.repartition("ListID").write.format("xml").option("maxRecordsPerFile", ITEMS_PER_FILE)
    writer.option("rowTag", "ItemInventoryRet").option("rootTag", "Items").save(path)
    return accounting.read_item_snapshot(f.spark, path)


@query("publish_roundtrip", "SELECT order_id, status, CAST(total AS DOUBLE) AS total FROM v_order WHERE channel = 'wholesale'")
def publish_roundtrip(f):
    """A second version replaces the first; a failed third leaves it current."""
    table = work_folder(f.spark, "published")
    orders = f.order.select("order_id", "channel", "status", F.col("total").cast("double").alias("total"))
    mt.publish(orders, table)
    checked = lambda ok: lambda df: df.agg((F.count("*") > (0 if ok else 1 << 60)).alias("passed")).withColumn("check_name", F.lit("rows"))
    mt.publish(orders.where("channel = 'wholesale'"), table, checked(True))
    try:
        mt.publish(orders.where("channel = 'storefront'"), table, checked(False))
    except ValueError:
        pass
    return mt.read_table(f.spark, table).drop("channel")


@query("append_evolving", """SELECT order_id, status, CAST(NULL AS BIGINT) AS customer_id FROM v_order WHERE channel = 'wholesale'
    UNION ALL SELECT order_id, status, customer_id FROM v_order WHERE channel = 'storefront'""")
def append_evolving(f):
    """The second append brings a column that the first lacks."""
    path = work_folder(f.spark, "evolving")
    mt.append_evolving(f.order.where("channel = 'wholesale'").select("order_id", "status"), path)
    mt.append_evolving(f.order.where("channel = 'storefront'").select("order_id", "status", "customer_id"), path)
    return mt.read_evolving(f.spark, path).select("order_id", "status", "customer_id")


@query("write_fact_pruned", "SELECT business_date, msku, units FROM v_sku_day WHERE business_date BETWEEN DATE '1999-01-01' AND DATE '1999-03-31'")
def write_fact_pruned(f):
    """The whole fact written by day; the range reads its days' folders only."""
    path = work_folder(f.spark, "fact")
    mt.write_fact(f.sku_day.select("business_date", "msku", "units"), path, "business_date", ["msku"])
    days = F.col("business_date").between(F.lit(dt.date(1999, 1, 1)), F.lit(dt.date(1999, 3, 31)))
    return f.spark.read.schema("msku string, units bigint, business_date date").parquet(path).where(days).select("business_date", "msku", "units")


@query("bucketed_join", "SELECT o.channel, l.product_id, CAST(SUM(l.quantity) AS BIGINT) AS quantity FROM v_order o JOIN v_line l USING (order_id) GROUP BY 1, 2")
def bucketed_join(f):
    """Orders and lines in the same buckets of order_id: the join reads them side by side, without a shuffle."""
    path = work_folder(f.spark, "bucketed")
    name = lambda kind: f"{kind}_{path.rsplit('-', 1)[1]}"
    order_rows, line_rows = f.order.select("order_id", "channel"), f.line.select("order_id", "product_id", "quantity")
    buckets = mt.bucket_count(max(order_rows.count(), line_rows.count()), least=8)
    orders = mt.write_bucketed(order_rows, name("orders"), f"{path}/orders", ["order_id"], buckets)
    lines = mt.write_bucketed(line_rows, name("lines"), f"{path}/lines", ["order_id"], buckets)
    return orders.join(lines, "order_id").groupBy("channel", "product_id").agg(F.sum("quantity").alias("quantity"))


@query("export_report", "SELECT sku, item_full_name, CAST(CAST(cost AS DECIMAL(18,2)) AS VARCHAR) AS cost FROM v_part_master")
def export_report(f):
    """CSV with a header and a fixed column order, names with commas and quotes included."""
    path = work_folder(f.spark, "export")
    mt.export_report(f.part_master.withColumn("cost", F.col("cost").cast("decimal(18,2)")), path, ["sku", "item_full_name", "cost"])
    return files.read_csv(f.spark, path)


@query("land_raw", "SELECT event_id, event_type, CAST(year(ts) AS INTEGER) AS run FROM events")
def land_raw(f):
    """Raw rows as gzip JSON lines under one folder per run."""
    path = work_folder(f.spark, "raw")
    mt.land_raw(f.events.select("event_id", "event_type", F.year("ts").alias("run")), path, ["run"])
    return files.read_jsonl(f.spark, path, "event_id bigint, event_type string, run int")


# ------------------------------------------- files of many layouts and encodings
def _write_reports(f, lines, name):
    """One file per value of ``file``, in two sub-folders, its lines by ``place``."""
    path = work_folder(f.spark, name)
    lines.repartition("file").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").text(f"{path}-parts")
    fs, of = mt._fs(f.spark, path)
    for k, folder in enumerate(sorted(s.getPath().toString() for s in fs.listStatus(of(f"{path}-parts")) if s.isDirectory())):
        target = of(f"{path}/{k % 2}/{folder.rsplit('file=', 1)[1]}.csv")
        fs.mkdirs(target.getParent())
        (part,) = [s.getPath() for s in fs.listStatus(of(folder)) if s.getPath().getName().startswith("part-")]
        fs.rename(part, target)
    return path


_EVEN = "month(business_date) % 2 = 0"
_FILE = "'Econ ' || month(business_date) || '-1-' || {yy} || ' to ' || month(business_date) || '-' || day(last_day(business_date)) || '-' || {yy}"


def _month_reports(f):
    """Sales by month with two header lines; the columns of odd and even months differ in order and name."""
    facts = f.sku_day.withColumn("file", F.expr(_FILE.format(yy="date_format(business_date, 'yy')"))).withColumn("even", F.expr(_EVEN))
    even, odd = F.concat_ws(",", "msku", "asin", "units", "fees"), F.concat_ws(",", "msku", "fees", "units", "asin")
    body = facts.select("file", F.lit(2).alias("place"), F.when(F.col("even"), even).otherwise(odd).alias("value"))
    heads = facts.select("file", "even").distinct().select("file", F.posexplode(F.when(F.col("even"), F.array(F.lit("Product,,Sales,"), F.lit("SKU,ASIN,Units,Fees"), F.lit(",,,")))
        .otherwise(F.array(F.lit("Product,Sales,,Info"), F.lit("SKU,Fees,Units,ASIN"), F.lit(" , ,,")))).alias("place", "value"))
    return body.unionByName(heads)


_REPORT = f"""SELECT *, {_FILE.format(yy="strftime(business_date, '%y')")} || '.csv' AS file, {_EVEN} AS even,
    make_date(2000 + CAST(year(business_date) % 100 AS INTEGER), month(business_date), 1) AS first_day, day(last_day(business_date)) AS last FROM v_sku_day"""


@query("two_row_header_csv", f"""SELECT CASE WHEN NOT even THEN asin END AS info_asin, CASE WHEN even THEN asin END AS product_asin, msku AS product_sku,
    CAST(fees AS VARCHAR) AS sales_fees, CAST(units AS VARCHAR) AS sales_units, first_day AS report_start_date, first_day + CAST(last - 1 AS INTEGER) AS report_end_date, file AS source_file FROM ({_REPORT}) q""")
def two_row_header_csv(f):
    """Report files in nested folders, with two header lines and two layouts, read in one pass of heads and one of bodies."""
    return files.read_reports(f.spark, _write_reports(f, _month_reports(f), "reports"))


@query("recursive_reports", f"SELECT file AS source_file, even, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(units) AS DOUBLE) AS units FROM ({_REPORT}) q GROUP BY 1, 2")
def recursive_reports(f):
    """What each report file of a folder tree holds."""
    rows = files.numeric_columns(files.read_reports(f.spark, _write_reports(f, _month_reports(f), "reports")), ["sales_units"])
    return rows.groupBy("source_file", F.col("product_asin").isNotNull().alias("even")).agg(F.count("*").alias("n"), F.sum("sales_units").alias("units"))


@query("mixed_encodings", """SELECT sku, description || ' ' || chr(233) || CASE CAST(reorder_point AS BIGINT) % 3 WHEN 2 THEN chr(129) ELSE chr(8217) END AS description, cost FROM
    (SELECT sku, description, reorder_point, CAST(CAST(cost AS DECIMAL(18,2)) AS VARCHAR) AS cost FROM v_part_master) q""")
def mixed_encodings(f):
    """CSV files in UTF-8, windows-1252 and Latin-1 below one folder, each decoded by its own bytes."""
    path = work_folder(f.spark, "encodings")
    for k, (encoding, mark) in enumerate((("utf-8", "\u2019"), ("iso-8859-1", "\u0092"), ("iso-8859-1", "\u0081"))):  # byte 92 is a windows-1252 quote, 81 undefined there
        rows = f.part_master.where(F.col("reorder_point").cast("bigint") % 3 == k)
        marked = rows.select("sku", F.concat("description", F.lit(f" \u00e9{mark}")).alias("description"), F.col("cost").cast("decimal(18,2)").alias("cost"))
        marked.write.options(header=True, encoding=encoding, escape='"').csv(f"{path}/{k}")
    return files.read_csv_any_encoding(f.spark, path, "*.csv").select("sku", "description", "cost")


# ------------------------------------------------------------ versioned tables
_FROM, _TO = dt.date(1999, 1, 10), dt.date(1999, 2, 20)
_WINDOW = f"BETWEEN DATE '{_FROM}' AND DATE '{_TO}'"


def _run_of(rows):
    """The folder of the write that a row's file came from."""
    return F.regexp_extract(F.input_file_name(), "/data/([0-9a-f]{32})/", 1)


@query("window_manifest", f"""SELECT business_date, msku, units, business_date >= DATE '1999-01-01' AND business_date < DATE '1999-03-01' AS rewritten
    FROM (SELECT business_date, msku, units FROM v_sku_day WHERE business_date NOT {_WINDOW}
      UNION ALL SELECT business_date, msku, units + 1000 FROM v_sku_day WHERE business_date {_WINDOW} AND day(business_date) % 2 = 0) q""")
def window_manifest(f):
    """Six weeks of a table by months reloaded: the two months they meet are rewritten, every other folder stays."""
    table = work_folder(f.spark, "window-manifest")
    facts = f.sku_day.select("business_date", "msku", "units")
    first = vs.create(facts, table, vs.by_date("business_date", "month"), ["msku"])
    inside = facts.where(F.col("business_date").between(F.lit(_FROM), F.lit(_TO)) & (F.dayofmonth("business_date") % 2 == 0))
    vs.reload_window(table, inside.withColumn("units", F.col("units") + 1000), _FROM, _TO, ["msku"])
    rows = vs.read(f.spark, table)
    old = {folder.split("/")[1] for _, folder in first.entries}
    return rows.select("business_date", "msku", "units", (~_run_of(rows).isin(*old)).alias("rewritten"))


@query("window_manifest_read", f"SELECT business_date, msku, units FROM v_sku_day WHERE business_date {_WINDOW}")
def window_manifest_read(f):
    """A date range of a table by months: only the folders of its months are opened."""
    table = work_folder(f.spark, "window-read")
    vs.create(f.sku_day.select("business_date", "msku", "units"), table, vs.by_date("business_date", "month"), ["msku"])
    return vs.read_window(f.spark, table, _FROM, _TO)


@query("key_buckets", _again("key_reload"))
def key_buckets(f):
    """Settlements reloaded by key in a table of hash buckets."""
    table = work_folder(f.spark, "key-buckets")
    base = f.settle_wide.select("settlement_id", "shipment_id", "transaction_type")
    shape = lambda df, o: df.select("settlement_id", "shipment_id", F.lit(o).alias("origin"))
    vs.create(shape(base, "old"), table, vs.by_bucket(["settlement_id"], 16), ["settlement_id"])
    vs.reload_keys(table, shape(base.where(F.col("settlement_id").startswith("S2000") & (F.col("transaction_type") == "Order")), "new"), ["settlement_id"])
    return vs.read(f.spark, table)


@query("upsert_buckets", f"SELECT sku, cost, description FROM ({_again('upsert_parts')}) q")
def upsert_buckets(f):
    """The part upsert into a table of hash buckets: only buckets of changed parts are rewritten."""
    table = work_folder(f.spark, "upsert-buckets")
    parts = f.part_master.select("sku", "cost", "description")
    vs.create(parts, table, vs.by_bucket(["sku"], 16), ["sku"])
    vs.upsert_buckets(table, ingest.part_changes(f), "n", ["sku"])
    return vs.read(f.spark, table)


# ------------------------------------------------------------------ measured runs
@query("run_log", """SELECT channel AS query_id, 'success' AS status, CAST(COUNT(*) AS BIGINT) AS row_count, CAST(SUM(total) AS DOUBLE) AS total, false AS failed FROM v_order GROUP BY 1
    UNION ALL SELECT 'again', 'failed', 0, NULL, true""")
def run_log(f):
    """Loads that log what they wrote while writing it, and one that fails because its target exists."""
    path = work_folder(f.spark, "runs")
    seconds = iter(range(1000))
    now = lambda: dt.datetime(2002, 1, 1) + dt.timedelta(seconds=next(seconds))
    run = lambda df, target, name: runs.logged(df, lambda d: d.write.mode("errorifexists").parquet(target), f"{path}/log", dt.date(2002, 1, 1), now, name, total=F.sum("total"))
    sums = []
    for channel in ("storefront", "marketplace", "wholesale"):
        orders = f.order.where(F.col("channel") == channel)
        sums.append((channel, float(run(orders, f"{path}/{channel}", channel)["total"] or 0)))
    try:
        run(f.order, f"{path}/wholesale", "again")
    except Exception as error:
        if "exist" not in str(error).lower():
            raise
    totals = f.spark.createDataFrame(sums, "query_id string, total double")
    log = runs.read_log(f.spark, f"{path}/log")
    return log.join(totals, "query_id", "left").select("query_id", "status", "row_count", "total", F.col("error").isNotNull().alias("failed"))


@query("distinct_sketches", """SELECT CAST(date_trunc('month', event_day) AS DATE) AS month, CAST(COUNT(DISTINCT user_pseudo_id) AS BIGINT) AS users, true AS within FROM v_web GROUP BY 1""")
def distinct_sketches(f):
    """Monthly users from stored daily sketches, beside the exact count, and whether they keep their error bound."""
    path = work_folder(f.spark, "sketches")
    sketches.daily(f.web, "event_day", "user_pseudo_id").write.parquet(path)
    month = F.trunc("event_day", "month").alias("month")
    told = sketches.merged(f.spark.read.parquet(path), [month]).select("month", sketches.estimate("about"))
    exact = f.web.groupBy(month).agg(F.count_distinct("user_pseudo_id").alias("users"))
    bound = F.greatest(F.lit(1.0), F.col("users") * sketches.error_bound())
    return exact.join(told, "month").select("month", "users", (F.abs(F.col("about") - F.col("users")) <= bound).alias("within"))
