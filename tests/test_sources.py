import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from saleswell.functions import keys
from saleswell.sources import accounting, files, invoices, marketplace, parts


def test_two_header_reports(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    body = "﻿Product,,Sales\nSKU,Name,Units\nA,x,5\n,,\nB,,n/a\n"
    (tmp_path / "Econ 1-5-26 to 1-11-26.csv").write_text(body, encoding="utf-8")
    (tmp_path / "sub" / "econ_1_12_26_to_1_18_26.csv").write_text("Product,Sales,Fees\nSKU,Units,Total\nC,7,1.5\n")
    (tmp_path / "latest.csv").write_text(body, encoding="utf-8")
    df = files.numeric_columns(files.read_reports(spark, str(tmp_path)), ["sales_units"])
    rows = {r.product_sku: r for r in df.collect()}
    assert set(rows) == {"A", "B", "C"} and rows["A"].sales_units == 5.0 and rows["B"].sales_units is None
    assert rows["A"].report_start_date == dt.date(2026, 1, 5) and rows["C"].report_end_date == dt.date(2026, 1, 18)
    assert rows["C"].fees_total == "1.5" and rows["A"].fees_total is None


def test_encodings_tsv_and_latest(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("﻿Sku,Name\na,Café\n".encode("utf-8"))
    (tmp_path / "w.csv").write_bytes("Sku,Name\na,Café ’\n".encode("cp1252"))
    (tmp_path / "l.csv").write_bytes(b"Sku,Name\na,\x81\n")
    assert [files.detect_encoding(spark, str(tmp_path / f"{n}.csv")) for n in "uwl"] == list(files.ENCODINGS)
    assert files.read_csv_any_encoding(spark, str(tmp_path / "w.csv")).first().Name == "Café ’"
    assert files.read_csv(spark, str(tmp_path / "u.csv")).columns == ["Sku", "Name"]
    (tmp_path / "s.txt").write_bytes(b"settlement-id\tsku\n1\t\"q\"\n")
    assert files.read_tsv(spark, str(tmp_path / "s.txt")).first().asDict() == {"settlement_id": "1", "sku": '"q"'}
    assert files.latest_file(spark, str(tmp_path), "s*.txt").endswith("s.txt")


def test_each_file_has_its_own_encoding_and_columns(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "u.csv").write_bytes("\ufeffSku,Name\na,Café ’\n\"b,1\",\"say \"\"hi\"\"\"\n,\n".encode("utf-8"))
    (tmp_path / "sub" / "w.csv").write_bytes("Name,Sku,Extra\r\nCafé ’,c,\r\n".encode("cp1252"))
    (tmp_path / "l.csv").write_bytes("Sku,Name\nd,é\x81\n".encode("latin-1"))
    (tmp_path / "empty.csv").write_bytes(b"")
    got = {tuple(r) for r in files.read_csv_any_encoding(spark, str(tmp_path), "*.csv").select("Sku", "Name", "Extra", "_file").collect()}
    assert got == {("a", "Café ’", None, "u.csv"), ("b,1", 'say "hi"', None, "u.csv"), ("c", "Café ’", None, "w.csv"), ("d", "é\x81", None, "l.csv")}
    profiles = {r["path"].rsplit("/", 1)[1]: (r["encoding"], [bytes(h) for h in r["head"]]) for r in files.file_profiles(spark, str(tmp_path), "*.csv").collect()}
    assert {k: v[0] for k, v in profiles.items()} == {"u.csv": "utf-8", "w.csv": "windows-1252", "l.csv": "iso-8859-1"}
    assert profiles["w.csv"][1] == [b"Name,Sku,Extra", "Café ’,c,".encode("cp1252")]
    with pytest.raises(FileNotFoundError):
        files.read_csv_any_encoding(spark, str(tmp_path), "empty.csv")


def test_heads_of_split_files(spark, tmp_path):
    """Files of many blocks, and many files in one partition: a head is always the file's own first two lines."""
    for k in range(12):
        (tmp_path / f"f{k}.csv").write_text(f"top{k},x\nmetric{k},y\n" + "".join(f"{k}-{i},{i}\n" for i in range(3000 if k % 5 == 0 else k)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        heads = {r["path"].rsplit("/", 1)[1]: [bytes(h).decode() for h in r["head"]] for r in files.file_profiles(spark, str(tmp_path)).collect()}
        assert heads == {f"f{k}.csv": [f"top{k},x", f"metric{k},y"] for k in range(12)}
        assert files._read_headed(spark, str(tmp_path), "f5.csv", 2).count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_parts_master(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Sku,Active Status,Cost,Price,Extra\n 007 ,Active,"$1,200.50",,z\n,Active,1,1,z\n', encoding="utf-8-sig")
    p = parts.clean_parts(files.read_csv(spark, str(tmp_path / "p.csv"))).collect()
    assert [(r.sku, r.cost, r.price, r.is_active) for r in p] == [("007", 1200.5, 0.0, True)]


def test_json_feeds(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"startDate":"2026-01-02","msku":"a","extra":1,"sales":{"unitsOrdered":2},"fees":null}\n')
    row = marketplace.flatten_economics(marketplace.read_economics(spark, str(tmp_path / "e.json")), "q", "d", dt.datetime(2026, 1, 3)).first()
    assert (row.business_date, row.units, float(row.gross_sales), float(row.fees)) == (dt.date(2026, 1, 2), 2, 0.0, 0.0)
    (tmp_path / "t.json").write_text('{"reportSpecification":{"dataStartTime":"2026-01-02"},\n"salesAndTrafficByAsin":[{"parentAsin":"P","trafficByAsin":{"sessions":3}}]}')
    t = marketplace.flatten_traffic(marketplace.read_traffic(spark, str(tmp_path / "t.json"))).first()
    assert (t.report_date, t.msku, t.sessions, t.page_views) == (dt.date(2026, 1, 2), "P", 3, 0)
    assert files.load_jsonl_inferred(spark, str(tmp_path / "e.json"), str(tmp_path / "stage")).count() == 1


def test_item_snapshot_file_and_responses(spark, tmp_path):
    (tmp_path / "i.xml").write_text(
        "<Q><R><ItemInventoryRet><Name>n</Name><FullName>A:n</FullName><QuantityOnHand>x</QuantityOnHand><IncomeAccountRef><FullName>Sales</FullName></IncomeAccountRef></ItemInventoryRet>"
        "<ItemServiceRet><FullName>skip</FullName></ItemServiceRet><ItemInventoryRet><ListID>1</ListID></ItemInventoryRet></R></Q>")
    rows = accounting.read_item_snapshot(spark, str(tmp_path / "i.xml")).collect()
    assert [(r.item_full_name, r.quantity, r.income_account) for r in rows] == [("A:n", None, "Sales")]
    incomplete = spark.createDataFrame([("a", 1.0, 1, 5)], "item_full_name string, quantity double, page_no int, remaining int")
    assert [r.complete for r in accounting.assemble_snapshot(incomplete).collect()] == [False]


INVOICE = """# Head

## Page 1

## Order #7

### Billing Details
* Name: Pat Doe
* Organization: Garden Co
* Phone: (not specified)
* Email: pat@example.com

### Order Information
* Order Date: 3rd Jan 2025
* Payment Method: Check ($1,075.40)

| Qty | Code/SKU | Product Name | Details | Price | Total |
|---|---|---|---|---|---|
| 8 | w1.5x | Wire | long, text | $1,050.00 USD | $8,400.00 USD |

### Summary
* Subtotal: $8,400.00 USD
* Shipping: $0.00 USD
* Grand total: $8,400.00 USD

---

## Order #8

### Billing Details
**Name:** Sam
**Phone:** 555-1

| 1 | T-1 | Tool | **$5.00 USD** | **$5.00 USD** |
"""


def test_invoices(spark, tmp_path):
    (tmp_path / "a.md").write_text(INVOICE)
    (tmp_path / "README.md").write_text(INVOICE)
    blocks = invoices.split_orders(files.read_documents(spark, str(tmp_path)))
    heads = {r.order_id: r for r in invoices.parse_headers(blocks).collect()}
    assert set(heads) == {"7", "8"} and heads["7"].company_name == "Garden Co" and heads["7"].customer_phone == ""
    assert heads["7"].order_date == dt.date(2025, 1, 3) and heads["7"].payment_method == "Check" and float(heads["7"].grand_total) == 8400.0
    assert heads["8"].customer_name == "Sam" and heads["8"].customer_phone == "555-1"
    lines = {(r.order_id, r.sku, r.product_name, r.quantity, float(r.line_total)) for r in invoices.parse_lines(blocks).collect()}
    assert lines == {("7", "w1.5x", "Wire", 8, 8400.0), ("8", "T-1", "Tool", 1, 5.0)}


@pytest.mark.parametrize("count", [250, 5000])
def test_long_orders_stay_whole(spark, count):
    rows = "\n".join(f"| {i + 1} | s{i} | Item {i} | $1.00 USD | ${i + 1}.00 USD |" for i in range(count))
    text = f"# Invoices\n\n## Order #9\n\n### Billing Details\n* Name: A\n\n### Order Items\n\n| Qty | Code | Name | Price | Total |\n|---|---|---|---|---|\n{rows}\n\n### Summary\n* Subtotal: $5.00 USD\n"
    blocks = invoices.split_orders(spark.createDataFrame([("a.md", text)], "file_name string, content string"))
    assert invoices.parse_headers(blocks).count() == 1
    lines = invoices.parse_lines(blocks)
    assert [(r.line_number, r.quantity) for r in lines.orderBy("line_number").collect()] == [(i + 1, i + 1) for i in range(count)]


def test_parts_export_keeps_types_and_counts(spark, tmp_path):
    raw = spark.createDataFrame([("007", "$1,234.5", 'say "hi", all', "n/a"), (" 1e5 ", None, None, ""), ("  ", "1", "x", "2"), (None, "1", "x", "2")], "Sku string, Cost string, Description string, Price string")
    fields = ["sku", "description", "cost", "price"]
    for kind in ("json", "csv"):
        assert parts.export_parts(raw, str(tmp_path / kind), kind) == (2, 2)
        rows = sorted(map(tuple, parts.read_parts(spark, str(tmp_path / kind), fields, kind).collect()))
        assert rows == [("007", 'say "hi", all', 1234.5, 0.0), ("1e5", "", 0.0, 0.0)]
    line = json.loads(sorted(r.value for r in spark.read.text(str(tmp_path / "json")).collect())[0])
    assert line == {"sku": "007", "description": 'say "hi", all', "cost": 1234.5, "price": 0.0}
    assert parts.export_parts(raw.limit(0), str(tmp_path / "none")) == (0, 0)
    with pytest.raises(ValueError):
        parts.export_parts(raw, str(tmp_path / "other"), "xml")


def test_fields_of_messy_headers(spark):
    df = spark.createDataFrame([("a", "1", "z")], "`FULL.name` string, `On-Hand` string, other string")
    wanted = {"qty": ("TOTAL", "on hand"), "name": ("Full Name",), "cost": ("Cost",)}
    assert [tuple(r) for r in keys.with_fields(df, wanted, ["name"]).collect()] == [("1", "a", None)]
    assert keys.with_fields(df, wanted, ["cost"], allow_partial=True).columns == ["qty", "name", "cost"]
    with pytest.raises(ValueError, match="cost"):
        keys.with_fields(df, wanted, ["cost"])


def test_landed_invoices_are_few_files(spark, monkeypatch):
    import glob

    from saleswell.plans import queries_feeds
    from saleswell.sources.sample import Feeds

    documents = spark.range(0, 1500, 1, 1).select(F.concat(F.lit("## Order #"), F.col("id").cast("string"), F.lit("\n\n| 1 | a.x | Item | $1.00 | $2.00 |\n")).alias("content"))
    monkeypatch.setattr(queries_feeds.ingest, "invoice_documents", lambda f: documents)
    path = queries_feeds._landed_invoices(Feeds(spark, "unused"))
    assert len(glob.glob(f"{path}/*.txt")) == 2
    lines = invoices.parse_lines(invoices.split_orders(files.read_documents(spark, path, "*.txt")))
    assert lines.count() == lines.select("order_id").distinct().count() == 1500
