"""Compare every canonical view between Spark and DuckDB."""
import sys, duckdb
sys.path.insert(0, "/root/repo")
from pyspark.sql import SparkSession
from saleswell.sources.sample import BASE_TABLES, VIEWS, Feeds, oracle
from tools.check import compare, session
d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
spark = session()
con = duckdb.connect()
for t in BASE_TABLES:
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
f = Feeds(spark, d)
for v in VIEWS:
    print(v, compare(f.view(v), con, oracle(f"SELECT * FROM {v}")))
