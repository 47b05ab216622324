import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SMALL
from saleswell.operators import maintenance as mt
from saleswell.sources.sample import BASE_TABLES, Feeds
from tools.check import compare


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["margin_drivers", "noise_products", "sku_totals"])
def test_all_years_match_oracle_and_exceed_one_year(spark, con, name):
    whole, one = entry.queries()[f"{name}_all_years"](spark, SMALL), entry.queries()[name](spark, SMALL)
    result = compare(whole, con, entry.oracle_sql()[f"{name}_all_years"])
    assert result.startswith("ok") and not result.startswith("ok 0 ") and "TYPES" not in result, result
    total = lambda df: df.agg(F.sum("revenue")).first()[0]
    assert name == "noise_products" or total(whole) > total(one)


def test_whole_fact_is_written(spark, monkeypatch):
    paths, write = [], mt.write_fact
    monkeypatch.setattr(mt, "write_fact", lambda df, path, *a, **b: (paths.append(path), write(df, path, *a, **b)))
    entry.queries()["write_fact_pruned"](spark, SMALL)
    assert spark.read.parquet(paths[0]).count() == Feeds(spark, SMALL).sku_day.count()
