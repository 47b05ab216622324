"""The registered queries against their SQL, and the pipeline against a plain version of its stages."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SMALL
from saleswell.llm import substrings
from saleswell.llm.queries import QUERIES, SQL
from test_llm_dedup import plain_fingerprint, plain_groups, plain_removal
from tools.check import compare

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def test_all_are_registered():
    names = entry.queries().keys()
    assert [n for n in range(1, 14) if sum(x.startswith(f"op{n}_") for x in names) != 1] == [] and "pipeline" in names


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    result = compare(QUERIES[name](spark, SMALL), con, SQL[name])
    assert result.startswith("ok") and not result.startswith("ok 0 ") and "TYPES" not in result, result


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys() - {"op1_best_fit_packing"}))
def test_one_row_for_each_document(spark, con, name):
    ids = [r["doc_id"] for r in QUERIES[name](spark, SMALL).select("doc_id").collect()]
    assert sorted(ids) == [x for (x,) in con.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]


def test_pipeline_stages(spark, con, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "toxicity":
            toxic = dict(con.execute("SELECT doc_id, toxic FROM labels").fetchall())
            kept = {r["doc_id"] for r in after}
            clean = [r["doc_id"] for r in before if toxic.get(r["doc_id"]) == 0]
            assert sum(i in kept for i in clean) >= 0.98 * len(clean) and len(after) < len(before)
        elif name == "simhash_near_dedup":
            groups = plain_groups({r["doc_id"]: plain_fingerprint(r["text"]) for r in before})
            assert sorted(r["doc_id"] for r in after) == sorted(set(groups.values()))
        elif name == "substring_dedup":
            want = {d: [x for x, g in zip(w, gone) if not g] for d, w, gone in plain_removal([(r["doc_id"], r["text"]) for r in before], substrings.WINDOW)}
            assert {r["doc_id"]: r["text"].encode().split() for r in after} == want
        else:
            texts = {}
            for r in after:
                texts.setdefault(r["doc_id"], {})[r["piece"]] = r["text"]
            assert {d: "".join(p[k] for k in sorted(p)) for d, p in texts.items()} == {r["doc_id"]: r["text"] for r in before}
    whole = corpus_pipeline.run(spark, SMALL).drop("text")
    key = lambda rows: sorted(map(str, rows))
    assert key(whole.collect()) == key(docs.drop("text").select(*whole.columns).collect())
