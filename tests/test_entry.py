import importlib

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
QUICK = ["tfidf_top_terms", "bm25_search", "method_matrix", "gap_report", "queue_counts", "auc_quality", "union_rerank", "connected_components", "phrase_hits"]


@pytest.fixture(scope="module")
def entry():
    return importlib.import_module("__spark_entry__")


def test_names(entry):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80


def test_entry(entry, spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_same_as_sql(entry, spark, name):
    con = duckdb.connect()
    for t in "customer part orders lineitem supplier events documents embeddings labels benchmark".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in found.description)
    want = [dict(zip([d[0] for d in found.description], r, strict=True)) for r in found.fetchall()]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    key = lambda r: [str(r[c]) for c in columns]
    assert sorted(map(key, (r.asDict() for r in df.collect()))) == sorted(map(key, want))
