"""Registered queries against their oracles on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
QUICK = ["load_pages", "make_chunks", "describe_numeric", "first_n_per_deck", "knn_exact", "bm25_search", "mrr", "build_edges", "communities", "chat_template"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, duck, name):
    got = entry_module.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(entry_module.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(str, got[columns].astype(str).values.tolist())) == sorted(map(str, want[columns].astype(str).values.tolist()))


def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
