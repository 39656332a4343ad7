import importlib

import pytest

entry = importlib.import_module("__spark_entry__")

SF = "/root/testdata/sf0.001"


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["node", "in_deg", "out_deg"]


@pytest.mark.parametrize("name", ["edgelist_parse", "csr_offsets", "has_edge_by_scan", "wcc", "scc", "sssp_weighted", "knn", "rank_list"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    con.sql(f"CREATE TABLE want AS {entry.oracle_sql()[name]}")
    want = con.sql(f"SELECT {', '.join(columns)} FROM want").fetchall()
    assert sorted(tuple(r) for r in df.select(columns).collect()) == sorted(want)
