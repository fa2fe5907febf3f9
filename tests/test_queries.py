"""Every engine query that SQL can express equals its DuckDB counterpart on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from vicinal.plans import queries as engine

DATA = "/root/testdata/sf0.001"
CHECKED = ("dense_l2_knn", "dense_knn_postfilter", "sparse_ruzicka_range", "sparse_l2_knn", "popular_terms_confidence", "hybrid_range", "lsm_visible_rows")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "events"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = engine.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({engine.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, want))


def test_every_query_has_a_counterpart():
    assert engine.queries().keys() == engine.oracle_sql().keys()


def test_entry_module_names_are_unique_and_callable():
    import __spark_entry__

    assert all(map(callable, __spark_entry__.queries().values()))
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
