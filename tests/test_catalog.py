"""Every registered query against its SQL equivalent, at the smallest scale."""

import duckdb
import pytest

from seqloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Compared at sf0.01 by the driver only: their quadratic SQL or loops are slow here.
SLOW = {"cluster_split"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.SQL) - SLOW))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.SQL[name])
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    order = [want.columns.index(c) for c in columns]
    rows = sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == rows


def test_every_query_has_sql_or_a_reason():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"model_predictions"}


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
