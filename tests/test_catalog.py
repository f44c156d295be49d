import math

import duckdb
import pytest

import __spark_entry__
from codeloom import catalog, go_catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return str(int(v)) if isinstance(v, (bool, int)) or isinstance(v, float) and v == int(v) else str(v)


def test_every_query_has_sql():
    assert set(catalog.SQL) == set(catalog.QUERIES) and len(catalog.QUERIES) == 68
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES | go_catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = (catalog.QUERIES | go_catalog.QUERIES)[name](spark, SF)
    found = duck.sql((catalog.SQL | go_catalog.SQL)[name])
    order = sorted(df.columns)
    assert order == sorted(found.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [found.columns.index(c) for c in order]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
