"""Every registered query against its SQL, on the smallest data."""

import __spark_entry__ as entry
import duckdb
import pytest
from maskspark.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def same(df):
    return sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and same(got) == same(want)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["c_nationkey", "c_name", "n", "total", "segment"]
