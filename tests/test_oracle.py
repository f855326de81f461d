"""Every named query against DuckDB on the same files."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from matchlens.catalog import all_queries
from oracle import all_oracles

SF_DIR = "/root/testdata/sf0.01"
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture
def duck():
    con = duckdb.connect()
    for table in ("events", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def _rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    rows = df.where(df.notna(), None).itertuples(index=False, name=None)
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


_SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    expected = duck.sql(ORACLES[name])
    assert {c: _SAME[t] for c, t in result.dtypes} == dict(
        zip(expected.columns, map(str, expected.types))
    )
    actual, wanted = _rows(result.toPandas()), _rows(expected.df())
    assert len(actual) == len(wanted) > 0
    assert actual == wanted


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
