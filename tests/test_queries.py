"""Every query with SQL against DuckDB on the smallest given tables."""

import os
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from tallyloom.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("customer", "supplier", "orders", "lineitem", "events", "documents")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


def plain(value):
    if pd.isna(value):
        return ""
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, int | float | Decimal):
        return f"{float(value):.9g}"
    return str(value).removesuffix(" 00:00:00").removesuffix("T00:00:00.000000000")


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(plain(v) for v in row) for row in frame[names].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{SF_DIR}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = rows_of(registry.QUERIES[name](spark, SF_DIR).toPandas()), rows_of(duck.execute(registry.ORACLE_SQL[name]).fetchdf())
    assert got[0] == want[0] and got[1] == want[1]
