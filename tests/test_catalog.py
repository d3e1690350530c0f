"""Queries against their SQL at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from docsight import catalog

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if hasattr(v, "replace") and hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    if v is None or isinstance(v, (str, bool)):
        return v
    return None if math.isnan(float(v)) else float(f"{float(v):.9g}")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t[:-8]} as select * from read_parquet('{SF}/{t}')")
    df = catalog.queries()[name](spark, SF)
    got = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([norm(v) for v in r]) for r in got.fetchall())
    assert sorted(repr([norm(r[c]) for c in columns]) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 1
