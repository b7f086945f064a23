"""Each query against its SQL on DuckDB over the smallest tables."""

import decimal
import math

import duckdb
import pytest

from murmuration.plans.views import TABLES
from murmuration.queries import ORACLE, QUERIES


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float | decimal.Decimal) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted("|".join(norm(r[c]) for c in cols) for r in df.collect())
    if name in ORACLE:
        r = con.sql(ORACLE[name])
        assert sorted(r.columns) == cols
        at = [r.columns.index(c) for c in cols]
        assert got == sorted("|".join(norm(row[i]) for i in at) for row in r.fetchall())
    assert got
