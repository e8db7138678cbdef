"""Every registered catalog query against its oracle, on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from marketlens.fixtures import GIVEN
from marketlens.plans.queries import ORACLE_SQL, QUERIES


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, int | float | Decimal) and not isinstance(v, bool):
        return round(float(v), 9)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in GIVEN:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in ORACLE_SQL:
        return
    found = duck.sql(ORACLE_SQL[name])
    names = list(found.columns)
    assert sorted(names) == columns
    want = sorted(str([plain(dict(zip(names, row, strict=True))[c]) for c in columns]) for row in found.fetchall())
    assert got == want
