"""The registered SQL against the Spark queries."""

import duckdb
import pytest

from marketlens.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = c.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, sf)
    assert sorted(found.columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[n] for n in found.columns) for r in df.collect()))) == sorted(map(str, found.fetchall()))
