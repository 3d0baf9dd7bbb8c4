"""Queries against their SQL."""

import duckdb
import pytest

from arborlake.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    rows = sorted(tuple(r[k] for k in columns) for r in got.select(columns).collect())
    assert rows == sorted(tuple(dict(zip(want.columns, x, strict=True))[k] for k in columns) for x in want.fetchall())
