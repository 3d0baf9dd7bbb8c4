"""Every base query against its SQL on the smallest tables."""

import decimal

import duckdb
import pytest

from arborlake.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return format(v.normalize(), "f") if isinstance(v, decimal.Decimal) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted([tuple(norm(r[k]) for k in columns) for r in df.collect()])
    assert got
    if name in ORACLE_SQL:
        r = duck.sql(ORACLE_SQL[name])
        assert sorted(r.columns) == columns
        names = r.columns
        assert got == sorted(tuple(norm(dict(zip(names, x, strict=True))[k]) for k in columns) for x in r.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_reachability_of_every_part(spark, sf):
    parts = [r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()]
    step = {p: (p * 7 + 3) % len(parts) for p in parts if p % 3}
    want = {}
    for p in parts:
        seen = []
        at = p
        while at is not None and at not in seen:
            seen.append(at)
            at = step.get(at)
        want[p] = (len(seen), max(seen))
    assert {r.seed: (r.n, r.top) for r in QUERIES["reachability_closure"](spark, sf).collect()} == want
