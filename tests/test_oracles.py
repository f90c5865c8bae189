"""Every query with SQL gives what DuckDB gives on the small tables."""

import math
import os

import duckdb
import pytest

from tracelode import registry


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 5) + 0.0 if isinstance(x, float) else x
    return sorted(([plain(r[i]) for i in order] for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, small, name):
    df = registry.QUERIES[name](spark, small)
    want = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
