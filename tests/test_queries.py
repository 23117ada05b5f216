"""Every query with SQL gives the same rows in DuckDB."""

import math

import duckdb
import pytest

from loamspark.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        return "null" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{float(x):.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(value(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    want = duck.execute(registry.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
