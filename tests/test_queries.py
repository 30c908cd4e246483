"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from burrow.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no generated tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted([text(v[i]) for i in order] for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE_SQL:
        cursor = duck.execute(ORACLE_SQL[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert found == rows(columns, cursor.fetchall())
    else:
        assert found
