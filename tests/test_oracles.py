"""Every registered query of the matching and scoring jobs against its SQL, on the smallest tables."""

import os

import pytest

from quillmark.plans import queries as plans
from quillmark.plans import reading_queries, review_queries, surface_queries  # noqa: F401  register more

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    rows = df.collect()
    spark.catalog.clearCache()
    if name not in plans.ORACLES:
        return
    duck.execute(plans.ORACLES[name])
    columns = [c[0] for c in duck.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(duck.fetchall(), columns)
