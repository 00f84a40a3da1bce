"""Every query of the engine with SQL against that SQL, on the smallest tables."""

import os

import pytest

from tidegauge import catalog

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for name in ("orders", "events"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in catalog.SQL if not n.startswith("corr")))
def test_query(spark, other, name):
    a, b = catalog.QUERIES[name](spark, DATA).toPandas(), other.sql(catalog.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    order = sorted(a.columns)
    a, b = (x[order].sort_values(order).reset_index(drop=True) for x in (a, b))
    assert all(((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all() for c in order)
