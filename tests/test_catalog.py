"""Every query of the core against its SQL, on the smallest test data; skipped where these are missing."""

import os
from pathlib import Path

import duckdb
import pytest

from sievework.plans import catalog

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    r = con.execute(catalog.ORACLE[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(plain(v) for _, v in sorted(zip(cols, row))) for row in r.fetchall()), key=repr)
    assert sorted((tuple(plain(row[c]) for c in sorted(cols)) for row in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, str(DATA)).count() > 0
