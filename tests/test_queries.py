"""Every own query against its SQL on the smallest tables, as far as they are at hand."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from marlstone.plans.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple("NULL" if v is None or v != v else str(round(float(v), 5) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        for c in got:  # nullable whole numbers come as floats from either side
            if str(want[c].dtype).startswith("float") or str(got[c].dtype).startswith("float"):
                got[c], want[c] = got[c].astype(float), want[c].astype(float)
        assert plain(got) == plain(want)
    else:
        assert len(got) > 0 or name.startswith("search_")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
