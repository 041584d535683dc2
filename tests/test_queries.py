"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(n for n in entry.oracle_sql() if n in entry.QUERIES)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return "None" if math.isnan(x) else str(round(x, 6))
    return str(round(float(x), 6)) if isinstance(x, int) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda d: sorted(tuple(map(plain, r)) for r in d[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
