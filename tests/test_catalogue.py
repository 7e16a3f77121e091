"""All core queries against their SQL on the smallest tables."""

import glob
import math
import os

import pytest

from textquarry.plans import catalogue, inventory

QUERIES, SQL = catalogue.QUERIES | inventory.QUERIES, catalogue.SQL | inventory.SQL

DATA = os.environ.get("TQ_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(float(v)) if hasattr(v, "as_tuple") else repr(v)


def test_names_match():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = df.collect()
    if name in SQL:
        got = duck.execute(SQL[name])
        names = [c[0] for c in got.description]
        assert sorted(names) == columns
        want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall())
        assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == want
    else:
        assert rows
