"""Every planning query against its oracle SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from reelmill import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in rows)
    theirs = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall())
    assert mine == theirs


def test_names_match():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
