"""Every graph query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lamina import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(frame, cols):
    return sorted(map(tuple, frame[cols].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    if name not in Q.ORACLES:
        assert len(got)
        return
    want = duck.execute(Q.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
