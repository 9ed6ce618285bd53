"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from graphloom.adapters import TABLES
from graphloom.registry import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    def one(x):
        if x is None or x != x:
            return "null"
        return f"{round(x, 7) + 0.0:.7f}" if isinstance(x, float) else str(x)

    return df[columns].map(one).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DIR)
    assert len(set(got.columns)) == len(got.columns)
    got = got.toPandas()
    if name in ORACLE:
        want = db.execute(ORACLE[name]).fetchdf()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        pd.testing.assert_frame_equal(plain(got, columns), plain(want, columns))
        assert [want[c].dtype.kind for c in columns] == [got[c].dtype.kind for c in columns]
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(DIR)
