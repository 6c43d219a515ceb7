"""Every query that has SQL against DuckDB on the smallest tables; the others at least run."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as e

QUERIES, SQL = e.queries(), e.oracle_sql()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    def one(v):
        if v is None or v is pd.NA or isinstance(v, float) and v != v:
            return "null"
        return repr(float(v)) if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return df.apply(lambda c: c.map(one)).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k in SQL))
def test_same_as_sql(name, spark, duck, sf_dir):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    pd.testing.assert_frame_equal(normal(ours), normal(theirs))


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k not in SQL))
def test_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    row = e.entry(spark).first()
    assert row.rmse_h > 0 and 0 <= row.avail_05m <= row.avail_1m <= 100
