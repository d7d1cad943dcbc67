import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from geolake.plans import lifecycle, queries

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE_SQL = queries.QUERIES | lifecycle.QUERIES, queries.ORACLE_SQL | lifecycle.ORACLE_SQL


def plain(frame):
    def value(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v

    return sorted(repr([value(v) for v in row]) for row in frame[sorted(frame)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got) == sorted(want)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(ORACLE_SQL) == set(QUERIES)
