"""Every core query against its SQL on the smallest tables; what SQL can't say only has to run."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from cuewright.plans.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW \"{name.removesuffix('.parquet')}\" AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float, np.integer, np.floating)):
        return f"{float(value):.6f}"
    return str(value)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(plain, r)) for r in frame[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLE:
        assert rows(found) == rows(duck.sql(ORACLE[name]).df())
    else:
        assert len(found)


def test_entry_runs(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
