"""The driver contract: every query runs, and equals its SQL where it has one."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from folioscale.plans import core_queries, core_sql


def norm(df):
    def v(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, (float, np.floating)) and x != x):
            return None
        if isinstance(x, (list, np.ndarray)):
            return tuple(map(v, x))
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        if isinstance(x, (int, np.integer, float, np.floating)):
            return round(float(x), 6)
        return x

    return sorted(([v(x) for x in r] for r in df[sorted(df)].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(core_queries()))
def test_query(spark, data, name):
    got = core_queries()[name](spark, data).toPandas()
    if name in core_sql():
        con = duckdb.connect()
        con.execute("set timezone = 'UTC'")
        for f in glob.glob(f"{data}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        want = con.execute(core_sql()[name]).df()
        assert sorted(got) == sorted(want) and norm(got) == norm(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0
