"""Every registered query of the library against DuckDB, or for its invariants."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from sheetgraph import plans
from sheetgraph.plans import fixtures

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(v):
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(map(plain, v))
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return v


def rows_of(df: pd.DataFrame):
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(map(plain, r))) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in fixtures.BASE:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", fixtures.ORDER)
def test_view(spark, duck, name):
    cols, got = rows_of(getattr(fixtures.Tables(spark, SF), name).toPandas())
    want_cols, want = rows_of(duck.sql(fixtures.duck_sql(f"SELECT * FROM {name}")).df())
    assert cols == want_cols and got == want


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols, got = rows_of(df.toPandas())
    if name in plans.ORACLES:
        want_cols, want = rows_of(duck.sql(plans.ORACLES[name]).df())
        assert cols == want_cols and got == want
    assert got or name == "proto_usb_pair"  # the smallest tables have no interface with both data lines


def test_oracles_belong_to_queries():
    assert set(plans.ORACLES) <= set(plans.QUERIES) and len(plans.QUERIES) >= 150


def test_entry(spark, monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "SMOKE", SF)
    assert __spark_entry__.entry(spark).count() > 0 and set(plans.QUERIES) <= set(__spark_entry__.queries())
