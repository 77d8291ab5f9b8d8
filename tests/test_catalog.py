"""Every registered query with SQL against DuckDB on the smallest tables, and the registry's shape."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import quarry.plans  # noqa: F401
from quarry.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: All queries; QUARRY_TEST_STEP=n takes every n-th.
STEP = int(os.environ.get("QUARRY_TEST_STEP", "1"))
#: Held by tests of its own, on smaller graphs.
SLOW: set[str] = {"routing_tree"}


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (not isinstance(v, str) and v != v):
        return None
    if isinstance(v, bool):
        return float(v)
    try:
        f = float(v)
        return None if math.isnan(f) else round(f, 5) + 0.0
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(cell(v) for v in r) for r in df.itertuples(index=False)), key=repr)


def frame(whole, each, columns):
    """A frame of the rows; as plain objects where a time is beyond what pandas can hold (an open end in the year 9999)."""
    try:
        return whole()
    except pd.errors.OutOfBoundsDatetime:
        return pd.DataFrame([tuple(r) for r in each()], columns=columns, dtype=object)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW)[::STEP])
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert rows(frame(got.toPandas, got.collect, got.columns)) == rows(frame(want.df, lambda: duck.sql(ORACLES[name]).fetchall(), want.columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW)[::STEP])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).toPandas().shape[1] > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
