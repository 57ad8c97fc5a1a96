"""Every registered market query gives the rows of its DuckDB SQL."""

import datetime as dt
import decimal
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from marketlens import registry


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def _value(v):
    """A value of either side in one form: numbers as doubles, dates and times as times, null as None."""
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.number, decimal.Decimal)):
        return float(v)
    return str(pd.Timestamp(v)) if isinstance(v, (dt.date, np.datetime64)) else str(v)


def _plain(df):
    rows = [tuple(map(_value, row)) for row in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(rows, key=lambda r: [f"{x:.6g}" if isinstance(x, float) else str(x) for x in r])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, sf, name):
    got = _plain(registry.queries()[name](spark, sf).toPandas())
    want = _plain(con.sql(registry.oracle_sql()[name]).df())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == pytest.approx(y, rel=1e-9, abs=1e-12) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)


def test_names_match():
    assert set(registry.queries()) == set(registry.oracle_sql())
