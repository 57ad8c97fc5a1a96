"""A measure is negative where a fault was put, and nowhere else, whatever the events' values."""

import datetime as dt
import json

import duckdb
import pytest

from marketlens import registry
from tests.test_faults import NAMES


@pytest.fixture(scope="module")
def odd_values(spark, tmp_path_factory):
    """Events whose values are no numbers, below zero, without end, zero or unknown."""
    root = tmp_path_factory.mktemp("odd-values")
    values = (float("nan"), -3.5, float("-inf"), float("inf"), -0.0, 0.0, None, 7.25)
    rows = [(i, dt.datetime(2024, 1, 2) + dt.timedelta(seconds=i), i % 13, ("click", "view", "error")[i % 3], values[i % len(values)], json.dumps({"k": i % 100})) for i in range(1000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{root}/events.parquet")
    return str(root)


@pytest.mark.parametrize("name", NAMES)
def test_only_faults_are_negative(spark, odd_values, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{odd_values}/events.parquet/*.parquet')")
    columns = ("symbol_id", "exchange", "data_type", "issue_type", "error", "issues")
    want = sorted(tuple(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall())
    got = sorted(tuple(r[c] for c in columns) for r in registry.queries()[name](spark, odd_values).collect())
    assert got == want


@pytest.fixture(scope="module")
def no_k(spark, tmp_path_factory):
    """Events of which every third has no k."""
    root = tmp_path_factory.mktemp("no-k")
    rows = [(i, dt.datetime(2024, 1, 2) + dt.timedelta(seconds=i), i % 13, ("click", "view", "error")[i % 3], 7.25, "{}" if i % 3 == 0 else json.dumps({"k": i % 100})) for i in range(1000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{root}/events.parquet")
    return str(root)


@pytest.mark.parametrize("name", NAMES)
def test_events_without_k_have_no_fault(spark, no_k, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{no_k}/events.parquet/*.parquet')")
    columns = ("symbol_id", "exchange", "data_type", "issue_type", "error", "issues")
    want = sorted(tuple(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall())
    got = sorted(tuple(r[c] for c in columns) for r in registry.queries()[name](spark, no_k).collect())
    assert got == want
