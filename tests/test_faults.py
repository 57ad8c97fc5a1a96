"""Faults put into the records stay faults whatever the events' values."""

import datetime as dt
import json

import duckdb
import pytest

from marketlens import registry

NAMES = ["quarantine_market_snapshot", "quarantine_kline", "quarantine_open_interest", "quarantine_open_interest_history", "quarantine_funding", "quarantine_funding_history", "quarantine_taker_flow", "quarantine_liquidation_event", "quarantine_liquidation_aggregate", "quarantine_basis", "quarantine_orderbook", "quarantine_asked_kline", "quarantine_asked_taker_flow", "quarantine_asked_liquidation_aggregate", "quarantine_asked_period_of_none", "quarantine_asked_symbol"]


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    """Events whose values are zero, or unknown now and then."""
    root = tmp_path_factory.mktemp("zeros")
    rows = [(i, dt.datetime(2024, 1, 2) + dt.timedelta(seconds=i), i % 13, ("click", "view", "error")[i % 3], None if i % 7 == 0 else 0.0, json.dumps({"k": i % 100})) for i in range(1000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{root}/events.parquet")
    return str(root)


@pytest.mark.parametrize("name", NAMES)
def test_zero_values_are_made_negative(spark, zeros, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{zeros}/events.parquet/*.parquet')")
    columns = ("symbol_id", "exchange", "data_type", "issue_type", "error", "issues")
    want = sorted(tuple(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall())
    got = sorted(tuple(r[c] for c in columns) for r in registry.queries()[name](spark, zeros).collect())
    assert got == want and any(error.endswith("must not be negative") for *_, error, _ in got)
