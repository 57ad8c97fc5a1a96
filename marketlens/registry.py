"""Queries of the market operators and their DuckDB SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlens.plans import market, oracle, records, records_sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (*market.QUERIES, *records.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL | records_sql.SQL
