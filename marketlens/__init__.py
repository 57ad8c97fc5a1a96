"""Derivatives-market analytics as Spark DataFrame, SQL and Structured Streaming operators."""
