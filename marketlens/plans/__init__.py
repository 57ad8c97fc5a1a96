"""Registered queries and the DuckDB SQL that gives the same rows."""
