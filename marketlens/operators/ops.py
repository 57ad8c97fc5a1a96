"""Health and request metrics over operations tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.scalars import mean, micros, request_error, worst_health
from marketlens.options import DAY


def exchange_health(health: DataFrame) -> DataFrame:
    """Per venue (unknown where it has no name): newest heartbeat, collectors by status, and the worst of them."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    g = health.groupBy(F.coalesce("exchange", F.lit("unknown")).alias("exchange")).agg(F.max("heartbeat_at").alias("last_heartbeat_at"), F.count(F.lit(1)).alias("collectors"), is_("healthy").alias("healthy"), is_("degraded").alias("degraded"), is_("unhealthy").alias("unhealthy"))
    return g.withColumn("status", worst_health("unhealthy", "degraded"))


def request_metrics(log: DataFrame, now, window: int = DAY, scale: int | None = None) -> DataFrame:
    """Requests of the last day by venue, type and status (or error): number, average duration, rate-limited ones."""
    recent = log.where(micros("requested_at") >= micros(F.lit(now).cast("timestamp")) - window)
    status = F.coalesce(F.col("status_code").cast("string"), F.nullif("error_type", F.lit("")), F.lit("unknown"))
    return recent.groupBy("exchange", "request_type", status.alias("status")).agg(F.count(F.lit(1)).alias("requests"), mean("duration_ms", scale).alias("avg_duration_ms"), F.count_if("rate_limited").alias("rate_limited"))


def classify_requests(log: DataFrame) -> DataFrame:
    """The log with error_type, recoverable and rate_limited of each failed request."""
    return log.withColumn("_e", request_error("status_code", "error_message")).select(*[c for c in log.columns if c not in ("error_type", "recoverable", "rate_limited")], "_e.*")


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


def open_counts(issues: DataFrame, gaps: DataFrame, cleanups: DataFrame) -> DataFrame:
    """One row: open issues, open gaps, and rows that cleanups deleted."""
    i = issues.agg(F.count_if(F.col("status") == "open").alias("open_issues"))
    g = gaps.agg(F.count_if(F.col("backfill_status").isin("pending", "open")).alias("open_gaps"))
    d = cleanups.agg(F.coalesce(F.sum("rows_deleted"), F.lit(0)).alias("rows_deleted"))
    return i.join(g, F.lit(True)).join(d, F.lit(True))  # one row each
