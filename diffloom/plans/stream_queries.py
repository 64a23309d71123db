"""Queries that run as streams; each has the same result as its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from diffloom.plans.registry import SQL, query
from diffloom.plans.table_queries import budget_admit  # noqa: F401  (registers the SQL that is shared below)
from diffloom.streaming import jobs


@query("stream_windows", SQL["bucket_rate"].replace("AS hour", "AS window_start"))
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per type and hour, as a stream."""
    return jobs.windowed_counts(jobs.arriving(spark, f"{d}/events.parquet"), "ts", "1 hour", "2 hours", "event_type")


@query("stream_distinct", "SELECT DISTINCT feed, raw_line FROM static_alert_lines")
def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Records of a feed once, although some are sent twice."""
    return jobs.distinct_within(jobs.arriving(spark, f"{d}/static_alert_lines.parquet"), "received_at", "30 days", "feed", "raw_line")


@query("stream_budget", SQL["budget_admit"])
def stream_budget(spark: SparkSession, d: str) -> DataFrame:
    """Greedy admission of each user's events, with the budget as state."""
    e = jobs.arriving(spark, f"{d}/events.parquet").withColumn("tokens", F.get_json_object("props", "$.k").cast("long"))
    return jobs.budgeted(e, "user_id", "event_id", "tokens", 1000)
