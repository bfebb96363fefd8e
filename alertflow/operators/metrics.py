"""Counters (R22) and the routing report over a replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counters(alerts: DataFrame, plan: DataFrame) -> DataFrame:
    """Alerts received (muted ones too), deliveries ok, deliveries
    failed. One global aggregate over the union (partial per task)."""
    a = alerts.select(F.lit(True).alias("_alert"), F.lit(None).cast("string").alias("status"))
    p = plan.select(F.lit(False).alias("_alert"), "status")
    return a.unionByName(p).agg(
        F.count_if(F.col("_alert")).alias("alerts_received"),
        F.count_if(F.col("status").endswith("-sent")).alias("notify_success"),
        F.count_if(F.col("status").endswith("-failed")).alias("notify_failure"))


def status_report(plan: DataFrame) -> DataFrame:
    """Decisions per rule, receiver and recorded status (NULL =
    skipped as already delivered)."""
    return plan.groupBy("rule_name", "receiver", "status").agg(F.count(F.lit(1)).alias("decisions"))


def observe_counters(stream_df: DataFrame, name: str = "alertflow_counters") -> DataFrame:
    """R22 in a stream: ``df.observe`` publishes per-batch counts to the
    query's progress without an extra job."""
    return stream_df.observe(name, F.count(F.lit(1)).alias("alerts_received"))
