"""Alerts and mutes derived from the driver's ``events`` table.

Every event becomes one alert push; a derived mutes table is taken from the
same events. Both are plain projections of a columnar scan (only the
columns used are read), so they grow with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the fixture mapping.
AS_OF = "2024-01-16 00:00:00"
SEVERITY_CRITICAL_MIN = 113
SEVERITY_WARNING_MIN = 35
MUTE_EVERY = 250


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


# Absent labels are left out of the map.
_LABELS = f"""map_filter(map(
  'alertname', event_type,
  'severity', CASE WHEN value >= {SEVERITY_CRITICAL_MIN} THEN 'critical' WHEN value >= {SEVERITY_WARNING_MIN} THEN 'warning'
              ELSE 'info' END,
  'team', CASE user_id % 3 WHEN 0 THEN 'infra' WHEN 1 THEN 'platform' END,
  'instance', concat('host-', user_id % 10),
  'source', CASE WHEN user_id % 10 = 3 THEN 'noisy-system' END,
  'chaos', CASE WHEN user_id % 10 = 7 THEN 'fail' END), (k, v) -> v IS NOT NULL)"""


def alerts_from_events(ev: DataFrame) -> DataFrame:
    """One alert push per event (schema ``schemas.ALERTS`` plus ``call_ok``).

    ``call_ok`` is the simulated outcome of a delivery call for this push.
    """
    return ev.selectExpr(
        "event_id AS alert_id",
        "cast(ts AS timestamp) AS observed_at",
        "event_id AS seq",
        f"{_LABELS} AS labels",
        "map('summary', props) AS annotations",
        "date_trunc('hour', cast(ts AS timestamp)) AS starts_at",
        """CASE event_id % 5 WHEN 0 THEN cast(ts AS timestamp) - INTERVAL 1 MINUTE WHEN 1 THEN cast(ts AS timestamp)
           WHEN 2 THEN cast(ts AS timestamp) + INTERVAL 5 MINUTES END AS ends_at""",
        "cast(NULL AS string) AS generator_url",
        "event_id % 7 <> 0 AS call_ok",
    )


def mutes_from_events(ev: DataFrame) -> DataFrame:
    """Derived mutes: one per event with ``event_id % 250 = 0``.

    Matcher shapes rotate over four forms, the last one with an empty value
    (the loose/strict trap).
    """
    return ev.where(f"event_id % {MUTE_EVERY} = 0").selectExpr(
        "concat('m', event_id) AS id",
        f"""CASE floor(event_id / {MUTE_EVERY}) % 4
            WHEN 0 THEN map('alertname', event_type, 'instance', concat('host-', user_id % 10))
            WHEN 1 THEN map('instance', concat('host-', user_id % 10))
            WHEN 2 THEN map('severity', 'info', 'instance', concat('host-', user_id % 10))
            ELSE map('team', '', 'instance', concat('host-', user_id % 10)) END AS matchers""",
        "cast(ts AS timestamp) AS starts_at",
        f"""cast(ts AS timestamp) + make_dt_interval(0, cast(12 * (1 + floor(event_id / {MUTE_EVERY}) % 5) AS int)) AS ends_at""",
        "concat('c', event_id) AS comment",
        "concat('u', user_id) AS created_by",
    )


def load_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts_from_events(events(spark, sf_dir))


def load_mutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutes_from_events(events(spark, sf_dir))
