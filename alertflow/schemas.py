"""Target schemas and the required-table check.

Labels are the dynamic part of the model (any key, string values), so they
are ``map<string,string>``; JSON inference would turn them into structs, so
every reader passes one of these schemas explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

LABELS = T.MapType(T.StringType(), T.StringType())

ALERTS = T.StructType([
    T.StructField("alert_id", T.LongType()),
    T.StructField("observed_at", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("labels", LABELS),
    T.StructField("annotations", LABELS),
    T.StructField("starts_at", T.TimestampType()),
    T.StructField("ends_at", T.TimestampType()),
    T.StructField("generator_url", T.StringType()),
])

# One alert as posted (the common v2 alert JSON: labels, annotations, startsAt, endsAt, generatorURL).
POSTABLE_ALERT = T.StructType([
    T.StructField("labels", LABELS),
    T.StructField("annotations", LABELS),
    T.StructField("startsAt", T.TimestampType()),
    T.StructField("endsAt", T.TimestampType()),
    T.StructField("generatorURL", T.StringType()),
])

RULES = T.StructType([
    T.StructField("rule_idx", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("match", LABELS),
    T.StructField("receiver", T.StringType()),
    T.StructField("continue", T.BooleanType()),
    T.StructField("config_id", T.StringType()),
])

RECEIVERS = T.StructType([
    T.StructField("receiver_idx", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("config_id", T.StringType()),
    T.StructField("url_file", T.StringType()),
])

MUTES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("matchers", LABELS),
    T.StructField("starts_at", T.TimestampType()),
    T.StructField("ends_at", T.TimestampType()),
    T.StructField("comment", T.StringType()),
    T.StructField("created_by", T.StringType()),
])

MUTE_REQUESTS = T.StructType([
    T.StructField("matchers", LABELS),
    T.StructField("starts_at", T.TimestampType()),
    T.StructField("ends_at", T.TimestampType()),
    T.StructField("comment", T.StringType()),
    T.StructField("created_by", T.StringType()),
])

ATTEMPTS = T.StructType([
    T.StructField("rule_name", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("attempt_at", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("status", T.StringType()),
])

NOTIFICATIONS = T.StructType([
    T.StructField("rule_name", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("sent_at", T.TimestampType()),
    T.StructField("status", T.StringType()),
])

ALERT_STATE = T.StructType([
    T.StructField("fingerprint", T.StringType()),
    T.StructField("labels", LABELS),
    T.StructField("starts_at", T.TimestampType()),
    T.StructField("ends_at", T.TimestampType()),
    T.StructField("first_seen_at", T.TimestampType()),
    T.StructField("last_seen_at", T.TimestampType()),
])

CASES = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("labels", LABELS),
    T.StructField("expect_rules", T.ArrayType(T.StringType())),
    T.StructField("expect_receivers", T.ArrayType(T.StringType())),
    T.StructField("description", T.StringType()),
])

REQUIRED = {"mutes": MUTES, "notifications": NOTIFICATIONS, "alert_state": ALERT_STATE}


class SchemaError(ValueError):
    pass


def check_schema(df: DataFrame, expected: T.StructType, name: str = "table") -> DataFrame:
    """Raise early when a required column is missing or mistyped.

    Reads only the schema; no job runs.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in expected.fields:
        if f.name not in have:
            raise SchemaError(f"required column {name}.{f.name} is missing")
        if have[f.name] != f.dataType:
            raise SchemaError(f"column {name}.{f.name} has type {have[f.name].simpleString()}, "
                              f"expected {f.dataType.simpleString()}")
    return df
