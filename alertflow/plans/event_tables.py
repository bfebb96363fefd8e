"""Registered queries whose input tables (posted bodies, rule sets, requests)
are derived from every row of ``events``, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertflow.functions.labels import (fingerprint_table, format_labels, format_matchers, labels_from_json, labels_to_json,
                                        parse_matchers_text)
from alertflow.functions.status import display_time, format_duration, parse_duration_ms, parse_form_time
from alertflow.operators import mutes as mute_ops, routing, rulesets
from alertflow.operators.matching import condition_pairs
from alertflow.session import materialize
from alertflow.sources import testdata
from alertflow.sources.alerts import parse_batches
from alertflow.sources.config import Receiver, Rule, RuleSet

N_RULES = 300  # rules of route_many_rules: one per user group, then a catch-all


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def _many_rules() -> RuleSet:
    rules = [Rule(f"user-{i}", {"user": str(i)}, f"group-{i % 7}", i % 2 == 0) for i in range(N_RULES)]
    return RuleSet([*rules, Rule("catch-all", {}, "log-sink")],
                   [*(Receiver(f"group-{i}") for i in range(6)), Receiver("log-sink")])


def q_route_many_rules(spark, sf):
    """R1 + R15 with 301 rules: decisions and decisions for unknown receivers by rule."""
    alerts = _events(spark, sf).select("event_id", F.create_map(
        F.lit("user"), (F.col("user_id") % N_RULES).cast("string"), F.lit("type"), F.col("event_type")).alias("labels"))
    dec = routing.with_receiver(routing.route(alerts, _many_rules()), _many_rules())
    return dec.groupBy("rule_name", "receiver").agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if(F.col("receiver_type").isNull()).alias("unknown"))


def q_parse_alert_bodies(spark, sf):
    """S1 + S9: bodies of 20 events each; every 37th event has a fault of its own, which rejects its body whole. Other
    events write field names in other cases, repeat a label or name the labels twice; every 53rd body is ``null``."""
    e = _events(spark, sf)
    fault = F.when(F.col("event_id") % 37 == 0, F.col("event_id") % 5)
    n = F.col("event_id")
    named = (F.when(n % 11 == 0, F.format_string('"LABELS":{"alertname":"old","alertname":"%s"', "event_type"))
             .when(n % 11 == 1, F.format_string('"Labels":{"alertname":"old"},"labels":{"alertname":"%s"', "event_type"))
             .otherwise(F.format_string('"labels":{"alertname":"%s"', "event_type")))
    ends = F.when(n % 7 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(n % 7 == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise(
        "0001-01-01T00:00:00Z")
    text = F.format_string(
        '{%s,"user":%s},"annotations":%s,"endsat":%s,"generatorURL":%s}', named,
        F.when(fault == 0, F.lit("5")).when(F.col("event_id") % 3 == 0, F.lit("null")).otherwise(
            F.concat(F.lit('"u'), F.col("user_id").cast("string"), F.lit('"'))),
        F.when(fault == 1, F.lit('"x"')).otherwise(F.lit('{"k":"v"}')),
        F.when(fault == 2, F.lit('"garbage"')).when(fault == 3, F.lit("12345")).otherwise(
            F.format_string('"%s"', ends)),
        F.when(fault == 4, F.lit("{}")).otherwise(F.lit('"http://x"')))
    bodies = (e.select((F.col("event_id") / 20).cast("long").alias("body"), F.struct("event_id", text.alias("t")).alias("x"), "ts")
              .groupBy("body").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.max("ts").cast("timestamp").alias("mtime"))
              .select(F.format_string("body-%d", "body").alias("path"), "mtime", F.col("body").alias("ordinal"),
                      F.when(F.col("body") % 53 == 52, F.lit("null")).otherwise(F.concat(
                          F.lit("["), F.array_join(F.transform("xs", lambda x: x["t"]), ","), F.lit("]"))).alias("value")))
    alerts, rejects = parse_batches(bodies)
    path = F.format_string("body-%d", F.shiftright("seq", 20))
    ok = alerts.groupBy(path.alias("path")).agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("labels")["user"] == "").alias("empty_users"),
        F.count_if(F.col("ends_at").isNull()).alias("open"), F.max(F.date_format("ends_at", "yyyy-MM-dd HH:mm:ss")).alias("last_end"),
        F.count_if(F.col("labels")["alertname"] == "old").alias("old_names"), F.min(F.col("labels")["alertname"]).alias("first_name"),
        F.lit(None).cast("string").alias("error"))
    return ok.unionByName(rejects.select("path", "error"), allowMissingColumns=True).fillna(0)


def _requests(spark, sf) -> DataFrame:
    """A mute request per event; seven shapes, six of them faulty."""
    n, t = F.col("event_id") % 7, F.col("ts").cast("timestamp")
    return _events(spark, sf).select(
        "event_id", F.when(n != 1, F.create_map(F.lit("instance"), F.format_string("host-%d", F.col("user_id") % 10))).alias("matchers"),
        F.when(n != 2, t).alias("starts_at"),
        F.when(n == 3, F.lit(None)).when(n == 4, t).otherwise(t + F.expr("INTERVAL 2 HOURS")).cast("timestamp").alias("ends_at"),
        F.when(n == 5, F.lit(" \t")).otherwise(F.lit("c")).alias("comment"),
        F.when(n == 6, F.lit("")).otherwise(F.lit("u")).alias("created_by"))


def q_mute_requests(spark, sf):
    """R16 over a request from every event: the first failing field and its message."""
    err = mute_ops.validation_error()
    return _requests(spark, sf).select("event_id", err["field"].alias("field"), err["message"].alias("message"))


def q_create_mutes(spark, sf):
    """K4 over the same requests: equal requests become one mute; status at ``AS_OF``."""
    created, rejects = mute_ops.create_mutes(_requests(spark, sf), testdata.AS_OF)
    ok = created.groupBy("status", F.col("matchers")["instance"].alias("instance")).agg(F.countDistinct("id").alias("n"))
    bad = rejects.groupBy(F.lit("rejected").alias("status"), F.lit(None).cast("string").alias("instance")).agg(
        F.count(F.lit(1)).alias("n"))
    return ok.unionByName(bad)


def q_get_mutes(spark, sf):
    """A mute from every event, looked up by an id from every event; about half of the ids are unknown."""
    t = F.col("ts").cast("timestamp")
    e = _events(spark, sf)
    mutes = e.select(F.format_string("m%d", "event_id").alias("id"), F.create_map(F.lit("type"), F.col("event_type")).alias("matchers"),
                     t.alias("starts_at"), (t + F.expr("INTERVAL 2 HOURS")).alias("ends_at"), F.col("props").alias("comment"),
                     F.format_string("u%d", "user_id").alias("created_by"))
    ids = e.select(F.format_string("m%d", F.col("event_id") * 2).alias("id"))
    found, missing = mute_ops.get_mutes(mutes, ids, testdata.AS_OF)
    return found.select("id", "status", format_matchers("matchers").alias("matchers"), "created_by").unionByName(
        missing, allowMissingColumns=True)


def _rule_sets(spark, sf) -> tuple[DataFrame, DataFrame]:
    """One rule set per user: a rule per event in event order, faults by the event's number; receivers by event type."""
    e = _events(spark, sf).withColumn("config_id", F.format_string("user-%d", "user_id"))
    at = F.row_number().over(Window.partitionBy("config_id").orderBy("event_id")) - 1
    rules = e.select(
        "config_id", at.cast("int").alias("rule_idx"),
        F.when(F.col("event_id") % 41 == 0, F.lit("")).otherwise(F.format_string("r%d", F.col("event_id") % 997)).alias("name"),
        F.when(F.col("event_id") % 5 == 0, F.create_map().cast("map<string,string>")).otherwise(
            F.create_map(F.lit("alertname"), F.col("event_type"))).alias("match"),
        F.when(F.col("event_id") % 43 == 0, F.lit("nobody")).otherwise(F.col("event_type")).alias("receiver"),
        (F.col("event_id") % 2 == 0).alias("continue"))
    types = e.select("config_id", "event_type").distinct()
    recv = types.select("config_id", F.row_number().over(Window.partitionBy("config_id").orderBy("event_type")).cast("int").alias("n"),
                        F.col("event_type").alias("name"), F.lit("webhook").alias("type"), F.lit(None).cast("string").alias("url"),
                        F.lit("/run/secret").alias("url_file"))
    return rules, recv.withColumn("receiver_idx", F.col("n") - 1).drop("n")


def q_rule_set_errors(spark, sf):
    """The first error of every rule set."""
    return rulesets.first_errors(rulesets.validate_rules(*_rule_sets(spark, sf)))


def q_rule_set_lint(spark, sf):
    """Every warning of the same rule sets; a rule set per event type has no rules at all."""
    rules, _ = _rule_sets(spark, sf)
    idle = _events(spark, sf).select(F.format_string("type-%s", "event_type").alias("config_id")).distinct()
    return rulesets.lint_rules(rules, rules.select("config_id").distinct().unionByName(idle))


def q_receiver_errors(spark, sf):
    """R17, receivers: one configuration per user with a receiver per event; all five errors, the first one of each."""
    n = F.col("event_id")
    e = _events(spark, sf).withColumn("config_id", F.format_string("user-%d", "user_id"))
    at = F.row_number().over(Window.partitionBy("config_id").orderBy("event_id")) - 1
    recv = e.select(
        "config_id", at.cast("int").alias("receiver_idx"),
        F.when(n % 13 == 0, F.lit(None)).when(n % 13 == 1, F.lit("")).when(n % 13 == 2, F.col("event_type")).otherwise(
            F.format_string("recv-%d", n)).cast("string").alias("name"),
        F.when(n % 7 == 0, F.lit("")).when(n % 7 == 1, F.lit("pager")).when(n % 7 != 2, F.lit("webhook")).alias("type"),
        F.when(n % 3 == 0, F.lit("http://x")).when(n % 3 == 1, F.lit("")).alias("url"),
        F.when(n % 4 == 0, F.lit("/run/secret")).when(n % 4 == 1, F.lit("")).alias("url_file"))
    return rulesets.validate_receivers(recv).select("config_id", "ord", "message")


def q_condition_shapes(spark, sf):
    """Condition join by rarest anchors: 31 key shapes, every condition and every label set carries cluster=prod.
    Per condition, the label sets and alerts that match it, loose (F1) and strict (F2)."""
    labels = testdata.load_alerts(spark, sf).select("alert_id", F.map_concat("labels", F.expr("map('cluster', 'prod')")).alias("labels"))
    sets = fingerprint_table(labels).select(F.map_from_entries("_lkey").alias("labels"), "_n")
    conds = materialize(labels.selectExpr("""map_from_entries(concat(array(named_struct('key', 'cluster', 'value', 'prod')),
        transform(filter(array('alertname', 'severity', 'team', 'instance', 'source'),
                         (k, i) -> shiftright(cast(alert_id % 31 + 1 AS int), i) % 2 = 1),
                  k -> named_struct('key', k, 'value', coalesce(labels[k], ''))))) AS m""").groupBy(format_matchers("m").alias("condition")).agg(
        F.count(F.lit(1)).alias("n_events"), F.any_value("m").alias("m")))
    out = conds.select("condition", "n_events")
    for mode in ("loose", "strict"):
        pairs = condition_pairs(sets, conds.select("condition", "m"), matchers="m", mode=mode)
        n = pairs.groupBy("condition").agg(F.count(F.lit(1)).alias(f"{mode}_sets"), F.sum("_n").alias(f"{mode}_alerts"))
        out = out.join(n, "condition", "left")
    return out.fillna(0)


def q_text_functions(spark, sf):
    """F11 to F17, F22, F23 on texts made from every event (F12: every error path)."""
    span = F.when(F.col("event_id") % 9 == 0, F.lit(0)).otherwise(F.col("event_id") * 61_000 % 400_000_000)
    labels = F.create_map(F.lit("z"), F.concat(F.col("event_type"), F.lit('"\\')), F.lit("a"), F.col("user_id").cast("string"))
    n = F.col("event_id") % 6
    text = (F.when(n == 0, F.lit("  ")).when(n == 1, F.lit("=x")).when(n == 2, F.concat(F.col("event_type"), F.lit("=")))
            .when(n == 3, F.lit("plain")).otherwise(F.concat(F.lit("b="), F.col("event_type"), F.lit("  a=1 b=2"))))
    parsed = parse_matchers_text(text)
    js = F.concat(F.lit('{"z":"1","a":"'), F.col("event_type"), F.lit('"}'))
    form = F.date_format("ts", "yyyy-MM-dd'T'HH:mm")
    return _events(spark, sf).select(
        "event_id", labels_to_json(parsed["matchers"]).alias("matchers"), parsed["error"].alias("error"),
        labels_to_json(labels_from_json(js)).alias("json"),
        F.date_format(parse_form_time(F.when(n == 5, F.lit("junk")).otherwise(form)), "yyyy-MM-dd HH:mm:ss").alias("form_time"),
        display_time(F.col("ts").cast("timestamp")).alias("shown"), format_duration(span).alias("duration"),
        parse_duration_ms(F.concat(format_duration(span), F.lit(" 90s"))).alias("duration_ms"),
        parse_duration_ms(F.when(n == 0, F.lit("0m")).when(n == 1, F.lit("soon"))).alias("no_duration"),
        format_labels(labels).alias("label_text"), format_matchers(labels).alias("matcher_text"))


QUERIES = {
    "route_many_rules": q_route_many_rules,
    "parse_alert_bodies": q_parse_alert_bodies,
    "mute_requests": q_mute_requests,
    "create_mutes": q_create_mutes,
    "get_mutes": q_get_mutes,
    "rule_set_errors": q_rule_set_errors,
    "rule_set_lint": q_rule_set_lint,
    "receiver_errors": q_receiver_errors,
    "text_functions": q_text_functions,
    "condition_shapes": q_condition_shapes,
}

_REQUESTS = """
req AS (SELECT event_id, ts, 'host-' || (user_id % 10) AS instance, event_id % 7 AS n FROM events)"""

ORACLES = {
    "route_many_rules": f"""
WITH u AS (SELECT user_id % {N_RULES} AS u FROM events),
d AS (SELECT 'user-' || u AS rule_name, 'group-' || (u % 7) AS receiver FROM u
  UNION ALL SELECT 'catch-all', 'log-sink' FROM u WHERE u % 2 = 0)
SELECT rule_name, receiver, count(*) AS decisions, count(*) FILTER (receiver = 'group-6') AS unknown FROM d GROUP BY ALL""",

    "parse_alert_bodies": """
WITH b AS (
  SELECT event_id // 20 AS body, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS e, min(event_type) AS name,
    count(*) FILTER (event_id % 7 > 1) AS o, bool_or(event_id % 37 = 0) AS bad,
    max(CASE event_id % 7 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) END) AS ends FROM events GROUP BY 1)
SELECT 'body-' || body AS path, CASE WHEN bad THEN 0 ELSE n END AS alerts, CASE WHEN bad THEN 0 ELSE e END AS empty_users,
  CASE WHEN bad THEN 0 ELSE o END AS open, CASE WHEN NOT bad THEN strftime(ends, '%Y-%m-%d %H:%M:%S') END AS last_end,
  0::BIGINT AS old_names, CASE WHEN NOT bad THEN name END AS first_name, CASE WHEN bad THEN 'malformed alert batch' END AS error
FROM b WHERE body % 53 <> 52""",

    "mute_requests": f"""
WITH {_REQUESTS}
SELECT event_id,
  CASE n WHEN 1 THEN 'matchers' WHEN 2 THEN 'starts_at' WHEN 3 THEN 'ends_at' WHEN 4 THEN 'ends_at' WHEN 5 THEN 'comment'
    WHEN 6 THEN 'created_by' END AS field,
  CASE n WHEN 1 THEN 'matchers must be non-empty' WHEN 2 THEN 'starts_at and ends_at are required'
    WHEN 3 THEN 'starts_at and ends_at are required' WHEN 4 THEN 'ends_at must be after starts_at'
    WHEN 5 THEN 'comment is required' WHEN 6 THEN 'created_by is required' END AS message
FROM req""",

    "create_mutes": f"""
WITH {_REQUESTS},
m AS (SELECT DISTINCT instance, ts FROM req WHERE n = 0),
t AS (SELECT TIMESTAMP '{testdata.AS_OF}' AS t)
SELECT CASE WHEN ts > t THEN 'pending' WHEN ts + INTERVAL 2 HOUR < t THEN 'expired' ELSE 'active' END AS status,
  instance, count(*) AS n FROM m, t GROUP BY ALL
UNION ALL SELECT 'rejected', NULL, count(*) FROM req WHERE n <> 0""",

    "get_mutes": f"""
WITH t AS (SELECT TIMESTAMP '{testdata.AS_OF}' AS t),
i AS (SELECT event_id * 2 AS n FROM events)
SELECT 'm' || i.n AS id,
  CASE WHEN e.event_id IS NULL THEN NULL WHEN ts > t THEN 'pending' WHEN ts + INTERVAL 2 HOUR < t THEN 'expired' ELSE 'active' END AS status,
  'type=' || event_type AS matchers, 'u' || user_id AS created_by,
  CASE WHEN e.event_id IS NULL THEN 'mute "m' || i.n || '" not found' END AS error
FROM t, i LEFT JOIN events e ON e.event_id = i.n""",

    "rule_set_errors": """
WITH r AS (
  SELECT 'user-' || user_id AS config_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
    CASE WHEN event_id % 41 = 0 THEN '' ELSE 'r' || (event_id % 997) END AS name, event_id % 43 = 0 AS lost FROM events),
e AS (
  SELECT config_id, k, CASE WHEN name = '' THEN 'rule #' || k || ': name is required'
    WHEN row_number() OVER (PARTITION BY config_id, name ORDER BY k) > 1 THEN 'rule #' || k || ': duplicate name "' || name || '"'
    WHEN lost THEN 'rule "' || name || '": references undefined receiver "nobody"' END AS error FROM r)
SELECT config_id, arg_min(error, k) AS error FROM e WHERE error IS NOT NULL GROUP BY config_id""",

    "rule_set_lint": """
WITH r AS (
  SELECT 'user-' || user_id AS config_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
    count(*) OVER (PARTITION BY user_id) AS n,
    CASE WHEN event_id % 41 = 0 THEN '' ELSE 'r' || (event_id % 997) END AS name FROM events)
SELECT config_id, 1::INT AS ord,
  'warning: last rule is not a catch-all; alerts not matching any rule will be silently dropped' AS warning
FROM r WHERE k = n AND event_id % 5 <> 0
UNION ALL SELECT config_id, (k + 1)::INT, 'warning: rule #' || k || ' ("' || name
  || '") is a non-continue catch-all in non-final position; subsequent rules will never execute'
FROM r WHERE k < n AND event_id % 5 = 0 AND event_id % 2 = 1
UNION ALL SELECT DISTINCT 'type-' || event_type, 0, 'warning: no rules defined; all alerts will be dropped' FROM events""",

    "receiver_errors": """
WITH r AS (
  SELECT 'user-' || user_id AS config_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord,
    CASE event_id % 13 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN event_type ELSE 'recv-' || event_id END AS name,
    CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'pager' WHEN 2 THEN '' ELSE 'webhook' END AS type,
    event_id % 3 <> 0 AND event_id % 4 <> 0 AS unlinked FROM events),
d AS (SELECT *, row_number() OVER (PARTITION BY config_id, name ORDER BY ord) > 1 AS dup FROM r),
m AS (
  SELECT config_id, ord, CASE WHEN name = '' THEN 'receiver #' || (ord + 1) || ': name is required'
    WHEN dup THEN 'receiver "' || name || '": duplicate name' WHEN type = '' THEN 'receiver "' || name || '": type is required'
    WHEN type = 'webhook' AND unlinked THEN 'receiver "' || name || '": webhook receiver requires url or url_file'
    WHEN type = 'pager' THEN 'receiver "' || name || '": unknown receiver type "pager" (only "webhook" is configurable)'
    END AS message FROM d)
SELECT config_id, ord, message FROM m WHERE message IS NOT NULL""",

    "text_functions": """
SELECT event_id, CASE WHEN event_id % 6 > 3 THEN '{"a":"1","b":"2"}' END AS matchers,
  CASE event_id % 6 WHEN 0 THEN 'matchers must be non-empty' WHEN 1 THEN 'invalid matcher "=x": expected key=value'
    WHEN 2 THEN 'invalid matcher "' || event_type || '=": expected key=value'
    WHEN 3 THEN 'invalid matcher "plain": expected key=value' END AS error,
  '{"a":"' || event_type || '","z":"1"}' AS json,
  CASE WHEN event_id % 6 <> 5 THEN strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') END AS form_time,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown,
  CASE WHEN m = 0 THEN '0m' ELSE (CASE WHEN m >= 1440 THEN (m // 1440) || 'd' ELSE '' END)
    || (CASE WHEN m // 60 % 24 > 0 THEN (m // 60 % 24) || 'h' ELSE '' END)
    || (CASE WHEN m % 60 > 0 THEN (m % 60) || 'm' ELSE '' END) END AS duration,
  m * 60000 + 90000 AS duration_ms, NULL::BIGINT AS no_duration,
  'a="' || user_id || '", z="' || event_type || '\\"\\\\"' AS label_text,
  'a=' || user_id || ' z=' || event_type || '"\\' AS matcher_text
FROM (SELECT *, CASE WHEN event_id % 9 = 0 THEN 0 ELSE event_id * 61000 % 400000000 // 60000 END AS m FROM events)""",

    "condition_shapes": """
WITH a AS (
  SELECT event_id % 31 + 1 AS bits, event_type AS alertname,
    CASE WHEN value >= 113 THEN 'critical' WHEN value >= 35 THEN 'warning' ELSE 'info' END AS severity,
    CASE user_id % 3 WHEN 0 THEN 'infra' WHEN 1 THEN 'platform' END AS team, 'host-' || (user_id % 10) AS instance,
    CASE WHEN user_id % 10 = 3 THEN 'noisy-system' END AS source, CASE WHEN user_id % 10 = 7 THEN 'fail' END AS chaos
  FROM events),
sets AS (SELECT alertname, severity, team, instance, source, chaos, count(*) AS n FROM a GROUP BY ALL),
c AS (
  SELECT CASE WHEN bits & 1 > 0 THEN alertname END AS c1, CASE WHEN bits & 2 > 0 THEN severity END AS c2,
    CASE WHEN bits & 4 > 0 THEN coalesce(team, '') END AS c3, CASE WHEN bits & 8 > 0 THEN instance END AS c4,
    CASE WHEN bits & 16 > 0 THEN coalesce(source, '') END AS c5, count(*) AS n_events FROM a GROUP BY ALL),
j AS (
  SELECT c.*, s.n, (c3 IS NULL OR s.team = c3) AND (c5 IS NULL OR s.source = c5) AS strict
  FROM c JOIN sets s ON (c1 IS NULL OR s.alertname = c1) AND (c2 IS NULL OR s.severity = c2)
    AND (c3 IS NULL OR coalesce(s.team, '') = c3) AND (c4 IS NULL OR s.instance = c4)
    AND (c5 IS NULL OR coalesce(s.source, '') = c5))
SELECT coalesce('alertname=' || c1 || ' ', '') || 'cluster=prod' || coalesce(' instance=' || c4, '')
    || coalesce(' severity=' || c2, '') || coalesce(' source=' || c5, '') || coalesce(' team=' || c3, '') AS condition,
  n_events, count(*) AS loose_sets, sum(n)::BIGINT AS loose_alerts, count(*) FILTER (strict) AS strict_sets,
  coalesce(sum(n) FILTER (strict), 0)::BIGINT AS strict_alerts
FROM j GROUP BY c1, c2, c3, c4, c5, n_events""",
}
