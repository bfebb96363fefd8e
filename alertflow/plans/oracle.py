"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark code: labels are flat columns, rule and
mute conditions are spelled out, the fingerprint is FNV-1a over HUGEINT, and
the delivery state machine uses the run formulation (``lag`` + running
``sum`` + a bool_or frame) rather than the prefix maxima of the Spark plan.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-16 00:00:00'"


def _ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def _rfc(c: str) -> str:
    frac = f"rtrim(strftime({c}, '%f'), '0')"
    return (f"(strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {frac} <> '' THEN '.' || {frac} ELSE '' END"
            f" || 'Z')")


_RULE_COND = """CASE {r}.rule_idx
       WHEN 0 THEN coalesce({a}.severity, '') = 'critical' AND coalesce({a}.team, '') = 'infra'
       WHEN 1 THEN coalesce({a}.severity, '') = 'critical'
       WHEN 2 THEN coalesce({a}.team, '') = 'infra' AND coalesce({a}.severity, '') = 'warning'
       WHEN 3 THEN coalesce({a}.chaos, '') = 'fail'
       WHEN 4 THEN coalesce({a}.source, '') = 'noisy-system'
       ELSE true END"""

_LOOSE = """((CASE {m}.kind WHEN 0 THEN coalesce({a}.alertname, '') = {m}.m_alertname
                   WHEN 2 THEN coalesce({a}.severity, '') = 'info'
                   WHEN 3 THEN coalesce({a}.team, '') = ''
                   ELSE true END) AND coalesce({a}.instance, '') = {m}.m_instance)"""

_STRICT = """((CASE {m}.kind WHEN 0 THEN {a}.alertname IS NOT NULL AND {a}.alertname = {m}.m_alertname
                    WHEN 2 THEN {a}.severity IS NOT NULL AND {a}.severity = 'info'
                    WHEN 3 THEN {a}.team IS NOT NULL AND {a}.team = ''
                    ELSE true END) AND {a}.instance IS NOT NULL AND {a}.instance = {m}.m_instance)"""


def loose(a="x", m="mu"):
    return _LOOSE.format(a=a, m=m)


def strict(a="x", m="mu"):
    return _STRICT.format(a=a, m=m)


PRELUDE = f"""
WITH a AS (
  SELECT event_id AS alert_id, ts AS observed_at, event_id AS seq, event_type AS alertname,
    CASE WHEN value >= 113 THEN 'critical' WHEN value >= 35 THEN 'warning' ELSE 'info' END AS severity,
    CASE user_id % 3 WHEN 0 THEN 'infra' WHEN 1 THEN 'platform' END AS team,
    'host-' || CAST(user_id % 10 AS VARCHAR) AS instance,
    CASE WHEN user_id % 10 = 3 THEN 'noisy-system' END AS source,
    CASE WHEN user_id % 10 = 7 THEN 'fail' END AS chaos,
    date_trunc('hour', ts) AS starts_at,
    CASE event_id % 5 WHEN 0 THEN ts - INTERVAL 1 MINUTE WHEN 1 THEN ts
                      WHEN 2 THEN ts + INTERVAL 5 MINUTE END AS ends_at,
    event_id % 7 <> 0 AS call_ok
  FROM events),
al AS (
  SELECT *, list_filter([{{'k': 'alertname', 'v': alertname}}, {{'k': 'chaos', 'v': chaos}},
                         {{'k': 'instance', 'v': instance}}, {{'k': 'severity', 'v': severity}},
                         {{'k': 'source', 'v': source}}, {{'k': 'team', 'v': team}}],
                        lambda e: e.v IS NOT NULL) AS lab
  FROM a),
alh AS (
  SELECT *, array_to_string(list_transform(lab, lambda e: hex(encode(e.k)) || 'FF' || hex(encode(e.v)) || 'FF'), '')
            AS lhex
  FROM al),
af AS (
  SELECT * EXCLUDE (lab, lhex),
    printf('%016x', list_reduce(
        list_transform(range(0, length(lhex) // 2), lambda i: ('0x' || substr(lhex, 2 * i + 1, 2))::INTEGER),
        lambda acc, b: (xor(acc, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT,
        14695981039346656037::HUGEINT)::UBIGINT) AS fingerprint,
    array_to_string(list_transform(lab, lambda e: e.k || '="' || e.v || '"'), ', ') AS label_text
  FROM alh),
rules(rule_idx, rule_name, receiver, cont) AS (VALUES
  (0, 'critical-to-infra', 'infra-critical-pager', true),
  (1, 'critical-mirror', 'oncall-mirror', false),
  (2, 'infra-warnings', 'infra-warning-chat', false),
  (3, 'chaos-fail', 'failing-webhook', false),
  (4, 'noisy-suppress', 'log-sink', false),
  (5, 'catch-all', 'log-sink', false)),
receivers(receiver, receiver_type) AS (VALUES
  ('infra-critical-pager', 'webhook'), ('oncall-mirror', 'webhook'), ('infra-warning-chat', 'webhook'),
  ('failing-webhook', 'webhook'), ('log-sink', 'webhook')),
hits AS (
  SELECT x.*, r.rule_idx, r.rule_name, r.receiver, r.cont
  FROM af x JOIN rules r ON {_RULE_COND.format(r='r', a='x')}),
dec AS (
  SELECT * EXCLUDE (stop) FROM (
    SELECT *, min(CASE WHEN NOT cont THEN rule_idx END) OVER (PARTITION BY alert_id) AS stop FROM hits)
  WHERE rule_idx <= coalesce(stop, 1000)),
mu AS (
  SELECT 'm' || CAST(event_id AS VARCHAR) AS id, event_id // 250 AS n, (event_id // 250) % 4 AS kind,
    event_type AS m_alertname, 'host-' || CAST(user_id % 10 AS VARCHAR) AS m_instance,
    ts AS m_starts_at, ts + to_hours(CAST(12 * (1 + (event_id // 250) % 5) AS BIGINT)) AS m_ends_at,
    'c' || CAST(event_id AS VARCHAR) AS comment, 'u' || CAST(user_id AS VARCHAR) AS created_by
  FROM events WHERE event_id % 250 = 0),
mpairs AS (
  SELECT x.alert_id, mu.id AS mute_id, {loose()} AS loose, {strict()} AS strict
  FROM af x JOIN mu ON x.observed_at BETWEEN mu.m_starts_at AND mu.m_ends_at),
muted_ids AS (SELECT DISTINCT alert_id FROM mpairs WHERE loose)
"""


def _plan_ctes(src: str, name: str) -> str:
    """Run-based state machine over decision rows in ``src``."""
    return f""",
{name}_d AS (
  SELECT *, CASE WHEN ends_at IS NOT NULL AND ends_at <= observed_at THEN 'resolved-sent' ELSE 'firing-sent' END
              AS desired,
         call_ok AND receiver <> 'failing-webhook' AS ok
  FROM {src}),
{name}_l AS (
  SELECT *, lag(desired) OVER (PARTITION BY rule_name, fingerprint ORDER BY observed_at, seq) AS prev
  FROM {name}_d),
{name}_r AS (
  SELECT *, sum(CASE WHEN prev IS DISTINCT FROM desired THEN 1 ELSE 0 END)
              OVER (PARTITION BY rule_name, fingerprint ORDER BY observed_at, seq ROWS UNBOUNDED PRECEDING) AS run_id
  FROM {name}_l),
{name} AS (
  SELECT *, CASE WHEN deliver THEN CASE WHEN ok THEN desired ELSE replace(desired, '-sent', '-failed') END END
              AS status
  FROM (SELECT *, NOT coalesce(bool_or(ok) OVER (PARTITION BY rule_name, fingerprint, run_id ORDER BY observed_at, seq
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS deliver
        FROM {name}_r))
"""


PLAN = PRELUDE + _plan_ctes("dec", "plan")
PLAN_MUTED = PRELUDE + ", dec_u AS (SELECT * FROM dec WHERE alert_id NOT IN (SELECT alert_id FROM muted_ids))" \
    + _plan_ctes("dec_u", "plan")

_STATE = f""",
pushes AS (SELECT * FROM af WHERE observed_at <= {AS_OF}),
st AS (
  SELECT f.fingerprint, f.label_text, f.alertname, f.severity, f.team, f.instance, f.source, f.chaos,
         f.starts_at, l.ends_at, f.observed_at AS first_seen_at, l.observed_at AS last_seen_at
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY observed_at, seq) AS k
                       FROM pushes) WHERE k = 1) f
  JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY observed_at DESC, seq DESC) AS k
                       FROM pushes) WHERE k = 1) l USING (fingerprint))
"""

_SETS = f""",
every AS (SELECT DISTINCT fingerprint, alertname, severity, team, instance, source, chaos FROM af),
sets AS (
  SELECT x.*, EXISTS (SELECT 1 FROM mu WHERE mu.m_starts_at <= {AS_OF} AND {AS_OF} <= mu.m_ends_at
                      AND {loose()}) AS muted
  FROM every x)"""

_VIEW = f"fingerprint, label_text, {_ts('ends_at')} AS ends_at, {_ts('last_seen_at')} AS last_seen_at"


def _verify_routes() -> str:
    cand = _RULE_COND.format(r="r", a="x")
    return f""",
cases AS (SELECT DISTINCT fingerprint, alertname, severity, team, instance, source, chaos FROM af),
hit_all AS (
  SELECT x.fingerprint, r.rule_idx, r.rule_name, r.receiver, r.cont,
         CASE WHEN r.rule_idx = 0 THEN false ELSE r.cont END AS cont_c
  FROM cases x JOIN rules r ON {cand}),
exp_r AS (
  SELECT fingerprint, list(rule_name) AS er, list(receiver) AS ev FROM (
    SELECT *, min(CASE WHEN NOT cont THEN rule_idx END) OVER (PARTITION BY fingerprint) AS stop FROM hit_all)
  WHERE rule_idx <= coalesce(stop, 1000) GROUP BY fingerprint),
got_r AS (
  SELECT fingerprint, list(rule_name) AS gr, list(receiver) AS gv FROM (
    SELECT *, min(CASE WHEN NOT cont_c THEN rule_idx END) OVER (PARTITION BY fingerprint) AS stop FROM hit_all)
  WHERE rule_idx <= coalesce(stop, 1000) GROUP BY fingerprint),
vres AS (
  SELECT fingerprint AS name,
    list_sort(er) = list_sort(gr) AS rok, list_sort(ev) = list_sort(gv) AS vok,
    'expected rules     [' || array_to_string(list_sort(er), ' ') || '], got ['
      || array_to_string(list_sort(gr), ' ') || ']' AS rmsg,
    'expected receivers [' || array_to_string(list_sort(ev), ' ') || '], got ['
      || array_to_string(list_sort(gv), ' ') || ']' AS vmsg
  FROM exp_r JOIN got_r USING (fingerprint))
"""


ORACLES: dict[str, str] = {
    "alert_fingerprints": PRELUDE + """
SELECT fingerprint, label_text, count(*) AS n_alerts FROM af GROUP BY fingerprint, label_text""",

    "route_decisions": PRELUDE + """
SELECT alert_id, rule_idx, rule_name, receiver FROM dec""",

    "route_receivers": PRELUDE + """
SELECT d.rule_name, d.receiver, r.receiver_type, count(*) AS decisions
FROM dec d LEFT JOIN receivers r USING (receiver) GROUP BY d.rule_name, d.receiver, r.receiver_type""",

    "unrouted_alerts": PRELUDE + f"""
SELECT alert_id FROM af x
WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.rule_idx < 5 AND {_RULE_COND.format(r='r', a='x')})""",

    "muted_alerts": PRELUDE + """
SELECT alert_id FROM af WHERE alert_id IN (SELECT alert_id FROM muted_ids)""",

    "unmuted_alerts": PRELUDE + """
SELECT alert_id FROM af WHERE alert_id NOT IN (SELECT alert_id FROM muted_ids)""",

    "mute_attribution": PRELUDE + """
SELECT alert_id, mute_id FROM mpairs WHERE loose""",

    "loose_vs_strict": PRELUDE + """
SELECT mute_id, count(*) FILTER (WHERE loose) AS loose_pairs, count(*) FILTER (WHERE strict) AS strict_pairs
FROM mpairs GROUP BY mute_id HAVING count(*) FILTER (WHERE loose) > 0""",

    "delivery_plan": PLAN + """
SELECT alert_id, rule_name, fingerprint, desired, deliver, status FROM plan""",

    "delivery_plan_seeded": PLAN + f"""
SELECT alert_id, rule_name, fingerprint, desired, deliver, status FROM plan WHERE observed_at > {AS_OF}""",

    "decisions_with_history": PRELUDE + f""",
dec_h AS (SELECT * FROM dec WHERE observed_at <= {AS_OF})""" + _plan_ctes("dec_h", "ph") + f""",
snap AS (
  SELECT rule_name, fingerprint, status AS prev_status FROM (
    SELECT *, row_number() OVER (PARTITION BY rule_name, fingerprint ORDER BY observed_at DESC, seq DESC) AS k
    FROM ph WHERE deliver) WHERE k = 1)
SELECT d.alert_id, d.rule_name, s.prev_status,
  coalesce(s.prev_status = CASE WHEN d.ends_at IS NOT NULL AND d.ends_at <= d.observed_at
                                THEN 'resolved-sent' ELSE 'firing-sent' END, false) AS already_delivered
FROM dec d LEFT JOIN snap s USING (rule_name, fingerprint)
WHERE d.observed_at > {AS_OF}""",

    "notification_snapshot": PLAN + f"""
SELECT rule_name, fingerprint, {_ts('observed_at')} AS sent_at, status FROM (
  SELECT *, row_number() OVER (PARTITION BY rule_name, fingerprint ORDER BY observed_at DESC, seq DESC) AS k
  FROM plan WHERE deliver) WHERE k = 1""",

    "alert_state": PRELUDE + f"""
SELECT f.fingerprint, f.label_text, {_ts('f.starts_at')} AS starts_at, {_ts('l.ends_at')} AS ends_at,
       {_ts('f.observed_at')} AS first_seen_at, {_ts('l.observed_at')} AS last_seen_at
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY observed_at, seq) AS k FROM af)
      WHERE k = 1) f
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY observed_at DESC, seq DESC) AS k
                     FROM af) WHERE k = 1) l USING (fingerprint)""",

    "alert_state_retained": PRELUDE + f"""
SELECT f.fingerprint, f.label_text, {_ts('f.starts_at')} AS starts_at, {_ts('l.ends_at')} AS ends_at,
       {_ts('f.observed_at')} AS first_seen_at, {_ts('l.observed_at')} AS last_seen_at
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY observed_at, seq) AS k FROM af)
      WHERE k = 1) f
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY observed_at DESC, seq DESC) AS k
                     FROM af) WHERE k = 1) l USING (fingerprint)
WHERE l.observed_at >= {AS_OF}""",

    "list_firing": PRELUDE + _STATE + f"""
SELECT {_VIEW}, 'firing' AS status FROM st WHERE ends_at IS NULL OR ends_at > {AS_OF}
ORDER BY last_seen_at DESC, fingerprint LIMIT 100""",

    "list_firing_unmuted": PRELUDE + _STATE + f"""
SELECT {_VIEW}, 'firing' AS status FROM st x
WHERE (ends_at IS NULL OR ends_at > {AS_OF})
  AND NOT EXISTS (SELECT 1 FROM mu WHERE mu.m_starts_at <= {AS_OF} AND {AS_OF} <= mu.m_ends_at AND {strict()})
ORDER BY last_seen_at DESC, fingerprint LIMIT 100""",

    "list_expired": PRELUDE + _STATE + f"""
SELECT {_VIEW}, 'expired' AS status FROM st WHERE ends_at IS NOT NULL AND ends_at <= {AS_OF}
ORDER BY last_seen_at DESC, fingerprint LIMIT 100""",

    "get_alerts": PRELUDE + _STATE + f""",
keys AS (SELECT DISTINCT fingerprint FROM af WHERE observed_at > {AS_OF})
SELECT k.fingerprint, st.fingerprint IS NOT NULL AS found,
  CASE WHEN st.fingerprint IS NULL THEN NULL
       WHEN st.ends_at IS NOT NULL AND st.ends_at <= {AS_OF} THEN 'expired' ELSE 'firing' END AS status,
  CASE WHEN st.fingerprint IS NULL THEN 'alert "' || k.fingerprint || '" not found' END AS error
FROM keys k LEFT JOIN st USING (fingerprint)""",

    "matching_alerts": PRELUDE + _STATE + f"""
SELECT {_VIEW}, 'firing' AS status FROM st
WHERE severity = 'critical' AND (ends_at IS NULL OR ends_at > {AS_OF})
ORDER BY last_seen_at DESC, fingerprint LIMIT 100""",

    "mute_overview": PRELUDE + _STATE + f""",
pm AS (SELECT *, CASE WHEN {AS_OF} < m_starts_at THEN 'pending' WHEN {AS_OF} > m_ends_at THEN 'expired'
                      ELSE 'active' END AS status
       FROM mu WHERE m_ends_at >= {AS_OF}),
top AS (
  SELECT * FROM (
    SELECT mu.id, x.fingerprint,
           row_number() OVER (PARTITION BY mu.id ORDER BY x.last_seen_at DESC, x.fingerprint) AS rank
    FROM pm mu JOIN st x ON {strict()}
    WHERE mu.status <> 'expired' AND (x.ends_at IS NULL OR x.ends_at > {AS_OF}))
  WHERE rank <= 100)
SELECT pm.id, pm.status, top.fingerprint, top.rank FROM pm LEFT JOIN top USING (id)""",

    "list_mutes": PRELUDE + f"""
SELECT id,
  CASE kind WHEN 0 THEN 'alertname=' || m_alertname || ' instance=' || m_instance
            WHEN 1 THEN 'instance=' || m_instance
            WHEN 2 THEN 'instance=' || m_instance || ' severity=info'
            ELSE 'instance=' || m_instance || ' team=' END AS matcher_text,
  {_ts('m_starts_at')} AS starts_at, {_ts('m_ends_at')} AS ends_at,
  CASE WHEN {AS_OF} < m_starts_at THEN 'pending' WHEN {AS_OF} > m_ends_at THEN 'expired' ELSE 'active' END AS status
FROM mu WHERE m_ends_at >= {AS_OF}""",

    "list_mutes_expired": PRELUDE + f"""
SELECT id, {_ts('m_ends_at')} AS ends_at, 'expired' AS status FROM mu WHERE m_ends_at < {AS_OF}""",

    "mute_validation": PRELUDE + """
SELECT id,
  CASE WHEN n % 7 = 3 THEN 'ends_at' WHEN n % 10 = 0 THEN 'comment' END AS field,
  CASE WHEN n % 7 = 3 THEN 'ends_at must be after starts_at' WHEN n % 10 = 0 THEN 'comment is required' END
    AS message
FROM mu""",

    "mute_expire": PRELUDE + f"""
SELECT id, {_ts('e')} AS ends_at,
  CASE WHEN {AS_OF} < m_starts_at THEN 'pending' WHEN {AS_OF} > e THEN 'expired' ELSE 'active' END AS status
FROM (SELECT *, CASE WHEN m_starts_at <= {AS_OF} AND {AS_OF} <= m_ends_at THEN {AS_OF} ELSE m_ends_at END AS e
      FROM mu)""",

    "mute_text_roundtrip": PRELUDE + """
SELECT id,
  CASE kind WHEN 0 THEN 'alertname=' || m_alertname || ' instance=' || m_instance
            WHEN 1 THEN 'instance=' || m_instance
            WHEN 2 THEN 'instance=' || m_instance || ' severity=info'
            ELSE 'instance=' || m_instance || ' team=' END AS matcher_text,
  kind <> 3 AS roundtrip_ok,
  CASE WHEN kind = 3 THEN 'invalid matcher "team=": expected key=value' END AS parse_error,
  (CASE WHEN h // 24 > 0 THEN CAST(h // 24 AS VARCHAR) || 'd' ELSE '' END)
    || (CASE WHEN h % 24 > 0 THEN CAST(h % 24 AS VARCHAR) || 'h' ELSE '' END) AS duration_text,
  CAST(h AS BIGINT) * 3600000 AS duration_ms
FROM (SELECT *, 12 * (1 + n % 5) AS h FROM mu)""",

    "verify_cases": PRELUDE + _verify_routes() + """
SELECT name, rok AND vok AS pass,
  concat_ws(' | ', CASE WHEN NOT rok THEN rmsg END, CASE WHEN NOT vok THEN vmsg END) AS mismatches
FROM vres""",

    "verify_summary": PRELUDE + _verify_routes() + """
SELECT count(*) FILTER (WHERE rok AND vok) AS passed, count(*) FILTER (WHERE NOT (rok AND vok)) AS failed,
       count(*) AS total
FROM vres""",

    "explain_trace": PRELUDE + _SETS + f""",
conds(rule_idx, condition) AS (VALUES
  (0, 'severity="critical", team="infra"'), (1, 'severity="critical"'), (2, 'severity="warning", team="infra"'),
  (3, 'chaos="fail"'), (4, 'source="noisy-system"'), (5, '(catch-all)')),
evals AS (
  SELECT x.fingerprint, r.rule_idx, r.rule_name, r.receiver, r.cont, {_RULE_COND.format(r='r', a='x')} AS hit
  FROM sets x, rules r WHERE NOT x.muted),
stops AS (SELECT fingerprint, min(CASE WHEN hit AND NOT cont THEN rule_idx END) AS stop FROM evals GROUP BY fingerprint)
SELECT e.fingerprint, 'not matched' AS mute_check, e.rule_idx + 1 AS step, e.rule_name,
  CASE WHEN hit THEN 'MATCH' ELSE 'skip' END AS verdict,
  CASE WHEN hit THEN e.receiver END AS receiver,
  CASE WHEN hit THEN CASE WHEN cont THEN 'continue' ELSE 'stop' END END AS action,
  CASE WHEN hit THEN 'webhook' END AS receiver_type, c.condition
FROM evals e JOIN stops s USING (fingerprint) JOIN conds c USING (rule_idx)
WHERE e.rule_idx <= coalesce(s.stop, 1000)
UNION ALL
SELECT fingerprint, 'MATCHED', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM sets WHERE muted""",

    "final_decisions": PRELUDE + _SETS + f""",
hit AS (
  SELECT x.fingerprint, r.rule_idx, r.rule_name, r.receiver, r.cont
  FROM sets x JOIN rules r ON NOT x.muted AND r.rule_idx < 5 AND {_RULE_COND.format(r='r', a='x')}),
cut AS (SELECT *, min(CASE WHEN NOT cont THEN rule_idx END) OVER (PARTITION BY fingerprint) AS stop FROM hit),
ends AS (
  SELECT fingerprint, count(*) AS n, string_agg(rule_name || ' -> ' || receiver || ' (webhook)', ', ' ORDER BY rule_idx) AS t
  FROM cut WHERE rule_idx <= coalesce(stop, 1000) GROUP BY fingerprint)
SELECT x.fingerprint, CASE WHEN x.muted THEN 'muted' WHEN e.n IS NULL THEN 'dropped' ELSE 'delivered' END AS outcome,
  coalesce(e.n, 0)::INTEGER AS n_decisions,
  CASE WHEN x.muted THEN NULL WHEN e.n IS NULL THEN 'none, alert would be dropped' ELSE e.t END AS final
FROM sets x LEFT JOIN ends e USING (fingerprint)""",

    "process_replay": PLAN_MUTED + """
SELECT alert_id, rule_name, fingerprint, desired, deliver, status FROM plan""",

    "counters": PLAN_MUTED + """
SELECT (SELECT count(*) FROM af) AS alerts_received,
       count(*) FILTER (WHERE status LIKE '%-sent') AS notify_success,
       count(*) FILTER (WHERE status LIKE '%-failed') AS notify_failure
FROM plan""",

    "routing_report": PLAN_MUTED + """
SELECT rule_name, receiver, status, count(*) AS decisions FROM plan GROUP BY rule_name, receiver, status""",

    "webhook_payloads": PLAN_MUTED + f"""
SELECT alert_id, rule_name, receiver AS p_receiver,
  CASE WHEN ends_at IS NOT NULL AND ends_at <= observed_at THEN 'resolved' ELSE 'firing' END AS p_status,
  fingerprint AS p_fingerprint, {_rfc('starts_at')} AS p_starts_at,
  CASE WHEN ends_at IS NULL THEN '0001-01-01T00:00:00Z' ELSE {_rfc('ends_at')} END AS p_ends_at,
  instance AS p_instance
FROM plan WHERE deliver""",
}
