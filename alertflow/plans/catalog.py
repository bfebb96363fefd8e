"""The registered queries (Spark) and their DuckDB oracle SQL.

Every query reads the driver's tables (alerts and mutes are derived from
``events``) and processes all of them. Timestamps are returned as text with
six fractional digits, and every computed column is aliased, so the Spark
and SQL results compare column by column.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertflow.functions.labels import (fingerprint_table, format_labels, format_matchers, parse_matchers_text,
                                        with_fingerprint)
from alertflow.functions.status import (format_duration, mute_status, parse_duration_ms)
from alertflow.operators import delivery, metrics, mutes as mute_ops, observed, routing, rulesets
from alertflow.plans.pipeline import replay, routed_decisions
from alertflow.sinks.outbox import payload
from alertflow.sources import testdata
from alertflow.sources.config import EXAMPLE_FAILING_RECEIVERS, Rule, RuleSet, example_ruleset

AS_OF = testdata.AS_OF
PAYLOAD_READ_SCHEMA = ("receiver string, status string, alerts array<struct<status: string, "
                       "labels: map<string,string>, startsAt: string, endsAt: string, fingerprint: string>>")
TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def ts_text(c) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, TS_FMT)


def _ruleset() -> RuleSet:
    return example_ruleset()


def _ruleset_no_catch_all() -> RuleSet:
    rs = example_ruleset()
    return RuleSet([r for r in rs.rules if r.match], rs.receivers, "no-catch-all")


def _candidate_ruleset() -> RuleSet:
    """A changed rule set to verify: the pager rule no longer continues."""
    rs = example_ruleset()
    rules = [Rule(r.name, r.match, r.receiver, False) if r.name == "critical-to-infra" else r for r in rs.rules]
    return RuleSet(rules, rs.receivers, "candidate")


# ------------------------------------------------------------------ shared inputs

class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._alerts = self._fp = self._table = None

    def alerts(self) -> DataFrame:
        if self._alerts is None:
            self._alerts = testdata.load_alerts(self.spark, self.sf_dir)
        return self._alerts

    def mutes(self) -> DataFrame:
        return testdata.load_mutes(self.spark, self.sf_dir)

    def fp_table(self) -> DataFrame:
        """Distinct label sets with fingerprints (materialised once)."""
        if self._table is None:
            self._table = fingerprint_table(self.alerts())
        return self._table

    def fp_alerts(self) -> DataFrame:
        if self._fp is None:
            self._fp = with_fingerprint(self.alerts(), table=self.fp_table())
        return self._fp

    def state_at_as_of(self) -> DataFrame:
        """Observed state at as_of: pushes up to as_of folded per label set,
        fingerprints attached from the label-set table."""
        pushes = self.alerts().where(F.col("observed_at") <= F.lit(AS_OF).cast("timestamp"))
        return observed.alert_state(pushes, label_sets=self.fp_table())


def _plan(inp: Inputs, with_mutes: bool) -> DataFrame:
    r = replay(inp.alerts(), _ruleset(), mutes=inp.mutes() if with_mutes else None,
               failing_receivers=EXAMPLE_FAILING_RECEIVERS)
    return r.plan


# ------------------------------------------------------------------ queries

def q_alert_fingerprints(spark, sf):
    """Alerts per label set: a hash count per fingerprint, labels taken from
    the (materialised, counted) label-set table."""
    inp = Inputs(spark, sf)
    counts = inp.fp_alerts().groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_alerts"))
    sets = inp.fp_table().select("fingerprint", format_labels(F.map_from_entries("_lkey")).alias("label_text"))
    return counts.join(sets, "fingerprint", "inner").select("fingerprint", "label_text", "n_alerts")


def q_route_decisions(spark, sf):
    d = routing.route(Inputs(spark, sf).alerts(), _ruleset())
    return d.select("alert_id", F.col("rule_idx").cast("int").alias("rule_idx"), "rule_name", "receiver")


def q_route_receivers(spark, sf):
    d = routing.with_receiver(routing.route(Inputs(spark, sf).alerts(), _ruleset()), _ruleset())
    return routing.routing_report(d, by=("rule_name", "receiver", "receiver_type"))


def q_unrouted_alerts(spark, sf):
    return routing.unrouted(Inputs(spark, sf).alerts(), _ruleset_no_catch_all()).select("alert_id")


def q_muted_alerts(spark, sf):
    inp = Inputs(spark, sf)
    return mute_ops.muted(inp.alerts(), inp.mutes()).select("alert_id")


def q_unmuted_alerts(spark, sf):
    inp = Inputs(spark, sf)
    return mute_ops.unmuted(inp.alerts(), inp.mutes()).select("alert_id")


def q_mute_attribution(spark, sf):
    inp = Inputs(spark, sf)
    return mute_ops.mute_pairs(inp.alerts(), inp.mutes()).select("alert_id", F.col("m_id").alias("mute_id"))


def q_loose_vs_strict(spark, sf):
    inp = Inputs(spark, sf)
    a, m = inp.alerts(), inp.mutes()
    loose = mute_ops.mute_pairs(a, m, mode="loose").groupBy("m_id").agg(F.count(F.lit(1)).alias("loose_pairs"))
    strict = mute_ops.mute_pairs(a, m, mode="strict").groupBy("m_id").agg(F.count(F.lit(1)).alias("strict_pairs"))
    return (loose.join(strict, "m_id", "left")
            .select(F.col("m_id").alias("mute_id"), "loose_pairs",
                    F.coalesce("strict_pairs", F.lit(0)).cast("long").alias("strict_pairs")))


def _plan_cols(p: DataFrame) -> DataFrame:
    return p.select("alert_id", "rule_name", "fingerprint", "desired", "deliver", "status")


def q_delivery_plan(spark, sf):
    inp = Inputs(spark, sf)
    r = replay(inp.alerts(), _ruleset(), failing_receivers=EXAMPLE_FAILING_RECEIVERS)
    return _plan_cols(r.plan)


def q_delivery_plan_seeded(spark, sf):
    """History up to as_of is folded into a notifications snapshot, which
    seeds the replay of the rest; equal to replaying everything at once."""
    inp = Inputs(spark, sf)
    cut = F.lit(AS_OF).cast("timestamp")
    a = inp.alerts()
    first = replay(a.where(F.col("observed_at") <= cut), _ruleset(), failing_receivers=EXAMPLE_FAILING_RECEIVERS)
    rest = replay(a.where(F.col("observed_at") > cut), _ruleset(), seed=first.notifications,
                  failing_receivers=EXAMPLE_FAILING_RECEIVERS)
    return _plan_cols(rest.plan)


def q_notification_snapshot(spark, sf):
    inp = Inputs(spark, sf)
    r = replay(inp.alerts(), _ruleset(), failing_receivers=EXAMPLE_FAILING_RECEIVERS)
    return r.notifications.select("rule_name", "fingerprint", ts_text("sent_at").alias("sent_at"), "status")


def _state_cols(s: DataFrame) -> DataFrame:
    return s.select("fingerprint", format_labels("labels").alias("label_text"),
                    ts_text("starts_at").alias("starts_at"), ts_text("ends_at").alias("ends_at"),
                    ts_text("first_seen_at").alias("first_seen_at"), ts_text("last_seen_at").alias("last_seen_at"))


def _state(inp: Inputs) -> DataFrame:
    return observed.alert_state(inp.alerts(), label_sets=inp.fp_table())


def q_alert_state(spark, sf):
    return _state_cols(_state(Inputs(spark, sf)))


def q_alert_state_retained(spark, sf):
    s = _state(Inputs(spark, sf))
    return _state_cols(observed.retain(s, AS_OF))


def _view_cols(v: DataFrame) -> DataFrame:
    return v.select("fingerprint", format_labels("labels").alias("label_text"),
                    ts_text("ends_at").alias("ends_at"), ts_text("last_seen_at").alias("last_seen_at"), "status")


def q_list_firing(spark, sf):
    return _view_cols(observed.list_alerts(Inputs(spark, sf).state_at_as_of(), AS_OF, "firing",
                                           limit=observed.PAGE_SIZE))


def q_list_firing_unmuted(spark, sf):
    inp = Inputs(spark, sf)
    return _view_cols(observed.list_alerts(inp.state_at_as_of(), AS_OF, "firing", exclude_muted=True,
                                           mutes=inp.mutes(), label_sets=inp.fp_table(), limit=observed.PAGE_SIZE))


def q_list_expired(spark, sf):
    return _view_cols(observed.list_alerts(Inputs(spark, sf).state_at_as_of(), AS_OF, "expired",
                                           limit=observed.PAGE_SIZE))


def q_get_alerts(spark, sf):
    """Look up every fingerprint pushed after as_of in the state at as_of."""
    inp = Inputs(spark, sf)
    keys = inp.fp_alerts().where(F.col("observed_at") > F.lit(AS_OF).cast("timestamp")).select("fingerprint").distinct()
    return observed.lookup_alerts(inp.state_at_as_of(), keys, AS_OF)


def q_matching_alerts(spark, sf):
    s = Inputs(spark, sf).state_at_as_of()
    return _view_cols(observed.matching_alerts(s, {"severity": "critical"}, AS_OF, "firing", limit=observed.PAGE_SIZE))


def q_mute_overview(spark, sf):
    inp = Inputs(spark, sf)
    ov = observed.mute_overview(inp.mutes(), inp.state_at_as_of(), AS_OF, "present", per_mute=observed.PAGE_SIZE)
    return ov.select("id", "status", "fingerprint", F.col("rank").cast("long").alias("rank"))


def q_list_mutes(spark, sf):
    m = mute_ops.list_mutes(Inputs(spark, sf).mutes(), "present", AS_OF)
    return m.select("id", format_matchers("matchers").alias("matcher_text"), ts_text("starts_at").alias("starts_at"),
                    ts_text("ends_at").alias("ends_at"), "status")


def q_list_mutes_expired(spark, sf):
    m = mute_ops.list_mutes(Inputs(spark, sf).mutes(), "expired", AS_OF)
    return m.select("id", ts_text("ends_at").alias("ends_at"), "status")


def q_mute_validation(spark, sf):
    """Mute requests taken from the derived mutes; every tenth has a blank
    comment, every seventh an end equal to its start."""
    m = Inputs(spark, sf).mutes()
    n = (F.regexp_extract("id", r"(\d+)", 1).cast("long") / testdata.MUTE_EVERY).cast("long")
    req = m.select(
        "id", "matchers", "starts_at",
        F.when(n % 7 == 3, F.col("starts_at")).otherwise(F.col("ends_at")).alias("ends_at"),
        F.when(n % 10 == 0, F.lit("   ")).otherwise(F.col("comment")).alias("comment"), "created_by")
    err = mute_ops.validation_error()
    return req.select("id", err["field"].alias("field"), err["message"].alias("message"))


def q_mute_expire(spark, sf):
    """End every mute active at as_of at as_of (K5) and list all mutes
    with their status afterwards."""
    m = Inputs(spark, sf).mutes()
    t = F.lit(AS_OF).cast("timestamp")
    exp = m.where((F.col("starts_at") <= t) & (t <= F.col("ends_at"))).select("id", t.alias("at"))
    new, _ = mute_ops.expire_mutes(m, exp)
    return new.select("id", ts_text("ends_at").alias("ends_at"),
                      mute_status("starts_at", "ends_at", AS_OF).alias("status"))


def q_mute_text_roundtrip(spark, sf):
    m = Inputs(spark, sf).mutes()
    txt = format_matchers("matchers")
    dur_ms = (F.unix_micros("ends_at") - F.unix_micros("starts_at")) / 1000
    dtext = format_duration(dur_ms)
    parsed = parse_matchers_text(txt)
    return m.select("id", txt.alias("matcher_text"),
                    F.coalesce(format_matchers(parsed["matchers"]) == txt, F.lit(False)).alias("roundtrip_ok"),
                    parsed["error"].alias("parse_error"),
                    dtext.alias("duration_text"), parse_duration_ms(dtext).alias("duration_ms"))


def _cases(inp: Inputs) -> DataFrame:
    """Every distinct alert label set (from the label-set table) as a case."""
    return inp.fp_table().select("fingerprint", F.map_from_entries("_lkey").alias("labels"))


def q_verify_cases(spark, sf):
    """Each distinct alert label set is a case whose expectation is what the
    example rule set decides; the candidate rule set is verified."""
    cases = _cases(Inputs(spark, sf))
    exp = rulesets._route_lists(cases, _ruleset()).select(
        F.col("fingerprint").alias("name"), "labels", F.col("got_rules").alias("expect_rules"),
        F.col("got_receivers").alias("expect_receivers"))
    res = rulesets.verify(exp, _candidate_ruleset())
    return res.select("name", "pass", F.array_join("mismatches", " | ").alias("mismatches"))


def q_verify_summary(spark, sf):
    cases = _cases(Inputs(spark, sf))
    exp = rulesets._route_lists(cases, _ruleset()).select(
        F.col("fingerprint").alias("name"), "labels", F.col("got_rules").alias("expect_rules"),
        F.col("got_receivers").alias("expect_receivers"))
    return rulesets.verify_summary(rulesets.verify(exp, _candidate_ruleset()))


def _flagged_sets(inp: Inputs) -> DataFrame:
    """Every label set ever pushed, with the mute check against the mutes active at as_of (loose)."""
    hit = mute_ops.muted_keys_at(inp.mutes(), AS_OF, inp.fp_table(), mode="loose")
    return _cases(inp).join(hit.withColumn("muted", F.lit(True)), "fingerprint", "left").fillna(False, ["muted"])


def q_explain_trace(spark, sf):
    """Trace of every label set."""
    tr = rulesets.explain(_flagged_sets(Inputs(spark, sf)), _ruleset(), muted_col="muted")
    return tr.select("fingerprint", "mute_check", "step", "rule_name", "verdict", "receiver", "action",
                     "receiver_type", "condition")


def q_final_decisions(spark, sf):
    """R21's closing lines of every label set, under rules without a catch-all (so that some are dropped)."""
    end = rulesets.final_decisions(_flagged_sets(Inputs(spark, sf)), _ruleset_no_catch_all(), muted_col="muted")
    return end.select("fingerprint", "outcome", F.size("decisions").alias("n_decisions"), "final")


def q_process_replay(spark, sf):
    return _plan_cols(_plan(Inputs(spark, sf), with_mutes=True))


def q_counters(spark, sf):
    inp = Inputs(spark, sf)
    return metrics.counters(inp.alerts(), _plan(inp, with_mutes=True))


def q_routing_report(spark, sf):
    return metrics.status_report(_plan(Inputs(spark, sf), with_mutes=True))


def q_webhook_payloads(spark, sf):
    inp = Inputs(spark, sf)
    p = _plan(inp, with_mutes=True).where("deliver")
    # the payload text is built, then read back once as a struct (a
    # round trip through the JSON the receiver gets)
    b = F.from_json(payload("observed_at"), PAYLOAD_READ_SCHEMA)
    a0 = F.get(b["alerts"], 0)
    return p.select(
        "alert_id", "rule_name", b["receiver"].alias("p_receiver"), b["status"].alias("p_status"),
        a0["fingerprint"].alias("p_fingerprint"), a0["startsAt"].alias("p_starts_at"),
        a0["endsAt"].alias("p_ends_at"), a0["labels"]["instance"].alias("p_instance"))


def q_decisions_with_history(spark, sf):
    """R12 + P4: each decision after as_of against the snapshot at as_of."""
    inp = Inputs(spark, sf)
    cut = F.lit(AS_OF).cast("timestamp")
    a = inp.alerts()
    first = replay(a.where(F.col("observed_at") <= cut), _ruleset(), failing_receivers=EXAMPLE_FAILING_RECEIVERS)
    dec = routed_decisions(a.where(F.col("observed_at") > cut), _ruleset())
    j = delivery.last_attempt(dec, first.notifications)
    from alertflow.functions.status import desired_status
    des = desired_status("ends_at", "observed_at")
    return j.select("alert_id", "rule_name", "prev_status",
                    delivery.already_delivered(F.col("prev_status"), des).alias("already_delivered"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "alert_fingerprints": q_alert_fingerprints,
    "route_decisions": q_route_decisions,
    "route_receivers": q_route_receivers,
    "unrouted_alerts": q_unrouted_alerts,
    "muted_alerts": q_muted_alerts,
    "unmuted_alerts": q_unmuted_alerts,
    "mute_attribution": q_mute_attribution,
    "loose_vs_strict": q_loose_vs_strict,
    "delivery_plan": q_delivery_plan,
    "delivery_plan_seeded": q_delivery_plan_seeded,
    "decisions_with_history": q_decisions_with_history,
    "notification_snapshot": q_notification_snapshot,
    "alert_state": q_alert_state,
    "alert_state_retained": q_alert_state_retained,
    "list_firing": q_list_firing,
    "list_firing_unmuted": q_list_firing_unmuted,
    "list_expired": q_list_expired,
    "get_alerts": q_get_alerts,
    "matching_alerts": q_matching_alerts,
    "mute_overview": q_mute_overview,
    "list_mutes": q_list_mutes,
    "list_mutes_expired": q_list_mutes_expired,
    "mute_validation": q_mute_validation,
    "mute_expire": q_mute_expire,
    "mute_text_roundtrip": q_mute_text_roundtrip,
    "verify_cases": q_verify_cases,
    "verify_summary": q_verify_summary,
    "explain_trace": q_explain_trace,
    "final_decisions": q_final_decisions,
    "process_replay": q_process_replay,
    "counters": q_counters,
    "routing_report": q_routing_report,
    "webhook_payloads": q_webhook_payloads,
}
