"""Rule-set analysis: validate (R17), lint (R18), verify (R19, R20) and
explain (R21).

Validation and lint run over ``rules``/``receivers`` DataFrames keyed by
``config_id``, so many candidate rule sets are checked in one job. Verify and
explain route case or alert label sets with the compiled rule set.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertflow.functions.labels import format_labels, same_multiset
from alertflow.operators.routing import rule_array, with_hits
from alertflow.sources.config import RuleSet

KNOWN_RECEIVER_TYPES = ("webhook",)


def validate_receivers(receivers: DataFrame) -> DataFrame:
    """Receiver violations: name required, duplicate (the later one is
    blamed), type required, URL required, unknown type; the first failing
    check per receiver, with its position as ``ord``."""
    w = Window.partitionBy("config_id", "name").orderBy("receiver_idx")
    r = receivers.withColumn("_dup", F.row_number().over(w) > 1)
    name = F.coalesce(F.col("name"), F.lit(""))
    typ = F.coalesce(F.col("type"), F.lit(""))
    url_file = F.coalesce(F.col("url_file"), F.lit("")) if "url_file" in receivers.columns else F.lit("")
    # fixed values: the messages and their order
    msg = (F.when(name == "", F.format_string("receiver #%d: name is required", F.col("receiver_idx") + 1))
           .when(F.col("_dup"), F.format_string('receiver "%s": duplicate name', name))
           .when(typ == "", F.format_string('receiver "%s": type is required', name))
           .when((typ == "webhook") & (F.coalesce(F.col("url"), F.lit("")) == "") & (url_file == ""),
                 F.format_string('receiver "%s": webhook receiver requires url or url_file', name))
           .when(~typ.isin(*KNOWN_RECEIVER_TYPES),
                 F.format_string('receiver "%s": unknown receiver type "%s" (only "webhook" is configurable)',
                                 name, typ)))
    return r.where(msg.isNotNull()).select("config_id", F.lit(0).alias("phase"),
                                           F.col("receiver_idx").cast("long").alias("ord"), msg.alias("message"))


def validate_rules(rules: DataFrame, receivers: DataFrame) -> DataFrame:
    """All rule and receiver violations, and the first error per
    config (receivers are loaded first, then rules in order)."""
    w = Window.partitionBy("config_id", "name").orderBy("rule_idx")
    known = receivers.select("config_id", F.col("name").alias("receiver"), F.lit(True).alias("_known")).distinct()
    r = (rules.withColumn("_dup", F.row_number().over(w) > 1)
         .join(known, ["config_id", "receiver"], "left"))
    name = F.coalesce(F.col("name"), F.lit(""))
    recv = F.coalesce(F.col("receiver"), F.lit(""))
    num = F.col("rule_idx") + 1
    # fixed values: the messages and their order
    msg = (F.when(name == "", F.format_string("rule #%d: name is required", num))
           .when(F.col("_dup"), F.format_string('rule #%d: duplicate name "%s"', num, name))
           .when(recv == "", F.format_string('rule "%s": receiver is required', name))
           .when(F.col("_known").isNull(),
                 F.format_string('rule "%s": references undefined receiver "%s"', name, recv)))
    rule_errs = r.where(msg.isNotNull()).select("config_id", F.lit(1).alias("phase"),
                                                F.col("rule_idx").cast("long").alias("ord"), msg.alias("message"))
    recv_errs = validate_receivers(receivers)
    return rule_errs.unionByName(recv_errs)


def first_errors(violations: DataFrame) -> DataFrame:
    """R17 verdict: the first error of each config (``min_by``)."""
    return violations.groupBy("config_id").agg(
        F.min_by("message", F.struct("phase", "ord")).alias("error"))


def lint_rules(rules: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Warnings per config: no rules; last rule not a catch-all; a
    non-continue catch-all before the end. ``configs(config_id)`` lists the
    rule sets to check, so an empty one is reported too."""
    n = F.count(F.lit(1)).over(Window.partitionBy("config_id"))
    r = rules.withColumn("_n", n)
    catch_all = F.coalesce(F.size("match"), F.lit(0)) <= 0
    last_not = r.where((F.col("rule_idx") == F.col("_n") - 1) & ~catch_all).select(
        "config_id", F.lit(1).alias("ord"),
        F.lit("warning: last rule is not a catch-all; alerts not matching any rule will be silently dropped")
        .alias("warning"))
    early = r.where(catch_all & ~F.col("continue") & (F.col("rule_idx") < F.col("_n") - 1)).select(
        "config_id", (F.col("rule_idx") + 2).alias("ord"),
        F.format_string('warning: rule #%d ("%s") is a non-continue catch-all in non-final position; '
                        'subsequent rules will never execute', F.col("rule_idx") + 1, F.col("name"))
        .alias("warning"))
    out = last_not.unionByName(early)
    if configs is not None:
        empty = configs.join(rules.select("config_id"), "config_id", "left_anti").select(
            "config_id", F.lit(0).alias("ord"),
            F.lit("warning: no rules defined; all alerts will be dropped").alias("warning"))
        out = empty.unionByName(out)
    return out


def _route_lists(df: DataFrame, ruleset: RuleSet, labels: str = "labels") -> DataFrame:
    rules = rule_array(ruleset)
    hits = with_hits(df, ruleset, labels)
    return (hits.withColumn("got_rules", F.transform("_hits", lambda i: F.element_at(rules, i + 1)["name"]))
            .withColumn("got_receivers", F.transform("_hits", lambda i: F.element_at(rules, i + 1)["receiver"]))
            .drop("_hits"))


def _go_list(c):
    return F.concat(F.lit("["), F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), " "),
                    F.lit("]"))


def verify(cases: DataFrame, ruleset: RuleSet) -> DataFrame:
    """PASS/FAIL per case with both mismatch messages; mutes and
    history are not consulted; a missing list is an empty list."""
    r = _route_lists(cases, ruleset)
    rules_ok = same_multiset("expect_rules", "got_rules")
    recv_ok = same_multiset("expect_receivers", "got_receivers")
    msgs = F.concat(
        F.when(~rules_ok, F.array(F.format_string("expected rules     %s, got %s", _go_list(F.col("expect_rules")),
                                                  _go_list(F.col("got_rules"))))).otherwise(F.array()),
        F.when(~recv_ok, F.array(F.format_string("expected receivers %s, got %s",
                                                 _go_list(F.col("expect_receivers")),
                                                 _go_list(F.col("got_receivers"))))).otherwise(F.array()))
    ok = rules_ok & recv_ok
    desc = F.col("description") if "description" in cases.columns else F.lit(None).cast("string")
    # the report block of one case: PASS/FAIL line, then (on failure) the
    # description and the mismatch lines, each indented by six spaces
    detail = F.concat(F.when(F.coalesce(desc, F.lit("")) != "", F.array(F.regexp_replace(desc, "\n$", "")))
                      .otherwise(F.array().cast("array<string>")), msgs.cast("array<string>"))
    report = F.when(ok, F.concat(F.lit("PASS  "), F.col("name"))).otherwise(
        F.concat_ws("\n", F.concat(F.lit("FAIL  "), F.col("name")),
                    F.transform(detail, lambda m: F.concat(F.lit("      "), m))))
    return r.select("name", desc.alias("description"), "got_rules", "got_receivers", ok.alias("pass"),
                    msgs.cast("array<string>").alias("mismatches"), report.alias("report"))


def verify_summary(results: DataFrame) -> DataFrame:
    """Passed, failed, total."""
    return results.agg(F.count_if(F.col("pass")).alias("passed"),
                       F.count_if(~F.col("pass")).alias("failed"),
                       F.count(F.lit(1)).alias("total"))


def explain(alerts: DataFrame, ruleset: RuleSet, muted_col: str | None = None,
            labels: str = "labels", key: str = "fingerprint") -> DataFrame:
    """The trace as rows ``(key, step, rule_name, verdict, receiver,
    action, condition)``; rules after the stop are not visited; a muted
    alert visits no rule; final decisions carry the receiver type or ``?``.

    ``muted_col`` names a boolean column from the mute lookup; without it the
    mute check is reported as skipped.
    """
    rules = rule_array(ruleset, [_cond_text(r.match) for r in ruleset.rules])
    mute_check = (F.when(F.col(muted_col), F.lit("MATCHED")).otherwise(F.lit("not matched"))
                  if muted_col else F.lit("skipped"))
    hits = F.col("_hits")
    # visited: everything up to the last decided rule if that one stops, else every rule
    last = F.try_element_at(hits, F.lit(-1))
    stopped = ~F.coalesce(F.try_element_at(rules, last + 1)["cont"], F.lit(True))
    stop = F.when(stopped, last).otherwise(F.lit(len(ruleset.rules)))
    base = with_hits(alerts, ruleset, labels).select(
        key, format_labels(labels).alias("label_text"), mute_check.alias("mute_check"), "_hits", stop.alias("_stop"))

    def step(rule, i):
        match = F.array_contains(hits, i)
        return F.struct(
            (i + 1).alias("step"), rule["name"].alias("rule_name"),
            F.when(match, F.lit("MATCH")).otherwise(F.lit("skip")).alias("verdict"),
            F.when(match, rule["receiver"]).alias("receiver"),
            F.when(match, F.when(rule["cont"], F.lit("continue")).otherwise(F.lit("stop"))).alias("action"),
            F.when(match, rule["receiver_type"]).alias("receiver_type"), rule["condition"].alias("condition"))

    visited = F.filter(F.transform(rules, step), lambda s: (s["step"] - 1) <= F.col("_stop"))
    out = base.select(key, "label_text", "mute_check",
                      F.explode_outer(F.when(F.col("mute_check") != "MATCHED", visited)).alias("s"))
    return out.select(key, "label_text", "mute_check", "s.*")


def final_decisions(alerts: DataFrame, ruleset: RuleSet, muted_col: str | None = None,
                    labels: str = "labels", key: str = "fingerprint") -> DataFrame:
    """The end of a trace, one row per alert: ``outcome`` (muted, dropped, delivered), the decided rules with their
    receivers, and the closing text (``none, alert would be dropped`` when no rule takes it)."""
    rules = rule_array(ruleset)
    muted = F.coalesce(F.col(muted_col), F.lit(False)) if muted_col else F.lit(False)
    base = with_hits(alerts, ruleset, labels).withColumn("_muted", muted)
    decided = F.transform(F.when(~F.col("_muted"), F.col("_hits")).otherwise(F.array().cast("array<int>")),
                          lambda i: F.struct(F.element_at(rules, i + 1)["name"].alias("rule_name"),
                                             F.element_at(rules, i + 1)["receiver"].alias("receiver"),
                                             F.element_at(rules, i + 1)["receiver_type"].alias("receiver_type")))
    outcome = (F.when(F.col("_muted"), "muted").when(F.size("_hits") == 0, "dropped").otherwise("delivered"))
    text = F.when(outcome == "dropped", F.lit("none, alert would be dropped")).when(
        outcome == "delivered", F.array_join(F.transform("decisions", lambda d: F.concat(
            d["rule_name"], F.lit(" -> "), d["receiver"], F.lit(" ("), d["receiver_type"], F.lit(")"))), ", "))
    return (base.withColumn("decisions", decided)
            .select(key, outcome.alias("outcome"), "decisions", text.alias("final")))


_LETTER = {7: "\\a", 8: "\\b", 12: "\\f", 10: "\\n", 13: "\\r", 9: "\\t", 11: "\\v"}


def _quote(v: str) -> str:
    """Go's %q for a driver-side string (same rules as ``format_labels``)."""
    out = []
    for ch in v:
        cp = ord(ch)
        if ch in ('"', "\\"):
            out.append("\\" + ch)
        elif ch == " " or unicodedata.category(ch)[0] in "LMNPS":
            out.append(ch)
        elif cp in _LETTER:
            out.append(_LETTER[cp])
        elif cp < 32 or cp == 127:
            out.append(f"\\x{cp:02x}")
        elif cp < 65536:
            out.append(f"\\u{cp:04x}")
        else:
            out.append(f"\\U{cp:08x}")
    return '"' + "".join(out) + '"'


def _cond_text(match: dict) -> str:
    if not match:
        return "(catch-all)"
    keys = sorted(match, key=lambda k: k.encode("utf-8"))
    return ", ".join(f"{k}={_quote(match[k])}" for k in keys)
