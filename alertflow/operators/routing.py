"""Routing: ordered first match with ``continue``.

What a rule set decides for a label set is a set of rule indexes: the matching
rules in order, up to the first one without ``continue``. Routing, unrouted
alerts, verify and explain all read it, so they agree at every rule count. It
comes in two exact forms:

* up to ``COMPILED_MAX_RULES`` rules: a bit mask in one long. Each rule sets its
  bit, the lowest bit of a rule without ``continue`` cuts off all higher ones:
  plain arithmetic inside generated code, linear in the rules, map-side only;
* beyond: the distinct label sets are matched against the rules by the
  condition equi join (``operators.matching``) and joined back by label set.

A replay evaluates either form once per distinct label set and brings the
decided indexes along with the fingerprint (``plans.pipeline``).
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertflow.functions.labels import literal_match_all, sorted_entries
from alertflow.operators.matching import condition_pairs
from alertflow.sources.config import RuleSet

# Beyond this many rules the label-set join is cheaper than one expression per
# rule and row; both forms give the same array (tested against each other).
COMPILED_MAX_RULES = 32

_RULE_STRUCT = "array<struct<name:string,receiver:string,cont:boolean,receiver_type:string,condition:string>>"


def rule_array(ruleset: RuleSet, conditions: list | None = None) -> Column:
    """The rules as one constant array (folded once by the optimizer, whatever their number)."""
    rtype = {r.name: r.type for r in ruleset.receivers}
    rows = [{"name": r.name, "receiver": r.receiver, "cont": bool(r.cont), "receiver_type": rtype.get(r.receiver, "?"),
             "condition": conditions[i] if conditions else None} for i, r in enumerate(ruleset.rules)]
    return F.from_json(F.lit(json.dumps(rows)), _RULE_STRUCT)


def _hit_mask(ruleset: RuleSet, labels: str) -> Column:
    """Bit i: rule i is decided (it matches, and no earlier matching rule stops)."""
    bits = [F.when(literal_match_all(r.match, labels), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
            for i, r in enumerate(ruleset.rules)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits, F.lit(0).cast("long"))


def _with_mask(df: DataFrame, ruleset: RuleSet, labels: str) -> DataFrame:
    """``df`` with the cut mask ``_mask``."""
    terminal = F.lit(sum(1 << i for i, r in enumerate(ruleset.rules) if not r.cont)).cast("long")
    last = F.col("_all").bitwiseAND(terminal)
    lowest = last.bitwiseAND(-last)
    cut = F.when(last == 0, F.col("_all")).otherwise(F.col("_all").bitwiseAND(lowest * 2 - 1))
    return df.withColumn("_all", _hit_mask(ruleset, labels)).withColumn("_mask", cut).drop("_all")


def _mask_indexes(ruleset: RuleSet) -> Column:
    """The rule indexes in ``_mask``, with NULL for the others."""
    return F.array(*[F.when(F.col("_mask").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(i))
                     for i in range(len(ruleset.rules))]).cast("array<int>")


def _compiled(ruleset: RuleSet, compiled_max: int | None) -> bool:
    most = COMPILED_MAX_RULES if compiled_max is None else compiled_max
    return len(ruleset.rules) <= min(most, 62)


def with_hits(df: DataFrame, ruleset: RuleSet, labels: str = "labels", out: str = "_hits",
              compiled_max: int | None = None) -> DataFrame:
    """``df`` with the array of decided rule indexes in rule order (empty if no rule matches)."""
    if _compiled(ruleset, compiled_max):
        return _with_mask(df, ruleset, labels).withColumn(out, F.array_compact(_mask_indexes(ruleset))).drop("_mask")
    rules = ruleset.rules_df(df.sparkSession).select("rule_idx", F.col("match").alias("_match"), "continue")
    keyed = df.withColumn("_lk", sorted_entries(labels))
    sets = keyed.select("_lk").distinct().withColumn("_lset", F.map_from_entries("_lk"))
    pairs = condition_pairs(sets, rules, labels="_lset", matchers="_match", mode="loose")
    # first terminal hit and all hits of a label set; at most one entry per rule
    found = pairs.groupBy("_lk").agg(F.array_sort(F.collect_list("rule_idx")).alias("_all"),
                                     F.min(F.when(~F.col("continue"), F.col("rule_idx"))).alias("_stop"))
    stop = F.coalesce(F.col("_stop"), F.lit(len(ruleset.rules)))
    decided = found.select("_lk", F.filter("_all", lambda i: i <= stop).alias(out))
    none = F.array().cast("array<int>")
    return (keyed.join(decided, "_lk", "left").withColumn(out, F.coalesce(out, none)).drop("_lk")
            .select(*df.columns, out))


def route(alerts: DataFrame, ruleset: RuleSet, labels: str = "labels", compiled_max: int | None = None) -> DataFrame:
    """R1 + R24: decision rows ``alert columns + rule_idx, rule_name,
    receiver, continue`` in rule order per alert (0..n rows per alert)."""
    if _compiled(ruleset, compiled_max):
        masked = _with_mask(alerts, ruleset, labels)
        dec = masked.select(*alerts.columns, F.explode(_mask_indexes(ruleset)).alias("rule_idx")).where("rule_idx IS NOT NULL")
        return _named(dec, alerts.columns, ruleset)
    return route_hits(with_hits(alerts, ruleset, labels, compiled_max=compiled_max), ruleset)


def route_hits(hits: DataFrame, ruleset: RuleSet, col: str = "_hits") -> DataFrame:
    """Decision rows of rows that already carry their decided rule indexes."""
    cols = [c for c in hits.columns if c != col]
    return _named(hits.select(*cols, F.explode(col).alias("rule_idx")), cols, ruleset)


def _named(dec: DataFrame, cols: list[str], ruleset: RuleSet) -> DataFrame:
    rule = F.element_at(rule_array(ruleset), F.col("rule_idx") + 1)
    return dec.select(*cols, "rule_idx", rule["name"].alias("rule_name"), rule["receiver"].alias("receiver"),
                      rule["cont"].alias("continue"))


def route_join(alerts: DataFrame, ruleset: RuleSet, labels: str = "labels") -> DataFrame:
    """R1 by the label-set join at any rule count."""
    return route(alerts, ruleset, labels, compiled_max=-1)


def unrouted(alerts: DataFrame, ruleset: RuleSet, labels: str = "labels", compiled_max: int | None = None) -> DataFrame:
    """R2: alerts that no rule takes (they would be dropped)."""
    return with_hits(alerts, ruleset, labels, compiled_max=compiled_max).where(F.size("_hits") == 0).drop("_hits")


def with_receiver(decisions: DataFrame, ruleset: RuleSet) -> DataFrame:
    """Attach receiver type and URL from the (small, driver-side)
    receiver table as literal map lookups; unknown receivers get NULL."""
    recv = ruleset.receivers
    if recv:
        types = F.create_map(*[x for r in recv for x in (F.lit(r.name), F.lit(r.type))])
        urls = F.create_map(*[x for r in recv for x in (F.lit(r.name), F.lit(r.url))])
        rtype, rurl = types[F.col("receiver")], urls[F.col("receiver")]
    else:
        rtype = rurl = F.lit(None).cast("string")
    return decisions.withColumn("receiver_type", rtype).withColumn("receiver_url", rurl)


def known_receiver_decisions(decisions: DataFrame, ruleset: RuleSet) -> DataFrame:
    """R15 skip: a decision whose receiver is unknown is dropped (only that
    decision)."""
    return with_receiver(decisions, ruleset).where(F.col("receiver_type").isNotNull())


def unknown_receiver_warnings(decisions: DataFrame, ruleset: RuleSet) -> DataFrame:
    """R15 warnings: one row per skipped decision."""
    return (with_receiver(decisions, ruleset).where(F.col("receiver_type").isNull())
            .select("rule_name", "receiver",
                    F.lit("rule references unknown receiver").alias("warning")))


def routing_report(decisions: DataFrame, by=("rule_name", "receiver")) -> DataFrame:
    """Decisions per rule and receiver (partial aggregation)."""
    return decisions.groupBy(*by).agg(F.count(F.lit(1)).alias("decisions"))
