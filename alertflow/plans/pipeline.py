"""The Process pipeline as one batch plan (R25, batch form).

observe -> fingerprint -> mute (loose, at each alert's own time) -> route ->
receiver -> de-duplicate (R13) -> attempts / notifications / outbox.

What a label set decides is worked out once per distinct label set, not per
alert: its fingerprint, the rules that take it and the merged intervals in which
it is muted. That table is checkpointed, and one join by label set (broadcast
only under a bound of its measured bytes) brings all three to the alerts, which
are read once. Its row counts bound the rows of every (rule, fingerprint), so hot
keys and seeds are found without evaluating the routed alerts a second time.

Shuffles: the distinct label sets (map-side partial distinct) and one by ``(rule,
fingerprint)`` for the state machine (two more, narrow, for hot keys only).
Nothing is checkpointed in full width: columns that a query does not ask for are
pruned down to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertflow.functions.labels import fingerprint_table, label_set_rows, side_bytes, with_fingerprint
from alertflow.session import materialize
from alertflow.operators import delivery, routing
from alertflow.operators.mutes import in_intervals, mute_intervals, unmuted
from alertflow.sources.config import RuleSet


@dataclass
class ReplayResult:
    plan: DataFrame          # every decision with desired / deliver / status
    attempts: DataFrame      # delivered rows (K3)
    notifications: DataFrame  # last attempt per key (R14)


def failing_outcome(ok_col: str, failing_receivers=()) -> Column:
    """Simulated call outcome: the push's own flag, and never for a receiver
    known to fail."""
    c = F.col(ok_col)
    if failing_receivers:
        c = c & ~F.col("receiver").isin(list(failing_receivers))
    return c


@dataclass
class DecisionTable:
    """What each distinct label set decides, checkpointed: ``_lkey, fingerprint, _n, _hits`` and, with mutes, ``_mi``."""
    rows: DataFrame
    muted: bool
    n_bytes: int     # its measured size
    most: int        # rows of its most frequent label set


def decision_table(alerts: DataFrame, ruleset: RuleSet, mutes: DataFrame | None = None,
                   label_sets: DataFrame | None = None) -> DecisionTable:
    """The label sets of ``alerts`` (or the given fingerprint table) with the decided rule indexes ``_hits`` and the
    merged intervals ``_mi`` in which mutes match them."""
    sets = label_sets
    if sets is None:  # the mute join reads the label sets more than once
        sets = label_set_rows(alerts) if mutes is None else fingerprint_table(alerts)
    rows = routing.with_hits(sets.withColumn("labels", F.map_from_entries("_lkey")), ruleset).drop("labels")
    if mutes is not None:
        rows = rows.join(mute_intervals(mutes, sets), "fingerprint", "left")
    rows = materialize(rows)
    size = rows.agg(side_bytes(rows.columns).alias("n_bytes"), F.max("_n").alias("most")).first()
    return DecisionTable(rows, mutes is not None, size.n_bytes, size.most or 0)


def decision_keys(table: DecisionTable, ruleset: RuleSet) -> DataFrame:
    """The (rule_name, fingerprint) of a decision table with an upper bound ``_n`` of their rows."""
    return routing.route_hits(table.rows.select("fingerprint", "_n", "_hits"), ruleset).select("rule_name", "fingerprint", "_n")


def routed_decisions(alerts: DataFrame, ruleset: RuleSet, mutes: DataFrame | None = None,
                     fingerprinted: bool = False, label_sets: DataFrame | None = None,
                     table: DecisionTable | None = None) -> DataFrame:
    """Unmuted alerts routed to known receivers, with fingerprints. ``table``
    is their :func:`decision_table` if there is one; alerts that already carry
    a fingerprint are matched and routed by themselves."""
    if fingerprinted:
        a = alerts if mutes is None else unmuted(alerts, mutes, label_sets=label_sets)
        dec = routing.route(a, ruleset)
    else:
        if table is None:
            table = decision_table(alerts, ruleset, mutes, label_sets)
        carry = ("_hits", "_mi") if table.muted else ("_hits",)
        a = with_fingerprint(alerts, table=table.rows, carry=carry, table_bytes=table.n_bytes)
        if table.muted:
            a = a.where(~in_intervals("_mi", "observed_at")).drop("_mi")
        dec = routing.route_hits(a, ruleset)
    return routing.known_receiver_decisions(dec, ruleset)


def replay(alerts: DataFrame, ruleset: RuleSet, mutes: DataFrame | None = None,
           seed: DataFrame | None = None, ok: Column | str = "call_ok",
           failing_receivers=(), chunk_seconds: int | None = None,
           fingerprinted: bool = False, checkpoint_decisions: bool = False,
           label_sets: DataFrame | None = None, table: DecisionTable | None = None) -> ReplayResult:
    """What would this rule set have sent for this alert history?

    The routed decisions are evaluated once. ``checkpoint_decisions`` writes
    them first, for callers that evaluate several results of one replay;
    ``table`` is the alerts' :func:`decision_table` if the caller has it.
    """
    keys = None
    if not fingerprinted:
        table = table or decision_table(alerts, ruleset, mutes, label_sets)
        keys = decision_keys(table, ruleset)
    dec = routed_decisions(alerts, ruleset, mutes, fingerprinted=fingerprinted, label_sets=label_sets, table=table)
    if checkpoint_decisions:
        dec = materialize(dec)
    okc = failing_outcome(ok, failing_receivers) if isinstance(ok, str) else ok
    plan = delivery.delivery_plan(dec, ok=okc, seed=seed, chunk_seconds=chunk_seconds, keys=keys,
                                  most_rows=table.most if table else None)
    att = delivery.attempts(plan)
    return ReplayResult(plan, att, delivery.notification_snapshot(att))
