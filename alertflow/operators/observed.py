"""Observed alert state and its listings.

The reference upserts every push by fingerprint. Over a log of pushes the
upsert is a fold: keep the first ``starts_at`` and ``first_seen_at``, take
labels, ``ends_at`` and ``last_seen_at`` from the last push in processing
order ``(observed_at, seq)``. ``max_by``/``min_by`` over a fixed-width order
key hash-aggregate with partial aggregation, so a hot fingerprint is
pre-reduced map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertflow.functions.labels import present_value, sorted_entries
from alertflow.functions.status import ORDER_KEY_MIN, as_time, observed_status, order_key
from alertflow.operators.mutes import exclude_muted_at, filter_mutes, mute_view

# Fixed value: the page size of the listings over HTTP. Functions here return every row unless a limit is passed.
PAGE_SIZE = 100
VIEW_COLUMNS = ["fingerprint", "labels", "starts_at", "ends_at", "first_seen_at", "last_seen_at"]


def alert_state(pushes: DataFrame, seed: DataFrame | None = None,
                order: tuple = ("observed_at", "seq"), label_sets: DataFrame | None = None) -> DataFrame:
    """One row per fingerprint (schema ``schemas.ALERT_STATE``).

    ``pushes`` needs ``fingerprint, labels, starts_at, ends_at`` and the
    order columns. ``seed`` is an earlier snapshot; its row sorts before all
    pushes of its key, so first values come from it.

    The pushes go through a hash aggregate per (fingerprint, label set):
    every buffer is fixed width (timestamps and the decimal order key), with
    map-side partial aggregation. A second aggregate per fingerprint over
    those few rows picks the labels of the newest push (labels are a function
    of the fingerprint, so this is one row per key unless two label sets
    share a fingerprint).

    Pushes without a ``fingerprint`` column need ``label_sets`` (the
    fingerprint table): the first level then groups by label set alone and
    the fingerprint is attached to its (few) result rows, so no per-push
    fingerprint join runs.
    """
    fp = F.col("fingerprint") if "fingerprint" in pushes.columns else F.lit(None).cast("string")
    p = pushes.select(
        fp.alias("fingerprint"), sorted_entries("labels").alias("_lkey"), "starts_at", "ends_at",
        F.col(order[0]).alias("seen_at"), F.col(order[0]).alias("_first"),
        order_key(order[0], order[1]).alias("_ord"))
    if seed is not None:
        s = seed.select(
            "fingerprint", sorted_entries("labels").alias("_lkey"), "starts_at", "ends_at",
            F.col("last_seen_at").alias("seen_at"), F.col("first_seen_at").alias("_first"),
            F.lit(ORDER_KEY_MIN).cast("decimal(38,0)").alias("_ord"))
        p = p.unionByName(s)
    g = p.groupBy("fingerprint", "_lkey").agg(
        F.max_by("ends_at", "_ord").alias("ends_at"), F.max_by("seen_at", "_ord").alias("seen_at"),
        F.max("_ord").alias("_omax"),
        F.min_by("starts_at", "_ord").alias("starts_at"), F.min_by("_first", "_ord").alias("_first"),
        F.min("_ord").alias("_omin"))
    if "fingerprint" not in pushes.columns:
        if label_sets is None:
            raise ValueError("pushes without fingerprints need the label_sets table")
        g = g.drop("fingerprint").join(label_sets.select("_lkey", "fingerprint"), "_lkey", "inner")
    last = F.max_by(F.struct("_lkey", "ends_at", "seen_at"), "_omax")
    first = F.min_by(F.struct("starts_at", "_first"), "_omin")
    return (g.groupBy("fingerprint").agg(last.alias("_l"), first.alias("_f"))
            .select("fingerprint", F.map_from_entries("_l._lkey").alias("labels"),
                    F.col("_f.starts_at").alias("starts_at"), F.col("_l.ends_at").alias("ends_at"),
                    F.col("_f._first").alias("first_seen_at"), F.col("_l.seen_at").alias("last_seen_at")))


def alert_state_single(pushes: DataFrame, order: tuple = ("observed_at", "seq")) -> DataFrame:
    """R11 as one aggregate per fingerprint (the streaming form, T2: a
    stream allows one stateful aggregation, kept in the state store)."""
    ordk = order_key(order[0], order[1])
    last = F.max_by(F.struct("labels", "ends_at", F.col(order[0]).alias("seen_at")), ordk)
    return (pushes.groupBy("fingerprint")
            .agg(last.alias("_l"), F.min_by("starts_at", ordk).alias("starts_at"),
                 F.min_by(order[0], ordk).alias("first_seen_at"))
            .select("fingerprint", F.col("_l.labels").alias("labels"), "starts_at",
                    F.col("_l.ends_at").alias("ends_at"), "first_seen_at",
                    F.col("_l.seen_at").alias("last_seen_at")))


def alert_view(state: DataFrame, as_of) -> DataFrame:
    """P3 + F7: the listed columns with the derived status."""
    return state.select(*VIEW_COLUMNS, observed_status("ends_at", as_of).alias("status"))


def filter_status(state: DataFrame, status: str, as_of) -> DataFrame:
    """Firing (``ends_at IS NULL OR ends_at > t``), expired, or all."""
    t = as_time(as_of)
    e = F.col("ends_at")
    if status == "firing":
        return state.where(e.isNull() | (e > t))
    if status == "expired":
        return state.where(e.isNotNull() & (e <= t))
    if status in ("", "all", None):
        return state
    raise ValueError(f"unknown alert status filter {status!r}")


def _limited(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None else df.limit(n)


def list_alerts(state: DataFrame, as_of, status: str = "firing", exclude_muted: bool = False,
                mutes: DataFrame | None = None, limit: int | None = None,
                label_sets: DataFrame | None = None) -> DataFrame:
    """Status filter, optional strict exclusion by mutes active at
    ``as_of`` (R5a), newest ``last_seen_at`` first; all rows, or the first
    ``limit``. ``fingerprint`` breaks ties; with a limit the plan is a
    TakeOrderedAndProject.
    ``label_sets`` (the fingerprint table) lets the mute check run on the
    distinct label sets instead of a second evaluation of ``state``."""
    s = filter_status(state, status, as_of)
    if exclude_muted:
        if mutes is None:
            raise ValueError("exclude_muted needs the mutes table")
        s = exclude_muted_at(s, mutes, as_of, label_sets=label_sets)
    return _limited(alert_view(s, as_of).orderBy(F.col("last_seen_at").desc(), F.col("fingerprint")), limit)


def get_alerts(state: DataFrame, keys: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """R6 in batch form: look up ``keys(fingerprint)``; missing keys come
    back by anti join with the reference's error text."""
    found = alert_view(state.join(keys, "fingerprint", "left_semi"), as_of)
    missing = keys.join(state.select("fingerprint"), "fingerprint", "left_anti").withColumn(
        "error", F.format_string('alert "%s" not found', F.col("fingerprint")))
    return found, missing


def lookup_alerts(state: DataFrame, keys: DataFrame, as_of) -> DataFrame:
    """R6 as one left join: every key with ``found``, its status, and the
    reference's error text when missing (the state is evaluated once)."""
    v = alert_view(state, as_of).select("fingerprint", "status", F.lit(True).alias("_hit"))
    j = keys.select("fingerprint").join(v, "fingerprint", "left")
    found = F.coalesce(F.col("_hit"), F.lit(False))
    return j.select("fingerprint", found.alias("found"), "status",
                    F.when(~found, F.format_string('alert "%s" not found', F.col("fingerprint"))).alias("error"))


def matching_alerts(state: DataFrame, matchers: dict, as_of, status: str = "firing",
                    limit: int | None = None) -> DataFrame:
    """Alerts containing the matcher map (strict F2), by status, newest
    first; all rows, or the first ``limit``. Literal matchers compile to a pushed-down-friendly
    conjunction; an empty map matches every alert."""
    cond = F.lit(True)
    for k in sorted(matchers):
        cond = cond & F.coalesce(present_value("labels", F.lit(k)) == F.lit(matchers[k] or ""), F.lit(False))
    s = filter_status(state.where(cond), status, as_of)
    return _limited(alert_view(s, as_of).orderBy(F.col("last_seen_at").desc(), F.col("fingerprint")), limit)


def mute_overview(mutes: DataFrame, state: DataFrame, as_of, mute_status_filter: str = "present",
                  per_mute: int | None = None) -> DataFrame:
    """Every mute of the chosen status with its firing matching alerts (all, or
    at most ``per_mute``) (strict F2), newest first. One join and one
    ``row_number`` replace the reference's query per mute. Expired mutes get
    no match side, as in the reference."""
    from alertflow.operators.matching import condition_pairs

    mv = mute_view(filter_mutes(mutes, mute_status_filter, as_of), as_of)
    live = mv.where(F.col("status") != "expired").select(
        F.col("id").alias("m_id"), F.col("matchers").alias("m_matchers"))
    firing = filter_status(state, "firing", as_of).select("fingerprint", "labels", "last_seen_at")
    pairs = condition_pairs(firing, live, matchers="m_matchers", mode="strict")
    w = Window.partitionBy("m_id").orderBy(F.col("last_seen_at").desc(), F.col("fingerprint"))
    ranked = pairs.withColumn("rank", F.row_number().over(w))
    if per_mute is not None:
        ranked = ranked.where(F.col("rank") <= per_mute)
    top = (ranked
           .select(F.col("m_id").alias("id"), "fingerprint", "last_seen_at", "rank"))
    return mv.join(top, "id", "left")


def retain(state: DataFrame, cutoff) -> DataFrame:
    """Retention cut, written as a new snapshot by the caller."""
    return state.where(F.col("last_seen_at") >= as_time(cutoff))

