"""Mutes: lookup, attribution, listing, validation, create and expire
(R3, R4, R5a, R9, R10, R16, K4, K5, P2).

Attribution (which mutes hit which alerts) is an interval + label-condition join
done in equi joins: the label condition is matched once per distinct label set
(the condition join of ``operators.matching``), and the time condition per alert.
A (label set, mute) pair of up to ``MAX_BUCKETS`` time buckets is cut into them
and meets the alerts of the same label set and bucket; a longer one (mute until
the far future) stays one row and meets the alerts of its label set. The exact
closed interval check is the residual of both. No nested loop, no row per day of
a mute's life, and no broadcast of a mute table whose size grows with the data
(Spark broadcasts only what its size estimate allows).

The lookup (is any mute active?) needs less: the intervals of all mutes that
match a label set are merged into disjoint ones, and these become one sorted
array per label set, in chunks of about the square root of their number. One
join by label set then reads the alerts once and never multiplies them; the time
check looks at the chunks' ends and into at most one chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertflow.functions.labels import broadcast_if_small, sorted_entries
from alertflow.functions.status import as_time, is_blank, mute_active, mute_id, mute_status, zero_time_to_null
from alertflow.operators.matching import condition_pairs
from alertflow.session import materialize

DEFAULT_BUCKET_SECONDS = 86400
MAX_BUCKETS = 16  # a pair that covers more is not cut into buckets


def _prefixed(mutes: DataFrame) -> DataFrame:
    return mutes.select(*[F.col(c).alias(f"m_{c}") for c in mutes.columns])


def _bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000))


def _set_pairs(alerts: DataFrame, mutes: DataFrame, mode: str, labels: str, force: str | None,
               label_sets: DataFrame | None, set_key: str) -> tuple[DataFrame, DataFrame]:
    """Alerts with the key ``_lk`` of their label set, and one row per (label set, matching mute)."""
    m = _prefixed(mutes).where(F.col("m_ends_at") >= F.col("m_starts_at"))
    if label_sets is not None:
        a = alerts.withColumn("_lk", F.col(set_key))
        sets = label_sets.select(F.col(set_key).alias("_lk"), F.map_from_entries("_lkey").alias("_lset"))
    else:
        a = alerts.withColumn("_lk", sorted_entries(labels))
        sets = a.select("_lk").distinct().withColumn("_lset", F.map_from_entries("_lk"))
    return a, condition_pairs(sets, m, labels="_lset", matchers="m_matchers", mode=mode, force=force).drop("_lset")


def _keyed_sides(alerts: DataFrame, mutes: DataFrame, mode: str, time_col: str, bucket_seconds: int,
                 labels: str, force: str | None, label_sets: DataFrame | None, set_key: str):
    """Alerts keyed by label set and bucket, and the matching (label set,
    mute) rows: the short ones per bucket, the long ones once."""
    a, lm = _set_pairs(alerts, mutes, mode, labels, force, label_sets, set_key)
    first, last = _bucket(F.col("m_starts_at"), bucket_seconds), _bucket(F.col("m_ends_at"), bucket_seconds)
    is_short = last - first < MAX_BUCKETS
    short = lm.where(is_short).withColumn("_bucket", F.explode(F.sequence(first, last)))
    long = lm.where(~is_short).withColumn("_bucket", F.lit(None).cast("long"))
    a = a.withColumn("_bucket", _bucket(F.col(time_col), bucket_seconds))
    return a, short, long


def _interval_join(a: DataFrame, lm: DataFrame, time_col: str, by_bucket: bool) -> DataFrame:
    al, ml = a.alias("_a"), lm.alias("_m")
    t = F.col(f"_a.{time_col}")
    cond = ((F.col("_a._lk") == F.col("_m._lk"))
            & (F.col("_m.m_starts_at") <= t) & (t <= F.col("_m.m_ends_at")))
    if by_bucket:
        cond = cond & (F.col("_a._bucket") == F.col("_m._bucket"))
    return al.join(ml, cond, "inner").select(
        *[F.col(f"_a.{c}") for c in a.columns if c not in ("_lk", "_bucket")],
        *[F.col(f"_m.{c}") for c in lm.columns if c not in ("_lk", "_bucket")])


def mute_pairs(alerts: DataFrame, mutes: DataFrame, mode: str = "loose", time_col: str = "observed_at",
               bucket_seconds: int = DEFAULT_BUCKET_SECONDS, labels: str = "labels",
               force: str | None = None, label_sets: DataFrame | None = None,
               set_key: str = "fingerprint") -> DataFrame:
    """One row per (alert, mute) where the mute is active at the alert's
    own time and its matchers match (loose F1 by default).

    Matching depends only on the label set, so it runs on the distinct label
    sets (a map-side partial distinct of the alerts): label set x mute pairs
    come from the condition join; short ones are cut into time buckets and
    joined on ``(label set, bucket)``, long ones on the label set, both with
    the exact closed-interval check as residual. The alert table is neither
    exploded nor broadcast.

    ``label_sets`` is an existing table of the distinct label sets
    (``fingerprint_table``: ``_lkey`` plus ``set_key``); with it the alerts
    join on their ``set_key`` column and are not scanned a second time.
    """
    a, short, long = _keyed_sides(alerts, mutes, mode, time_col, bucket_seconds, labels, force, label_sets, set_key)
    return _interval_join(a, short, time_col, True).unionByName(_interval_join(a, long, time_col, False))


def active_mute_pairs(alerts: DataFrame, mutes: DataFrame, as_of, mode: str = "strict",
                      labels: str = "labels", force: str | None = None) -> DataFrame:
    """Pairs against the mutes active at one instant (listing queries)."""
    m = _prefixed(mutes).where(mute_active("m_starts_at", "m_ends_at", as_of))
    return condition_pairs(alerts, m, labels=labels, matchers="m_matchers", mode=mode, force=force)


def merged_intervals(pairs: DataFrame, key: str = "_lk", starts_at: str = "m_starts_at", ends_at: str = "m_ends_at",
                     out: str = "_mi") -> DataFrame:
    """Per ``key`` the union of its closed intervals as disjoint ones (microseconds), sorted, in chunks: ``key, out``
    with ``out`` an array of ``struct(s, e, list)`` and ``list`` an array of ``struct(s, e)``."""
    iv = pairs.select(F.col(key), F.unix_micros(starts_at).alias("_s"), F.unix_micros(ends_at).alias("_e")).where("_s <= _e")
    w = Window.partitionBy(key).orderBy("_s", "_e")
    reach = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(reach >= F.col("_s"), F.lit(0)).otherwise(F.lit(1))
    groups = iv.withColumn("_new", apart).withColumn("_g", F.sum("_new").over(w))
    disjoint = groups.groupBy(key, "_g").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    lists = disjoint.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_e").alias("e")))).alias("_all"))
    size = F.ceil(F.sqrt(F.size("_all"))).cast("int")
    parts = F.transform(F.sequence(F.lit(1), F.size("_all"), F.col("_size")), lambda at: F.slice("_all", at, F.col("_size")))
    chunk = F.transform("_parts", lambda p: F.struct(p[0]["s"].alias("s"), F.element_at(p, -1)["e"].alias("e"), p.alias("list")))
    return lists.withColumn("_size", size).withColumn("_parts", parts).select(key, chunk.alias(out))


def in_intervals(chunks: str, time_col: str) -> Column:
    """Does the time lie in one of :func:`merged_intervals`? False without intervals or time."""
    t = F.unix_micros(F.col(time_col))

    def holds(x: Column) -> Column:
        return (x["s"] <= t) & (t <= x["e"])

    return F.coalesce(F.exists(chunks, lambda c: holds(c) & F.exists(c["list"], holds)), F.lit(False))


def mute_intervals(mutes: DataFrame, label_sets: DataFrame, mode: str = "loose", set_key: str = "fingerprint",
                   force: str | None = None, out: str = "_mi") -> DataFrame:
    """``set_key, out``: when each label set of ``label_sets`` (``_lkey`` plus ``set_key``) is muted; label sets that
    no mute matches have no row."""
    sets = label_sets.select(set_key, "_lkey")
    _, pairs = _set_pairs(sets, mutes, mode, "labels", force, label_sets, set_key)
    return merged_intervals(pairs.withColumnRenamed("_lk", set_key), set_key, out=out)


def _lookup(alerts: DataFrame, mutes: DataFrame, hit: bool, mode: str = "loose", time_col: str = "observed_at",
            labels: str = "labels", force: str | None = None, label_sets: DataFrame | None = None,
            set_key: str = "fingerprint") -> DataFrame:
    a, pairs = _set_pairs(alerts, mutes, mode, labels, force, label_sets, set_key)
    side = broadcast_if_small(materialize(merged_intervals(pairs)))
    muted_at = in_intervals("_mi", time_col)
    found = a.join(side, "_lk", "inner" if hit else "left").where(muted_at if hit else ~muted_at)
    return found.select(*alerts.columns)


def muted(alerts: DataFrame, mutes: DataFrame, **kw) -> DataFrame:
    """R3 semi form: alerts suppressed by at least one active mute; an alert
    hit by several mutes comes out once. Keywords: ``mode``, ``time_col``,
    ``labels``, ``force``, ``label_sets`` and ``set_key`` as in :func:`mute_pairs`."""
    return _lookup(alerts, mutes, True, **kw)


def unmuted(alerts: DataFrame, mutes: DataFrame, **kw) -> DataFrame:
    """R3 anti form: alerts that reach routing."""
    return _lookup(alerts, mutes, False, **kw)


def muted_keys_at(mutes: DataFrame, as_of, label_sets: DataFrame, key: str = "fingerprint",
                  mode: str = "strict") -> DataFrame:
    """Keys of the label sets matched by a mute active at ``as_of``, from a
    label-set table (``fingerprint_table``: ``_lkey`` plus ``key``)."""
    sets = label_sets.select(key, F.map_from_entries("_lkey").alias("_lset"))
    return active_mute_pairs(sets, mutes, as_of, mode=mode, labels="_lset").select(key).distinct()


def exclude_muted_at(alerts: DataFrame, mutes: DataFrame, as_of, key: str = "fingerprint",
                     mode: str = "strict", labels: str = "labels",
                     label_sets: DataFrame | None = None) -> DataFrame:
    """Drop alerts contained (strict F2) by a mute active at ``as_of``.

    With ``label_sets`` the match runs on that (small, materialised) table,
    so ``alerts`` is not evaluated a second time for the lookup side."""
    if label_sets is not None:
        ids = muted_keys_at(mutes, as_of, label_sets, key, mode)
    else:
        ids = active_mute_pairs(alerts, mutes, as_of, mode=mode, labels=labels).select(key)
    return alerts.join(ids, key, "left_anti")


# ------------------------------------------------------------------ listing

def mute_view(mutes: DataFrame, as_of) -> DataFrame:
    """MuteView: mute columns plus the computed status at ``as_of``."""
    return mutes.withColumn("status", mute_status("starts_at", "ends_at", as_of))


def filter_mutes(mutes: DataFrame, status: str, as_of) -> DataFrame:
    """Present (``ends_at >= t``), expired (``ends_at < t``) or all."""
    t = as_time(as_of)
    if status == "present":
        return mutes.where(F.col("ends_at") >= t)
    if status == "expired":
        return mutes.where(F.col("ends_at") < t)
    if status in ("", "all", None):
        return mutes
    raise ValueError(f"unknown mute status filter {status!r}")


def list_mutes(mutes: DataFrame, status: str, as_of) -> DataFrame:
    """Filter, status, latest end first (``id`` breaks ties)."""
    return (mute_view(filter_mutes(mutes, status, as_of), as_of)
            .orderBy(F.col("ends_at").desc(), F.col("id")))


def get_mutes(mutes: DataFrame, ids: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """R10 in batch form: ``ids(id)`` joined to mutes; unknown ids by anti
    join."""
    found = mute_view(mutes.join(ids, "id", "left_semi"), as_of)
    missing = ids.join(mutes.select("id"), "id", "left_anti").withColumn(
        "error", F.format_string('mute "%s" not found', F.col("id")))
    return found, missing


# ------------------------------------------------------------------ validation, create, expire

def validation_error(matchers="matchers", starts_at="starts_at", ends_at="ends_at",
                     comment="comment", created_by="created_by") -> Column:
    """The first failing field, in the reference's fixed order, as
    ``struct(field, message)``; NULL when the request is valid."""
    # the zero time of the wire format counts as missing
    m, s, e = F.col(matchers), zero_time_to_null(F.col(starts_at)), zero_time_to_null(F.col(ends_at))
    # fixed values: fields, messages and their order
    err = lambda f, msg: F.struct(F.lit(f).alias("field"), F.lit(msg).alias("message"))
    return (F.when(m.isNull() | (F.size(m) == 0), err("matchers", "matchers must be non-empty"))
            .when(s.isNull(), err("starts_at", "starts_at and ends_at are required"))
            .when(e.isNull(), err("ends_at", "starts_at and ends_at are required"))
            .when(~(e > s), err("ends_at", "ends_at must be after starts_at"))
            .when(is_blank(comment), err("comment", "comment is required"))
            .when(is_blank(created_by), err("created_by", "created_by is required")))


def create_mutes(requests: DataFrame, as_of, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """K4: split requests into new mutes (with id and status) and rejects
    (field, message). The id is deterministic over the request, so equal
    requests are one mute, and a mute that ``existing`` already has is not
    created again: ids stay unique."""
    v = requests.withColumn("_err", validation_error())
    ok = v.where(F.col("_err").isNull()).drop("_err")
    created = ok.select(
        mute_id(F.to_json(F.map_from_entries(F.sort_array(F.map_entries("matchers")))),
                "starts_at", "ends_at", "comment", "created_by").alias("id"),
        "matchers", "starts_at", "ends_at",
        F.coalesce("comment", F.lit("")).alias("comment"),
        F.coalesce("created_by", F.lit("")).alias("created_by"))
    # equal ids are equal requests (the hash covers every field)
    created = created.dropDuplicates(["id"])
    if existing is not None:
        created = created.join(existing.select("id"), "id", "left_anti")
    rejects = v.where(F.col("_err").isNotNull()).select(
        "*", F.col("_err.field").alias("field"), F.col("_err.message").alias("message")).drop("_err")
    return mute_view(created, as_of), rejects


def expire_mutes(mutes: DataFrame, expires: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K5: ``expires(id, at)`` sets ``ends_at = at`` (no status guard, as in
    the reference); of several for one id the latest ``at`` counts. Returns
    the new mutes table and the unknown ids."""
    e = expires.groupBy("id").agg(F.max("at").alias("_at"))
    new = (mutes.join(e, "id", "left")
           .withColumn("ends_at", F.coalesce("_at", "ends_at")).drop("_at"))
    missing = e.join(mutes.select("id"), "id", "left_anti").select(
        "id", F.format_string('mute "%s" not found', F.col("id")).alias("error"))
    return new.select(*mutes.columns), missing
