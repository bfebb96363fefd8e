"""Label-condition joins: which condition maps (rules, mutes) match which
label sets, as an equi join instead of a nested loop.

Two exact strategies, both producing the same pairs:

* **key-set join** (few distinct condition key sets, the usual case): every
  condition is keyed by its sorted key list and the JSON of its values. The
  probe side computes, for each key set in use, the JSON of its own values
  (``''`` for absent keys in loose mode, JSON ``null`` in strict mode, which
  never equals). Equality of the two texts *is* the match, so candidate
  pairs are exactly the matching pairs. The probe side grows by the number
  of key sets (bounded by ``max_keysets``).
* **anchor join** (many key sets): each distinct condition is anchored on the
  rarest of its entries, by how many probe rows carry each (key, value); one
  whose entry no probe row carries matches nothing and goes. Conditions without
  a usable entry (loose mode: a non-empty one) are anchored on a sentinel that
  every probe row carries. An anchor with many rows on either side is dealt in
  blocks of ``BLOCK_ROWS`` x ``BLOCK_ROWS`` candidates, so none of its rows
  need to meet in one task. A residual F1/F2 check removes false candidates.

Extra equality columns (a time bucket) and a residual predicate are passed
through, which turns interval lookups into bucketed equi joins.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertflow.functions.labels import labels_contain, match_all, no_null_values, present_value
from alertflow.session import materialize

MAX_KEYSETS = 8
BLOCK_ROWS = 2_000  # rows of one side of a block of a frequent anchor
_SENTINEL = "\u0000"


def condition_pairs(probe: DataFrame, conds: DataFrame, labels: str = "labels", matchers: str = "matchers",
                    mode: str = "loose", extra_eq: tuple = (), residual: Column | None = None,
                    max_keysets: int = MAX_KEYSETS, force: str | None = None) -> DataFrame:
    """Inner join of probe rows with the condition rows that match them.

    ``mode`` is ``loose`` (F1: absent label = '') or ``strict`` (F2:
    containment, the key must exist). Column names of the two sides must
    not collide except for ``extra_eq``.
    """
    if mode not in ("loose", "strict"):
        raise ValueError(mode)
    m = no_null_values(matchers)
    c = conds.withColumn("_ckeys", F.sort_array(F.map_keys(m)))
    strategy = force
    keysets = None
    if strategy in (None, "keyset"):
        rows = (c.select(F.to_json("_ckeys").alias("_kset")).distinct()
                .limit(max_keysets + 1).collect())
        keysets = sorted(r["_kset"] for r in rows)
        if strategy is None:
            strategy = "keyset" if len(keysets) <= max_keysets else "anchor"
    if strategy == "keyset":
        return _keyset_join(probe, c, labels, m, mode, keysets, extra_eq, residual)
    return _anchor_join(probe, c, labels, matchers, m, mode, extra_eq, residual)


def _keyset_join(probe, c, labels, m, mode, keysets, extra_eq, residual):
    cond = (c.withColumn("_kset", F.to_json("_ckeys"))
            .withColumn("_kval", F.to_json(F.transform("_ckeys", lambda k: m[k])))
            .drop("_ckeys"))
    if not keysets:
        # no conditions at all: the keyed join over an empty probe side
        empty = probe.select(*probe.columns, F.lit(None).cast("string").alias("_kset"),
                             F.lit(None).cast("string").alias("_kval")).where(F.lit(False))
        return empty.join(cond, on=["_kset", "_kval", *extra_eq], how="inner").drop("_kset", "_kval")
    labs = F.col(labels)
    entries = []
    for ks in keysets:
        keys = json.loads(ks)
        if mode == "loose":
            vals = [F.coalesce(labs[F.lit(k)], F.lit("")) for k in keys]
        else:
            vals = [present_value(labs, F.lit(k)) for k in keys]
        kval = F.to_json(F.array(*vals)) if vals else F.lit("[]")
        entries.append(F.struct(F.lit(ks).alias("_kset"), kval.alias("_kval")))
    probe_x = (probe.select("*", F.explode(F.array(*entries)).alias("_pk"))
               .select(*probe.columns, "_pk._kset", "_pk._kval"))
    keys = ["_kset", "_kval", *extra_eq]
    joined = probe_x.join(cond, on=keys, how="inner")
    if residual is not None:
        joined = joined.where(residual)
    return joined.drop("_kset", "_kval")


def _entries(labels: Column, mode: str) -> Column:
    """Entries that can anchor a condition: in loose mode an empty value may stand for an absent key."""
    entries = F.sort_array(F.map_entries(labels))
    return F.filter(entries, lambda e: e["value"] != "") if mode == "loose" else entries


def _with_sentinel(entries: Column) -> Column:
    return F.concat(entries, F.array(F.struct(F.lit(_SENTINEL).alias("key"), F.lit(_SENTINEL).alias("value"))))


def choose_anchors(probe: DataFrame, conds: DataFrame, mode: str, labels: str) -> DataFrame:
    """``conds`` (distinct ``_cond`` maps keyed by ``_ckey``) with the rarest entry ``_ak, _av`` that the probe rows
    carry and its frequency ``_rows``. Conditions with an entry that no probe row carries are left out."""
    usable = _entries(F.col("_cond"), mode)
    anchors = F.when(F.size(usable) > 0, usable).otherwise(_with_sentinel(usable))
    wanted = conds.select("_ckey", F.explode(anchors).alias("_e")).select("_ckey", F.col("_e.key").alias("_ak"), F.col("_e.value").alias("_av"))
    seen = (probe.select(F.explode(_with_sentinel(_entries(no_null_values(labels), mode))).alias("_e"))
            .select(F.col("_e.key").alias("_ak"), F.col("_e.value").alias("_av"))
            .groupBy("_ak", "_av").agg(F.count(F.lit(1)).alias("_rows")))
    counted = wanted.join(seen, ["_ak", "_av"], "left")
    rarest = F.min(F.struct(F.coalesce("_rows", F.lit(0)).alias("_rows"), "_ak", "_av")).alias("_r")
    return (counted.groupBy("_ckey").agg(rarest).where(F.col("_r._rows") > 0)
            .select("_ckey", "_r._ak", "_r._av", "_r._rows"))


def anchor_candidates(probe: DataFrame, conds: DataFrame, mode: str, labels: str) -> DataFrame:
    """Probe rows with each condition (``_ckey``, ``_cond``) whose anchor they carry."""
    chosen = materialize(choose_anchors(probe, conds, mode, labels))
    # blocks per side of each anchor: rows of the side over BLOCK_ROWS
    blocks = chosen.groupBy("_ak", "_av").agg(
        F.ceil(F.max("_rows") / F.lit(BLOCK_ROWS)).alias("_np"), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).alias("_nc"))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    right = (conds.join(chosen.drop("_rows"), "_ckey").join(blocks, ["_ak", "_av"])
             .withColumn("_c", F.pmod(F.xxhash64("_ckey"), F.col("_nc"))).withColumn("_p", every("_np")).drop("_np", "_nc"))
    left = (probe.select("*", F.explode(_with_sentinel(_entries(no_null_values(labels), mode))).alias("_pe"))
            .select(*probe.columns, F.col("_pe.key").alias("_ak"), F.col("_pe.value").alias("_av"))
            .join(blocks, ["_ak", "_av"])
            .withColumn("_p", F.pmod(F.xxhash64(F.to_json(labels)), F.col("_np"))).withColumn("_c", every("_nc")).drop("_np", "_nc"))
    return left.join(right, ["_ak", "_av", "_p", "_c"]).drop("_ak", "_av", "_p", "_c")


def _anchor_join(probe, c, labels, matchers, m, mode, extra_eq, residual):
    cond = c.withColumn("_ckey", F.to_json(F.sort_array(F.map_entries(m)))).drop("_ckeys")
    distinct = cond.select("_ckey", m.alias("_cond")).dropDuplicates(["_ckey"])
    check = match_all("_cond", labels) if mode == "loose" else labels_contain(labels, "_cond")
    pairs = anchor_candidates(probe, distinct, mode, labels).where(check).drop("_cond")
    joined = pairs.join(cond, on=["_ckey", *extra_eq], how="inner").drop("_ckey")
    return joined if residual is None else joined.where(residual)
