"""The condition join by rarest anchors, and the merged mute intervals."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from alertflow.operators import matching
from alertflow.operators.matching import anchor_candidates, condition_pairs
from alertflow.operators.mutes import in_intervals, merged_intervals
from tests import models

MAP = "map<string,string>"


def _world(rng, n_sets, n_conds):
    """Label sets and conditions that all carry cluster=prod; more than eight key shapes."""
    keys = [f"k{i}" for i in range(6)]
    sets = [(i, {"cluster": "prod", "id": str(i), **{k: rng.choice(["", "a", "b"]) for k in rng.sample(keys, 3)}}) for i in range(n_sets)]
    conds = [(i, {"cluster": "prod", **{k: rng.choice(["a", "b", ""]) for k in rng.sample(keys, rng.randint(0, 3))},
                  **({"id": str(i % (n_sets + 5))} if i % 3 else {})}) for i in range(n_conds)]
    return sets, conds + [(n_conds, {}), (n_conds + 1, {"k0": ""}), (n_conds + 2, {"nobody": "has"}), (n_conds + 3, conds[0][1])]


@pytest.mark.parametrize("block", [2_000, 7])
@pytest.mark.parametrize("mode", ["loose", "strict"])
def test_rarest_anchor_equals_brute_force(spark, mode, block, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_ROWS", block)
    sets, conds = _world(random.Random(3), 60, 80)
    p = spark.createDataFrame(sets, f"sid long, labels {MAP}")
    c = spark.createDataFrame(conds, f"cid long, m {MAP}")
    got = sorted((r.sid, r.cid) for r in condition_pairs(p, c, matchers="m", mode=mode, force="anchor").collect())
    hit = models.match_all if mode == "loose" else (lambda m, labels: models.contains(labels, m))
    assert got == sorted((s, i) for s, labels in sets for i, m in conds if hit(m, labels))


def test_a_label_common_to_all_makes_no_candidates_of_its_own(spark):
    """n label sets and n conditions share cluster=prod; the candidates stay near the n answers at any n."""
    for n in (500, 2_000):
        p = spark.range(n).select(F.create_map(F.lit("cluster"), F.lit("prod"), F.lit("id"), F.col("id").cast("string")).alias("labels"))
        shape = F.concat(F.lit("x"), (F.col("id") % 12).cast("string"))
        c = spark.range(n).select(F.create_map(F.lit("cluster"), F.lit("prod"), F.lit("id"), F.col("id").cast("string"), shape, F.lit(""))
                                  .alias("m"))
        keyed = c.select(F.to_json(F.sort_array(F.map_entries("m"))).alias("_ckey"), F.col("m").alias("_cond"))
        assert anchor_candidates(p, keyed, "loose", "labels").count() == n
        assert condition_pairs(p, c, matchers="m").count() == n  # twelve key shapes: the anchor join


def test_merged_intervals_equal_the_plain_union(spark):
    rng = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)

    def at(minute):
        return t0 + dt.timedelta(minutes=minute)

    for n in (1, 3, 200):
        rows = [("k", at(s), at(s + rng.choice([0, 0, 1, 5, 30, 400]))) for s in (rng.randint(0, 3000) for _ in range(n))]
        rows += [("far", at(10), dt.datetime(9999, 12, 31)), ("empty", at(5), at(4)), ("touch", at(1), at(2)), ("touch", at(2), at(3))]
        iv = spark.createDataFrame(rows, "_lk string, m_starts_at timestamp, m_ends_at timestamp")
        merged = merged_intervals(iv)
        chunks = {r._lk: [(x.s, x.e) for c in r._mi for x in c["list"]] for r in merged.collect()}
        assert "empty" not in chunks and len(chunks["touch"]) == 1 and len(chunks["far"]) == 1
        assert all(e < s for (_, e), (s, _) in zip(chunks["k"], chunks["k"][1:]))  # disjoint and sorted
        probes = spark.createDataFrame([(k, at(m)) for k in ("k", "far", "empty", "touch", "none") for m in range(-5, 3500, 7 if n > 3 else 1)]
                                       + [("k", None)], "_lk string, t timestamp")
        got = {(r._lk, r.t): r.hit for r in probes.join(merged, "_lk", "left").select("_lk", "t", in_intervals("_mi", "t").alias("hit")).collect()}
        assert got == {(k, t): t is not None and any(x == k and s <= t <= e for x, s, e in rows) for k, t in got}
