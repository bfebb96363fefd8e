import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from alertflow.operators import delivery as D
from tests import models

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "rule_name string, fingerprint string, observed_at timestamp, seq long, ends_at timestamp, ok boolean"


def _run(spark, rows, seed=None, chunk=900):
    df = spark.createDataFrame(rows, SCHEMA)
    sd = None
    if seed:
        sd = spark.createDataFrame([(k[0], k[1], v) for k, v in seed.items()],
                                   "rule_name string, fingerprint string, status string")
    out = D.delivery_plan(df, ok="ok", seed=sd, chunk_seconds=chunk).collect()
    return {r.seq: r.status for r in out}


def _model(rows, seed=None):
    mrows = [((r[0], r[1]), (r[2], r[3]), models.desired(r[4], r[2]), r[5]) for r in rows]
    out, _ = models.process(mrows, seed)
    return {o[1]: s for o, s in out.items()}


def test_fixture_table(spark):
    """Prior status x push x outcome, one key each."""
    cases = [  # prior, resolved?, ok, want
        (None, False, True, "firing-sent"),
        ("firing-sent", False, True, None),
        ("firing-failed", False, True, "firing-sent"),
        (None, False, False, "firing-failed"),
        ("firing-sent", True, True, "resolved-sent"),
        ("resolved-sent", False, True, "firing-sent"),
        ("resolved-sent", True, True, None),
        (None, True, True, "resolved-sent"),
    ]
    rows, seed = [], {}
    for i, (prior, resolved, ok, _) in enumerate(cases):
        t = T0 + dt.timedelta(minutes=i)
        rows.append(("r", f"fp{i}", t, i, t if resolved else None, ok))
        if prior:
            seed[("r", f"fp{i}")] = prior
    got = _run(spark, rows, seed)
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]


def test_muted_resolve_then_refire_is_skipped(spark):
    # the resolve was muted (removed before the plan): history stays firing-sent
    rows = [("r", "f", T0, 1, None, True), ("r", "f", T0 + dt.timedelta(hours=2), 3, None, True)]
    got = _run(spark, rows)
    assert got == {1: "firing-sent", 3: None}


def _random_rows(rng, n, keys, span_min):
    rows = []
    for i in range(n):
        k = rng.choice(keys)
        t = T0 + dt.timedelta(minutes=rng.randint(0, span_min))
        resolved = rng.random() < 0.4
        rows.append(("r" + k[0], "f" + k[1], t, i, (t - dt.timedelta(seconds=rng.choice([0, 1]))) if resolved else None,
                     rng.random() < 0.7))
    return rows


def test_random_against_sequential_model(spark):
    rng = random.Random(21)
    keys = [(str(a), str(b)) for a in range(3) for b in range(4)]
    for trial in range(3):
        rows = _random_rows(rng, 600, keys, 60 * 24)
        seed = {("r" + k[0], "f" + k[1]): rng.choice(["firing-sent", "firing-failed", "resolved-sent",
                                                       "resolved-failed"])
                for k in rng.sample(keys, 5)}
        for chunk in (60, 900, 86400 * 10):  # many small chunks exercise the carried maxima
            assert _run(spark, rows, seed if trial else None, chunk) == _model(rows, seed if trial else None)


def test_hot_key_spread_over_chunks(spark):
    rng = random.Random(4)
    rows = _random_rows(rng, 2000, [("0", "0")], 60 * 24 * 3)
    assert _run(spark, rows, chunk=300) == _model(rows)


def test_equal_times_ordered_by_seq(spark):
    rows = [("r", "f", T0, 2, None, True), ("r", "f", T0, 1, None, False)]
    assert _run(spark, rows) == {1: "firing-failed", 2: "firing-sent"}


def test_snapshot_and_last_attempt(spark):
    rows = [("r", "f", T0, 1, None, False), ("r", "f", T0 + dt.timedelta(minutes=1), 2, None, True),
            ("r", "f", T0 + dt.timedelta(minutes=2), 3, None, True)]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = D.delivery_plan(df, ok="ok")
    att = D.attempts(plan)
    assert sorted((r.seq, r.status) for r in att.collect()) == [(1, "firing-failed"), (2, "firing-sent")]
    snap = D.notification_snapshot(att).collect()
    assert [(s.rule_name, s.fingerprint, s.status) for s in snap] == [("r", "f", "firing-sent")]
    assert snap[0].sent_at == T0 + dt.timedelta(minutes=1)
    dec = spark.createDataFrame([("r", "f"), ("r", "g")], "rule_name string, fingerprint string")
    la = {r.fingerprint: r.prev_status for r in D.last_attempt(dec, D.notification_snapshot(att)).collect()}
    assert la == {"f": "firing-sent", "g": None}


def test_adaptive_chunks_for_hot_keys(spark):
    rng = random.Random(33)
    keys = [("0", "0"), ("0", "1"), ("1", "0"), ("2", "2")]
    rows = _random_rows(rng, 900, keys, 60 * 24) + _random_rows(rng, 40, [("9", "9")], 60 * 24)
    rows = [(r[0], r[1], r[2], i, r[4], r[5]) for i, r in enumerate(rows)]
    seed = {("r0", "f0"): "firing-sent", ("r9", "f9"): "resolved-failed"}
    df = spark.createDataFrame(rows, SCHEMA)
    sd = spark.createDataFrame([(k[0], k[1], v) for k, v in seed.items()],
                               "rule_name string, fingerprint string, status string")
    out = D.delivery_plan(df, ok="ok", seed=sd, hot_rows=50, target_rows=37).collect()
    assert {r.seq: r.status for r in out} == _model(rows, seed)


@pytest.mark.parametrize("spacing", [7, 0])  # evenly spaced; a burst: every push at one instant
def test_hot_key_slices_are_bounded_and_exact(spark, spacing):
    n = 60_000
    # one flapping alert under one rule: 200k pushes, plus an ordinary key
    df = (spark.range(n + 1000)
          .select(F.when(F.col("id") < n, F.lit("hot")).otherwise(F.lit("cold")).alias("fingerprint"),
                  F.lit("r").alias("rule_name"),
                  (F.lit(T0).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id") * spacing))
                  .alias("observed_at"),
                  F.col("id").alias("seq"),
                  F.when((F.col("id") / 3).cast("long") % 2 == 0, F.lit(None).cast("timestamp"))
                   .otherwise(F.lit(T0).cast("timestamp")).alias("ends_at"),
                  (F.col("id") % 5 != 0).alias("ok")))
    adaptive = D.delivery_plan(df, ok="ok", hot_rows=20_000, target_rows=6_000)
    fixed = D.delivery_plan(df, ok="ok", chunk_seconds=86400 * 365)
    diff = (adaptive.select("seq", "status").exceptAll(fixed.select("seq", "status")).count()
            + fixed.select("seq", "status").exceptAll(adaptive.select("seq", "status")).count())
    assert diff == 0
    rows = df.withColumn("desired", F.lit("x")).withColumn("_ok", F.col("ok")).withColumn("_ord", F.col("seq").cast("decimal(38,0)"))
    hot, n_rows = D._hot_keys(rows, 20_000)
    assert [r.fingerprint for r in hot.collect()] == ["hot"] and n_rows == n
    slices = D.hot_slices(rows.join(hot, D.KEY, "left_semi"), n_rows, 6_000).groupBy("_chunk").count().collect()
    assert len(slices) >= 8 and max(r["count"] for r in slices) <= 12_000


def test_ordinary_keys_take_one_exchange(spark):
    df = spark.createDataFrame([("r0", "f0", T0, 1, None, True)], SCHEMA)
    plan = D.delivery_plan(df, ok="ok")
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.split("Initial Plan")[0].count(" Exchange hashpartitioning") == 1 and "Join" not in text


def test_seed_of_other_keys_is_left_out(spark):
    df = spark.createDataFrame([("r0", "f0", T0, 1, None, True)], SCHEMA)
    seed = spark.createDataFrame([("r0", "f0", "firing-sent"), ("r9", "f9", "firing-sent")],
                                 "rule_name string, fingerprint string, status string")
    assert [(r.rule_name, r.status) for r in D.delivery_plan(df, ok="ok", seed=seed).collect()] == [("r0", None)]


def test_rows_of_equal_order_count_by_outcome(spark):
    rows = [("r0", "f0", T0, 1, None, True), ("r0", "f0", T0, 1, None, False)]
    got = D.delivery_plan(spark.createDataFrame(rows, SCHEMA), ok="ok").collect()
    assert sorted(r.status for r in got) == ["firing-failed", "firing-sent"]


def test_hot_keys_come_from_the_label_sets(spark):
    """With a table of key bounds neither hot keys nor seeds evaluate the decisions again; results stay the same."""
    rng = random.Random(41)
    rows = _random_rows(rng, 700, [("0", "0"), ("0", "1")], 60 * 24)
    df = spark.createDataFrame(rows, SCHEMA)
    seed = spark.createDataFrame([("r0", "f0", "firing-sent"), ("r7", "f7", "firing-sent")],
                                 "rule_name string, fingerprint string, status string")
    bound = {k: sum(1 for r in rows if (r[0], r[1]) == k) for k in {(r[0], r[1]) for r in rows}}
    keys = spark.createDataFrame([(*k, n + 10) for k, n in bound.items()] + [("r8", "f8", 900)],
                                 "rule_name string, fingerprint string, _n long")
    want = _model(rows, {("r0", "f0"): "firing-sent"})
    for hot_rows in (100, 10_000):
        out = D.delivery_plan(df, ok="ok", seed=seed, hot_rows=hot_rows, target_rows=60, keys=keys)
        assert {r.seq: r.status for r in out.collect()} == want
    assert {r.seq: r.status for r in D.delivery_plan(df, ok="ok", seed=seed, keys=keys, most_rows=710).collect()} == want
    failing = df.where(F.raise_error(F.lit("evaluated")).isNull())  # planning must not run it
    D.delivery_plan(failing, ok="ok", keys=keys, hot_rows=10_000, seed=seed)
    hot, n = D._hot_keys(keys, 100)
    assert n == 900 + sum(v + 10 for v in bound.values()) and hot.count() == 3
