import datetime as dt
import random

from alertflow import schemas
from alertflow.operators import mutes as M
from tests import models

MAP = "map<string,string>"
T0 = dt.datetime(2024, 1, 1)


def _random_world(rng, n_alerts=300, n_mutes=40):
    keys, vals = ["a", "b", "c"], ["", "1", "2"]
    alerts = []
    for i in range(n_alerts):
        labels = {k: rng.choice(vals) for k in rng.sample(keys, rng.randint(0, 3))}
        alerts.append((i, T0 + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 5)), labels))
    mutes = []
    for j in range(n_mutes):
        m = {k: rng.choice(vals) for k in rng.sample(keys, rng.randint(0, 2))}
        s = T0 + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 5))
        e = s + dt.timedelta(minutes=rng.randint(-60, 60 * 48))
        mutes.append((f"m{j}", m, s, e, "c", "u"))
    return alerts, mutes


def _brute(alerts, mutes, strict=False):
    out = set()
    for aid, t, labels in alerts:
        for mid, m, s, e, _, _ in mutes:
            hit = models.contains(labels, m) if strict else models.match_all(m, labels)
            if s <= t <= e and hit:
                out.add((aid, mid))
    return out


def test_pairs_all_strategies_equal_brute_force(spark):
    rng = random.Random(5)
    alerts, mutes = _random_world(rng)
    a = spark.createDataFrame(alerts, f"alert_id long, observed_at timestamp, labels {MAP}")
    m = spark.createDataFrame(mutes, schemas.MUTES)
    for strict in (False, True):
        want = _brute(alerts, mutes, strict)
        mode = "strict" if strict else "loose"
        for force in ("keyset", "anchor"):
            for bucket in (3600, 86400):
                got = {(r.alert_id, r.m_id) for r in
                       M.mute_pairs(a, m, mode=mode, force=force, bucket_seconds=bucket).collect()}
                assert got == want, (mode, force, bucket)


def test_semi_anti_partition_alerts(spark):
    rng = random.Random(9)
    alerts, mutes = _random_world(rng, 200, 30)
    a = spark.createDataFrame(alerts, f"alert_id long, observed_at timestamp, labels {MAP}")
    m = spark.createDataFrame(mutes, schemas.MUTES)
    muted = {r.alert_id for r in M.muted(a, m).collect()}
    unmuted = {r.alert_id for r in M.unmuted(a, m).collect()}
    assert muted | unmuted == set(range(200)) and not (muted & unmuted)
    assert muted == {aid for aid, _ in _brute(alerts, mutes)}


def test_loose_strict_trap_and_double_hit(spark):
    a = spark.createDataFrame([(1, T0, {"instance": "h1"}), (2, T0, {"instance": "h1", "team": ""})],
                              f"alert_id long, observed_at timestamp, labels {MAP}")
    m = spark.createDataFrame([("m1", {"team": "", "instance": "h1"}, T0, T0, "c", "u"),
                               ("m2", {"instance": "h1"}, T0, T0, "c", "u")], schemas.MUTES)
    loose = sorted((r.alert_id, r.m_id) for r in M.mute_pairs(a, m, mode="loose").collect())
    strict = sorted((r.alert_id, r.m_id) for r in M.mute_pairs(a, m, mode="strict").collect())
    assert loose == [(1, "m1"), (1, "m2"), (2, "m1"), (2, "m2")]
    assert strict == [(1, "m2"), (2, "m1"), (2, "m2")]
    assert sorted(r.alert_id for r in M.muted(a, m).collect()) == [1, 2]  # removed once each


def test_validation_cases(spark):
    now = dt.datetime(2026, 5, 19, 12, 0, 0)
    base = dict(matchers={"severity": "info"}, starts_at=now, ends_at=now + dt.timedelta(hours=1), comment="c",
                created_by="u")
    cases = [("valid", {}, None), ("empty matchers", {"matchers": {}}, "matchers"),
             ("nil matchers", {"matchers": None}, "matchers"), ("zero starts_at", {"starts_at": None}, "starts_at"),
             ("zero ends_at", {"ends_at": None}, "ends_at"),
             ("both missing", {"starts_at": None, "ends_at": None}, "starts_at"),
             ("ends before starts", {"ends_at": now - dt.timedelta(hours=1)}, "ends_at"),
             ("equal", {"ends_at": now}, "ends_at"),
             ("empty comment", {"comment": ""}, "comment"), ("blank comment", {"comment": "   "}, "comment"),
             ("empty created_by", {"created_by": ""}, "created_by"),
             ("blank created_by", {"created_by": "   "}, "created_by")]
    rows = []
    for _, ch, _ in cases:
        r = dict(base)
        r.update(ch)
        rows.append((r["matchers"], r["starts_at"], r["ends_at"], r["comment"], r["created_by"]))
    df = spark.createDataFrame(rows, schemas.MUTE_REQUESTS)
    got = [r[0] for r in df.select(M.validation_error()["field"]).collect()]
    assert got == [w for _, _, w in cases]
    created, rejects = M.create_mutes(df, now)
    assert created.count() == 1 and rejects.count() == len(cases) - 1
    c = created.first()
    assert len(c.id) == 32 and c.status == "active"


def test_expire_and_listing(spark):
    now = dt.datetime(2026, 5, 19, 12, 0, 0)
    h = dt.timedelta(hours=1)
    m = spark.createDataFrame([("p", {"x": "1"}, now + h, now + 2 * h, "c", "u"),
                               ("a", {"x": "1"}, now - h, now + h, "c", "u"),
                               ("e", {"x": "1"}, now - 2 * h, now - h, "c", "u")], schemas.MUTES)
    present = [(r.id, r.status) for r in M.list_mutes(m, "present", now).collect()]
    assert present == [("p", "pending"), ("a", "active")]
    assert [r.id for r in M.list_mutes(m, "expired", now).collect()] == ["e"]
    exp = spark.createDataFrame([("p", now), ("zz", now)], "id string, at timestamp")
    new, missing = M.expire_mutes(m, exp)
    st = {r.id: r.status for r in M.mute_view(new, now + dt.timedelta(microseconds=1)).collect()}
    # pending mute expired early: ends before it starts, status stays pending
    assert st["p"] == "pending" and st["a"] == "active"
    assert [r.error for r in missing.collect()] == ['mute "zz" not found']
    p = [r for r in new.collect() if r.id == "p"][0]
    assert p.ends_at < p.starts_at
    found, miss = M.get_mutes(m, spark.createDataFrame([("a",), ("q",)], "id string"), now)
    assert [r.id for r in found.collect()] == ["a"] and miss.count() == 1


def test_a_mute_until_the_far_future_stays_one_row(spark):
    alerts = spark.createDataFrame([(i, {"a": str(i % 3)}, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(60)],
                                   "seq long, labels map<string,string>, observed_at timestamp")
    mutes = spark.createDataFrame(
        [("far", {"a": "1"}, dt.datetime(1970, 1, 1), dt.datetime(9999, 1, 1), "c", "u"),
         ("short", {"a": "2"}, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), "c", "u"),
         ("null", {"b": None}, dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 3, 1), "c", "u")], schemas.MUTES)
    _, short, long = M._keyed_sides(alerts, mutes, "loose", "observed_at", 86400, "labels", None, None, "fingerprint")
    assert long.count() == 1 and short.count() == 2 + 3
    muted = {r.seq for r in M.muted(alerts, mutes).collect()}
    assert muted == {i for i in range(60) if i % 3 == 1 or (i % 3 == 2 and i <= 24) or 48 <= i <= 49}
    assert {r.seq for r in M.unmuted(alerts, mutes).collect()} == set(range(60)) - muted
    for force in ("keyset", "anchor"):
        pairs = M.mute_pairs(alerts, mutes, force=force).select("seq", "m_id").collect()
        assert {p.seq for p in pairs} == muted and len(pairs) == len(set(pairs))


def test_repeated_expiries_and_requests_keep_ids_unique(spark):
    t = dt.datetime(2024, 1, 1)
    req = spark.createDataFrame([("x", {"a": "1"}, t, t + dt.timedelta(hours=1), "c", "u")] * 2
                                + [("z", {"a": "1"}, dt.datetime(1, 1, 1), t, "c", "u")], schemas.MUTES).drop("id")
    created, rejects = M.create_mutes(req, t)
    assert created.count() == 1
    assert [r.field for r in rejects.select("field").collect()] == ["starts_at"]  # the zero time counts as missing
    again, _ = M.create_mutes(req, t, existing=created)
    assert again.count() == 0
    at = spark.createDataFrame([(created.first().id, t), (created.first().id, t + dt.timedelta(minutes=5))], "id string, at timestamp")
    new, _ = M.expire_mutes(created.drop("status"), at)
    assert [r.ends_at for r in new.collect()] == [t + dt.timedelta(minutes=5)]
