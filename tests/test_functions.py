import datetime as dt
import json
import random

from pyspark.sql import functions as F

from alertflow.functions import labels as L
from alertflow.functions import status as S
from alertflow.sinks.outbox import payload
from tests import models

MAP = "map<string,string>"


def _one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_match_all_cases(spark):
    rows = [
        ({}, {"a": "1"}, True),                                  # catch-all
        (None, {"a": "1"}, True),                                # absent map is a catch-all
        ({"a": "1", "b": "2"}, {"a": "1", "b": "2", "c": "3"}, True),
        ({"a": "1", "b": "2"}, {"a": "1", "b": "3"}, False),
        ({"team": "infra"}, {"a": "1"}, False),                  # missing label
        ({"x": ""}, {"a": "1"}, True),                           # missing equals ''
    ]
    got = _one(spark, L.match_all("c", "l"), [(c, l) for c, l, _ in rows], f"c {MAP}, l {MAP}")
    assert got == [w for _, _, w in rows]


def test_contain_is_strict(spark):
    rows = [({"a": "1"}, {"x": ""}, False), ({"x": ""}, {"x": ""}, True), ({"a": "1"}, {}, True),
            ({"a": "1"}, {"a": "1"}, True), ({"a": "2"}, {"a": "1"}, False)]
    got = _one(spark, L.labels_contain("l", "m"), [(l, m) for l, m, _ in rows], f"l {MAP}, m {MAP}")
    assert got == [w for _, _, w in rows]


def test_literal_match_equals_generic(spark):
    rng = random.Random(3)
    rows = [({k: rng.choice(["", "a", "b"]) for k in rng.sample(["x", "y", "z"], rng.randint(0, 3))},)
            for _ in range(200)]
    df = spark.createDataFrame(rows, f"l {MAP}")
    cond = {"x": "a", "y": ""}
    out = df.select(L.literal_match_all(cond, "l").alias("a"),
                    L.match_all(F.create_map(F.lit("x"), F.lit("a"), F.lit("y"), F.lit("")), "l").alias("b")).collect()
    assert all(r.a == r.b for r in out)
    assert [r.a for r in out] == [models.match_all(cond, r[0]) for r in rows]


def test_fingerprint_matches_model(spark):
    rng = random.Random(7)
    alphabet = ["a", "b", "severity", "team", "é", "日本", "", "x=y", "q\"", "\\"]
    rows = []
    for _ in range(300):
        n = rng.randint(0, 5)
        rows.append(({rng.choice(alphabet) + str(rng.randint(0, 3)): rng.choice(alphabet) for _ in range(n)},))
    rows.append(({},))
    got = _one(spark, L.fingerprint("l"), rows, f"l {MAP}")
    assert got == [models.fingerprint(r[0]) for r in rows]
    assert models.fingerprint({}) == "cbf29ce484222325"
    assert models.fingerprint({"severity": "critical", "team": "infra"}) == "06d393ef9aeb3e10"


def test_fingerprint_key_order_free_and_value_sensitive(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},), ({"b": "2", "a": "1"},), ({"a": "1", "b": "3"},),
                                ({"a": ""},), ({},)], f"l {MAP}")
    fps = [r[0] for r in df.select(L.fingerprint("l")).collect()]
    assert fps[0] == fps[1] and fps[0] != fps[2] and fps[3] != fps[4]


def test_with_fingerprint_joins_back(spark):
    rows = [(i, {"k": str(i % 5)}) for i in range(50)]
    df = spark.createDataFrame(rows, f"id long, labels {MAP}")
    for limit in (10**6, 0):  # broadcast and shuffle branches
        out = {r.id: r.fingerprint for r in L.with_fingerprint(df, broadcast_max_bytes=limit).collect()}
        assert out == {i: models.fingerprint(l) for i, l in rows}


def test_status_boundaries(spark):
    now = dt.datetime(2026, 5, 27, 3, 0, 0)
    rows = [(None, now), (now, now), (now - dt.timedelta(seconds=1), now), (now + dt.timedelta(seconds=1), now)]
    df = spark.createDataFrame(rows, "e timestamp, n timestamp")
    out = df.select(S.alert_status("e", "n"), S.desired_status("e", "n"), S.observed_status("e", "n"),
                    S.failed_status(S.desired_status("e", "n"))).collect()
    assert [tuple(r) for r in out] == [
        ("firing", "firing-sent", "firing", "firing-failed"),
        ("resolved", "resolved-sent", "expired", "resolved-failed"),
        ("resolved", "resolved-sent", "expired", "resolved-failed"),
        ("firing", "firing-sent", "firing", "firing-failed")]


def test_failed_status_leaves_failed_values(spark):
    vals = ["firing-sent", "resolved-sent", "firing-failed", "resolved-failed"]
    got = _one(spark, S.failed_status("s"), [(v,) for v in vals], "s string")
    assert got == ["firing-failed", "resolved-failed", "firing-failed", "resolved-failed"]


def test_mute_status_points(spark):
    t0 = dt.datetime(2026, 5, 19, 12, 0, 0)
    eps = dt.timedelta(microseconds=1)
    pts = [(t0 - eps, "pending"), (t0, "active"), (t0 + dt.timedelta(minutes=30), "active"),
           (t0 + dt.timedelta(hours=1), "active"), (t0 + dt.timedelta(hours=1) + eps, "expired")]
    df = spark.createDataFrame([(t0, t0 + dt.timedelta(hours=1), p) for p, _ in pts], "s timestamp, e timestamp, n timestamp")
    out = df.select(S.mute_status("s", "e", F.col("n")), S.mute_active("s", "e", F.col("n"))).collect()
    assert [r[0] for r in out] == [w for _, w in pts]
    assert [r[1] for r in out] == [False, True, True, True, False]


def test_zero_time_is_null(spark):
    df = spark.createDataFrame([("0001-01-01 00:00:00",), ("2024-01-01 00:00:00",)], "t string")
    out = df.select(S.zero_time_to_null(F.col("t").cast("timestamp")).alias("x")).collect()
    assert out[0].x is None and out[1].x == dt.datetime(2024, 1, 1)


def test_format_labels_and_matchers(spark):
    df = spark.createDataFrame([({"team": "infra", "a": 'say "hi"\\'},)], f"l {MAP}")
    r = df.select(L.format_labels("l"), L.format_matchers("l")).first()
    assert r[0] == 'a="say \\"hi\\"\\\\", team="infra"'
    assert r[1] == 'a=say "hi"\\ team=infra'


def test_parse_matchers_text(spark):
    texts = ["a=1 b=2", "  a=1=2\tb=x ", "=x", "x=", "a=1 a=2", "   ", None, "noequals"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select(L.parse_matchers_text("t").alias("p")).collect()
    m = [r.p.matchers for r in out]
    e = [r.p.error for r in out]
    assert m[0] == {"a": "1", "b": "2"} and e[0] is None
    assert m[1] == {"a": "1=2", "b": "x"}
    assert e[2] == 'invalid matcher "=x": expected key=value' and m[2] is None
    assert e[3] == 'invalid matcher "x=": expected key=value'
    assert m[4] == {"a": "2"}
    assert e[5] == "matchers must be non-empty" and e[6] == "matchers must be non-empty"
    assert e[7] == 'invalid matcher "noequals": expected key=value'


def test_durations(spark):
    texts = ["1h30m", "2d", "90s", "abc", "0m", None, "1d2h3m4s"]
    got = _one(spark, S.parse_duration_ms("t"), [(t,) for t in texts], "t string")
    assert got == [5400000, 172800000, 90000, None, None, None, 93784000]
    ms = [5400000, 0, 90061000, 59000, 86400000]
    got = _one(spark, S.format_duration("m"), [(m,) for m in ms], "m long")
    assert got == ["1h30m", "0m", "1d1h1m", "0m", "1d"]


def test_form_time_and_display(spark):
    df = spark.createDataFrame([("2026-05-27T03:00",), ("bad",), (None,)], "t string")
    out = df.select(S.parse_form_time("t").alias("x")).collect()
    assert out[0].x == dt.datetime(2026, 5, 27, 3, 0) and out[1].x is None and out[2].x is None
    r = spark.createDataFrame([(dt.datetime(2026, 5, 27, 3, 4, 5, 6),)], "t timestamp").select(S.display_time("t")).first()
    assert r[0] == "2026-05-27 03:04:05"


def test_blank(spark):
    vals = ["", "   ", "\t\n", " ", "x", " x ", None]
    assert _one(spark, S.is_blank("t"), [(v,) for v in vals], "t string") == [True, True, True, True, False, False, True]


def test_same_multiset_cases(spark):
    cases = [(["r1", "r2"], ["r1", "r2"], True), (["r1", "r2"], ["r2", "r1"], True), (["r1", "r2"], ["r1"], False),
             (["r1"], ["r1", "r2"], False), (["a"], ["b"], False), (["a", "a"], ["a", "a"], True),
             (["a"], ["a", "a"], False), ([], [], True), (None, [], True)]
    got = _one(spark, L.same_multiset("a", "b"), [(a, b) for a, b, _ in cases], "a array<string>, b array<string>")
    assert got == [w for _, _, w in cases]


def test_json_maps(spark):
    df = spark.createDataFrame([('{"b":"2","a":"1"}',)], "t string")
    r = df.select(L.labels_from_json("t").alias("m")).select(L.labels_to_json("m")).first()
    assert r[0] == '{"a":"1","b":"2"}'


def test_mute_id_is_deterministic(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "x string, y int")
    ids = [r[0] for r in df.select(S.mute_id("x", "y")).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 32


def test_payload_shape(spark):
    t = dt.datetime(2026, 5, 27, 3, 0, 0)
    rows = [("pager", {"alertname": "HighCPU", "severity": "critical"}, {}, t, None, None, "fp1", t),
            ("pager", {"a": "b"}, {"summary": "s"}, t, t + dt.timedelta(microseconds=500000), "http://g", "fp2",
             t + dt.timedelta(hours=1))]
    df = spark.createDataFrame(rows, f"receiver string, labels {MAP}, annotations {MAP}, starts_at timestamp, "
                                     "ends_at timestamp, generator_url string, fingerprint string, observed_at timestamp")
    out = [json.loads(r[0]) for r in df.select(payload("observed_at")).collect()]
    a0 = out[0]
    assert a0["receiver"] == "pager" and a0["status"] == "firing"
    assert a0["alerts"][0]["endsAt"] == "0001-01-01T00:00:00Z"
    assert a0["alerts"][0]["startsAt"] == "2026-05-27T03:00:00Z"
    assert "annotations" not in a0["alerts"][0] and "generatorURL" not in a0["alerts"][0]
    assert a0["alerts"][0]["fingerprint"] == "fp1"
    a1 = out[1]
    assert a1["status"] == "resolved" and a1["alerts"][0]["endsAt"] == "2026-05-27T03:00:00.5Z"
    assert a1["alerts"][0]["annotations"] == {"summary": "s"} and a1["alerts"][0]["generatorURL"] == "http://g"


def test_parse_matchers_unicode_space_and_huge_duration(spark):
    df = spark.createDataFrame([("a=1 b=2",)], "t string")
    assert df.select(L.parse_matchers_text("t").alias("p")).first().p.matchers == {"a": "1", "b": "2"}
    got = _one(spark, S.parse_duration_ms("t"), [("99999999999999999999999s",)], "t string")
    assert got == [None]


def test_format_labels_go_quoting(spark):
    cases = [("a\nb", 'k="a\\nb"'), ("\x01", 'k="\\x01"'), ("\x7f", 'k="\\x7f"'), (" ", 'k="\\u00a0"'),
             ("​", 'k="\\u200b"'), ("é☃ x", 'k="é☃ x"'), ('"q\\', 'k="\\"q\\\\"'),
             ("\U0001F600", 'k="\U0001F600"'), ("\U000E0001", 'k="\\U000e0001"'), ("t\tz\"", 'k="t\\tz\\""')]
    got = _one(spark, L.format_labels("l"), [({"k": v},) for v, _ in cases], f"l {MAP}")
    assert got == [w for _, w in cases]


def test_near_unique_label_sets_are_hashed_in_place(spark):
    def rows(n, sets):
        return spark.range(n).selectExpr("id", f"map('a', cast(id % {sets} AS string), 'b', if(id % 5 = 0, NULL, 'x')) AS labels").unionByName(
            spark.createDataFrame([(-1, None), (-2, {})], "id long, labels map<string,string>"))

    def operators(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def values(df):
        return {r.id: r.fingerprint for r in df.select("id", "fingerprint").collect()}

    unique, repeated = rows(3000, 3000), rows(3000, 100)
    in_place = L.with_fingerprint(unique)
    assert "Exchange" not in operators(in_place) and "Join" not in operators(in_place)
    assert "BroadcastHashJoin" in operators(L.with_fingerprint(repeated))
    table = L.fingerprint_table(unique)
    assert "BroadcastHashJoin" in operators(L.with_fingerprint(unique, table=table))
    assert "Join" not in operators(L.with_fingerprint(unique, table=table, broadcast_max_bytes=1000))
    joined = L.with_fingerprint(repeated, table=L.fingerprint_table(repeated), broadcast_max_bytes=1000)
    assert "SortMergeJoin" in operators(joined) or "ShuffledHashJoin" in operators(joined)
    want = values(L.with_fingerprint(unique, table=table))
    assert values(in_place) == want and len(want) == 3002 and want[-1] == want[-2] == L.EMPTY_FINGERPRINT
    assert values(joined) == values(repeated.withColumn("fingerprint", L.fingerprint("labels")))
    assert L.with_fingerprint(unique.limit(0)).collect() == []
