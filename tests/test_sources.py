import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from alertflow import schemas
from alertflow.functions.labels import with_fingerprint
from alertflow.operators import observed
from alertflow.sources import alerts as S
from alertflow.sources import testdata
from alertflow.sources.config import read_cases
from alertflow.streaming.pipeline import observed_state_stream
from tests.conftest import SF_SMALL


def test_single_alert_files(spark):
    d = tempfile.mkdtemp(prefix="af-s2-")
    with open(os.path.join(d, "a.json"), "w") as f:
        json.dump({"labels": {"alertname": "HighCPU", "severity": "critical"}, "startsAt": "2026-05-27T03:00:00Z"},
                  f, indent=2)
    with open(os.path.join(d, "b.json"), "w") as f:
        json.dump({"startsAt": "2026-05-27T03:04:00Z"}, f)
    rows = sorted(S.read_alert_file(spark, d).collect(), key=lambda r: len(r.labels))
    assert rows[0].labels == {} and rows[1].labels["severity"] == "critical"
    assert rows[1].starts_at == dt.datetime(2026, 5, 27, 3, 0)


def test_stored_tables_and_schema_check(spark):
    d = tempfile.mkdtemp(prefix="af-s4-")
    m = spark.createDataFrame([("m1", {"a": "1"}, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), None, None)],
                              schemas.MUTES)
    m.write.parquet(f"{d}/mutes")
    back = S.read_mutes(spark, f"{d}/mutes").first()
    assert back.comment == "" and back.created_by == ""
    schemas.check_schema(S.read_mutes(spark, f"{d}/mutes"), schemas.MUTES, "mutes")
    with pytest.raises(schemas.SchemaError):
        schemas.check_schema(m.drop("matchers"), schemas.MUTES, "mutes")
    with pytest.raises(schemas.SchemaError):
        schemas.check_schema(m.withColumn("starts_at", F.lit("x")), schemas.MUTES, "mutes")
    j = spark.createDataFrame([("m1", '{"a":"1"}')], "id string, matchers string")
    assert S.mutes_from_jsonb(j).first().matchers == {"a": "1"}
    n = spark.createDataFrame([("r", "f", dt.datetime(2024, 1, 1), "firing-sent")], schemas.NOTIFICATIONS)
    n.write.parquet(f"{d}/n")
    assert S.read_notifications(spark, f"{d}/n").count() == 1


def test_cases_reader_rejects_unnamed(spark):
    d = tempfile.mkdtemp(prefix="af-s7-")
    with open(os.path.join(d, "c.json"), "w") as f:
        f.write(json.dumps({"name": "a", "labels": {"x": "1"}, "expect_rules": ["r"]}) + "\n")
        f.write(json.dumps({"name": "", "labels": {"x": "2"}}) + "\n")
    ok, bad = read_cases(spark, d)
    assert [r.name for r in ok.collect()] == ["a"] and bad.count() == 1


def test_fixture_mapping_counts(spark):
    a = testdata.load_alerts(spark, SF_SMALL)
    assert a.count() == 1000
    assert a.where(F.col("ends_at").isNotNull() & (F.col("ends_at") <= F.col("observed_at"))).count() == 400
    assert with_fingerprint(a).select("fingerprint").distinct().count() == 204
    assert testdata.load_mutes(spark, SF_SMALL).count() == 4


def test_observed_state_stream(spark):
    src = tempfile.mkdtemp(prefix="af-t2-")
    t0 = dt.datetime(2024, 1, 1)
    rows = [("f1", {"a": "1"}, t0, None, t0, 1), ("f1", {"a": "1"}, t0, t0, t0 + dt.timedelta(hours=1), 2),
            ("f2", {"b": "1"}, t0, None, t0, 3)]
    schema = "fingerprint string, labels map<string,string>, starts_at timestamp, ends_at timestamp, " \
             "observed_at timestamp, seq long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/in")
    stream = spark.readStream.schema(schema).parquet(f"{src}/in")
    q = (observed_state_stream(stream).writeStream.format("memory").queryName("t2_out").outputMode("update")
         .trigger(availableNow=True).option("checkpointLocation", tempfile.mkdtemp(prefix="af-ck2-")).start())
    q.awaitTermination()
    got = {r.fingerprint: r for r in spark.sql("select * from t2_out").collect()}
    want = {r.fingerprint: r for r in observed.alert_state(spark.createDataFrame(rows, schema)).collect()}
    assert got.keys() == want.keys()
    assert got["f1"].ends_at == t0 and got["f1"].last_seen_at == t0 + dt.timedelta(hours=1)


def test_observe_counters_in_a_plain_stream(spark):
    from alertflow.operators.metrics import observe_counters
    src = tempfile.mkdtemp(prefix="af-obs-")
    spark.range(25).selectExpr("id AS alert_id").coalesce(1).write.parquet(f"{src}/in")
    stream = spark.readStream.schema("alert_id long").parquet(f"{src}/in")
    q = (observe_counters(stream).writeStream.format("memory").queryName("obs_out")
         .trigger(availableNow=True).option("checkpointLocation", tempfile.mkdtemp(prefix="af-ck3-")).start())
    q.awaitTermination()
    seen = [p["observedMetrics"]["alertflow_counters"]["alerts_received"] for p in q.recentProgress
            if p.get("observedMetrics", {}).get("alertflow_counters")]
    assert sum(seen) == 25


def test_body_is_rejected_whole_on_any_bad_field(spark):
    import json

    good = {"labels": {"a": "1"}, "startsAt": "2024-01-01T00:00:00Z"}
    cases = [({}, True), ({"labels": None}, True), ({"labels": {"a": None}}, True), ({"labels": {"a": 5}}, False),
             ({"labels": "x"}, False), ({"labels": ["x"]}, False), ({"annotations": "x"}, False), ({"annotations": {"a": {}}}, False),
             ({"annotations": None}, True), ({"endsAt": "garbage"}, False), ({"endsAt": 12345}, False), ({"endsAt": None}, True),
             ({"endsAt": ""}, True), ({"endsAt": "2024-01-01T00:00:00+02:00"}, True), ({"endsAt": "2024-01-01T00:00:00.123456Z"}, True),
             ({"endsAt": "2024-13-01T00:00:00Z"}, False), ({"endsAt": "2024-01-01 00:00:00"}, True), ({"endsAt": "2024-02-30"}, False), ({"endsAt": "01.02.2024"}, False), ({"generatorURL": 1}, False),
             ({"generatorURL": "http://x"}, True), ({"unknown": [1, {}]}, True)]
    rows = [(f"f{i:02d}", dt.datetime(2024, 1, 1), json.dumps([good, good | c])) for i, (c, _) in enumerate(cases)]
    rows += [("g0", dt.datetime(2024, 1, 1), "[1]"), ("g1", dt.datetime(2024, 1, 1), "{}"), ("g2", dt.datetime(2024, 1, 1), "[")]
    alerts, rejects = S.parse_batches(spark.createDataFrame(rows, "path string, mtime timestamp, value string"))
    bad = {r.path for r in rejects.collect()}
    assert bad == {f"f{i:02d}" for i, (_, ok) in enumerate(cases) if not ok} | {"g0", "g1", "g2"}
    got = alerts.collect()
    assert len(got) == 2 * sum(ok for _, ok in cases) and all(None not in r.labels.values() for r in got)


def test_fields_decode_without_case_and_repeated_ones_by_the_last(spark):
    t = dt.datetime(2024, 1, 1)
    cases = [  # body, labels of its alerts (None: rejected)
        ('[{"Labels":{"a":"1"}}]', [{"a": "1"}]), ('[{"LABEL\u017f":{"A":"1"}}]', [{"A": "1"}]),
        ('[{"labels":{"a":"1","b":"x","a":"2"}}]', [{"a": "2", "b": "x"}]), ('[{"labels":{"a":"1","a":null}}]', [{"a": ""}]),
        ('[{"labels":{"a":"1","b":"2"},"LABELS":{"a":"3"}}]', [{"a": "3", "b": "2"}]),
        ('[{"labels":{"a":"1"},"labels":null}]', [{}]), ('[{"labels":{"a":5},"labels":{"a":"1"}}]', None),
        ("null", []), (" [ ] ", []), ("[null]", [{}]), ("", None), ('"[]"', None), ("[] x", None), ("[]]", None), ("[],[]", None),
        ('[],"end"] x', None), ("[{'labels':{}}]", None), ('[{"labels":{"a":"x}"}},{"labels":{"a\\"b":"]\\n\\"[{"}}]', [{"a": "x}"}, {'a"b': ']\n"[{'}]),
        ('[{"labels":"{}"}]', None), ('[{"labels":{"a":"1"},"x":[1,{"labels":7}]}]', [{"a": "1"}]),
        ('[{"labels":{"long":"' + "\\\\" * 100_000 + '"}}]', [{"long": "\\" * 100_000}])]
    rows = [(f"f{i:02d}", t, body, i) for i, (body, _) in enumerate(cases)] + [("f99", t, None, 99)]
    alerts, rejects = S.parse_batches(spark.createDataFrame(rows, "path string, mtime timestamp, value string, ordinal long"))
    assert {r.path for r in rejects.collect()} == {f"f{i:02d}" for i, (_, want) in enumerate(cases) if want is None} | {"f99"}
    got = {}
    for r in alerts.orderBy("seq").collect():
        got.setdefault(r.seq >> 20, []).append(r.labels)
    assert got == {i: want for i, (_, want) in enumerate(cases) if want}


def test_posted_time_forms(spark):
    noon = dt.datetime(2024, 3, 1, 12, 30)
    forms = {"2024-03-01T12:30:00Z": noon, "2024-03-01T14:30:00+02:00": noon, "2024-03-01T14:30:00.000+0200": noon,
             "2024-03-01T12:30:00": noon, "2024-03-01T12:30Z": noon, "2024-03-01T12:30": noon, "2024-03-01 12:30:00": noon,
             "2024-03-01": dt.datetime(2024, 3, 1), "": dt.datetime(1970, 1, 1), "2024-03-01T12:30:00.123456789Z": noon.replace(microsecond=123456),
             "0001-01-01T00:00:00Z": None}
    body = json.dumps([{"StartsAt": "2020-01-01", "startsAt": None, "endsat": f} for f in forms])
    alerts, rejects = S.parse_batches(spark.createDataFrame([("p", noon, body)], "path string, mtime timestamp, value string"))
    got = alerts.orderBy("seq").collect()
    assert [r.ends_at for r in got] == list(forms.values()) and {r.starts_at for r in got} == {dt.datetime(2020, 1, 1)}
    wrong = ["2024-03-01T14:30:00+0200", "2024-02-30", "2024-03-01T25:00:00Z", "2024-03-01t12:30:00z", "2024-03-01 12:30", "12:30"]
    rows = [(w, noon, json.dumps([{"endsAt": w}])) for w in wrong]
    _, rejects = S.parse_batches(spark.createDataFrame(rows, "path string, mtime timestamp, value string"))
    assert {r.path for r in rejects.collect()} == set(wrong)


def test_equal_arrival_times_keep_broker_order(spark):
    rows = [(f"t:0:{i}", dt.datetime(2024, 1, 1), '[{"labels":{"i":"%d"}},{"labels":{"i":"%d"}}]' % (2 * i, 2 * i + 1), i)
            for i in range(30)]
    alerts, _ = S.parse_batches(spark.createDataFrame(rows, "path string, mtime timestamp, value string, ordinal long"))
    assert [int(r.labels["i"]) for r in alerts.orderBy("observed_at", "seq").collect()] == list(range(60))


def test_files_of_equal_time_count_in_path_order(spark):
    d = tempfile.mkdtemp(prefix="af-order-")
    for i in (2, 0, 1):
        with open(f"{d}/b{i}.json", "w") as f:
            f.write('[{"labels":{"i":"%d"}}]' % i)
    alerts, _ = S.read_alert_batches(spark, d, observed_at="2024-01-01 00:00:00")
    assert [r.labels["i"] for r in alerts.orderBy("observed_at", "seq").collect()] == ["0", "1", "2"]


def test_batch_and_stream_number_alerts_alike(spark):
    src, t = tempfile.mkdtemp(prefix="af-num-"), 1_700_000_000
    names = ["b10.json", "b9.json", "b2.json", "x.json", "y.json", "push-2024-01-16T00-00-07.json"]
    for n in names:
        with open(f"{src}/{n}", "w") as f:
            f.write('[{"labels":{"n":"%s","i":"0"}},{"labels":{"n":"%s","i":"1"}}]' % (n, n))
        os.utime(f"{src}/{n}", (t, t))
    batch, _ = S.read_alert_batches(spark, src)
    stream, _ = S.read_alert_stream(spark, src, max_files_per_trigger=1)
    q = (stream.writeStream.format("memory").queryName("numbered").trigger(availableNow=True)
         .option("checkpointLocation", tempfile.mkdtemp(prefix="af-ck4-")).start())
    q.awaitTermination()

    def numbers(df):
        return {(r.labels["n"], r.labels["i"]): (r.observed_at, r.seq, r.alert_id) for r in df.collect()}

    got = numbers(batch)
    assert got == numbers(spark.table("numbered")) and len({s for _, s, _ in got.values()}) == 2 * len(names)
    by_seq = [n for n, i in sorted(got, key=lambda k: got[k][1]) if i == "0"]
    assert [n for n in by_seq if n.startswith("b")] == ["b2.json", "b9.json", "b10.json"]
    assert all(got[n, "1"][1] == got[n, "0"][1] + 1 for n in names)
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan


def test_equal_offsets_of_two_partitions_differ(spark):
    t = dt.datetime(2024, 1, 1)
    big = 1 << 40
    rows = [("t", p, o, t, bytearray(b'[{"labels":{"at":"%d.%d"}}]' % (p, o))) for p in (0, 1, 700) for o in (5, 6, big, big + 1)]
    raw = spark.createDataFrame(rows, "topic string, partition int, offset long, timestamp timestamp, value binary")
    alerts, _ = S.parse_batches(S.kafka_bodies(raw))
    got = {r.labels["at"]: r.seq for r in alerts.collect()}
    assert len(set(got.values())) == len(rows)
    assert got["1.5"] < got["0.6"] < got["1.6"] and got[f"0.{big}"] < got[f"0.{big + 1}"]


def test_ordinals_fit_into_seq(spark):
    rows = [(f"/a/{'9' * 30}.json", 2**62, 2**31 - 1), ("", 0, 0), ("no digits", 1, 1), ("/a/9/x", 2, 2)]
    df = spark.createDataFrame(rows, "path string, offset long, partition int").select(
        S.file_ordinal(F.col("path")).alias("f"), S.message_ordinal(F.col("offset"), F.col("partition")).alias("m"))
    assert all(0 <= r.f < 1 << 43 and 0 <= r.m < 1 << 43 for r in df.collect())
