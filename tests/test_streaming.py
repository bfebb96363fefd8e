import datetime as dt
import json
import os
import random
import tempfile
import tracemalloc

import pandas as pd
from pyspark.sql import functions as F

from alertflow.functions.labels import with_fingerprint
from alertflow.operators import delivery, observed
from alertflow.plans.pipeline import replay
from alertflow.sources import alerts as S
from alertflow.sources.config import EXAMPLE_FAILING_RECEIVERS, example_ruleset
from alertflow.streaming import pipeline as SP
from tests.conftest import SF_SMALL


def _write_bodies(spark, d, n_files=8):
    """JSON-array bodies taken from the small events table (one file per
    slice of events, written in event order)."""
    from alertflow.sources import testdata
    a = testdata.load_alerts(spark, SF_SMALL).orderBy("seq").limit(400).collect()
    per = len(a) // n_files
    for i in range(n_files):
        body = []
        for r in a[i * per:(i + 1) * per]:
            item = {"labels": r.labels, "startsAt": r.starts_at.strftime("%Y-%m-%dT%H:%M:%S.%fZ")}
            if r.ends_at is not None:
                item["endsAt"] = r.ends_at.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
            body.append(item)
        with open(os.path.join(d, f"b{i:03d}.json"), "w") as f:
            json.dump(body, f)
        t = 1_700_000_000 + i * 60
        os.utime(os.path.join(d, f"b{i:03d}.json"), (t, t))


def test_batch_reader_rejects_whole_body(spark):
    d = tempfile.mkdtemp(prefix="af-s1-")
    with open(os.path.join(d, "ok.json"), "w") as f:
        f.write('[{"labels":{"a":"1"},"startsAt":"2026-05-27T03:00:00Z"},'
                '{"labels":{"b":"2"},"startsAt":"2026-05-27T03:00:00.5Z","endsAt":"0001-01-01T00:00:00Z"},'
                '{"startsAt":"2026-05-27T03:00:00Z"}]')
    with open(os.path.join(d, "bad.json"), "w") as f:
        f.write("not json")
    with open(os.path.join(d, "badlabels.json"), "w") as f:
        f.write('[{"labels":{"a":"1"}},{"labels":[1,2]}]')
    alerts, rejects = S.read_alert_batches(spark, d)
    rows = sorted(alerts.collect(), key=lambda r: r.seq)
    assert [r.labels for r in rows] == [{"a": "1"}, {"b": "2"}, {}]
    assert rows[1].ends_at is None and rows[1].starts_at == dt.datetime(2026, 5, 27, 3, 0, 0, 500000)
    assert sorted(os.path.basename(r.path) for r in rejects.collect()) == ["bad.json", "badlabels.json"]


def test_stream_equals_batch_and_replay_is_idempotent(spark):
    src = tempfile.mkdtemp(prefix="af-src-")
    out = tempfile.mkdtemp(prefix="af-out-")
    ck = tempfile.mkdtemp(prefix="af-ck-")
    _write_bodies(spark, src)
    rs = example_ruleset()

    batch_alerts, _ = S.read_alert_batches(spark, src)
    want = replay(batch_alerts.withColumn("call_ok", F.lit(True)), rs, failing_receivers=EXAMPLE_FAILING_RECEIVERS)
    want_att = {(r.rule_name, r.fingerprint, r.seq, r.status) for r in want.attempts.collect()}

    stream, _ = S.read_alert_stream(spark, src, max_files_per_trigger=3)
    sink = SP.ReplaySink(rs, out, failing_receivers=EXAMPLE_FAILING_RECEIVERS)
    q = SP.start_replay_stream(stream, sink, ck)
    q.awaitTermination()
    cnt = spark.read.parquet(f"{out}/counters").agg(F.sum("alerts_received"), F.sum("notify_success")).first()
    assert cnt[0] == batch_alerts.count()
    got = spark.read.parquet(f"{out}/attempts")
    got_att = {(r.rule_name, r.fingerprint, r.seq, r.status) for r in got.collect()}
    assert got.select("batch_id").distinct().count() >= 3
    assert got_att == want_att

    last = max(int(r.batch_id) for r in got.select("batch_id").distinct().collect()) + 1
    snap = {(r.rule_name, r.fingerprint, r.status) for r in
            sink.read(spark, "notifications", last).collect()}
    assert snap == {(r.rule_name, r.fingerprint, r.status) for r in want.notifications.collect()}

    # replaying the last micro-batch (same id, same input) rewrites its own
    # outputs and gives the same snapshot
    batches = sorted(int(r.batch_id) for r in got.select("batch_id").distinct().collect())
    b = batches[-1]
    files = sorted(os.listdir(src))[3 * b:]
    redo, _ = S.read_alert_batches(spark, [os.path.join(src, f) for f in files])
    sink(redo, b)
    again = {(r.rule_name, r.fingerprint, r.status) for r in
             sink.read(spark, "notifications", b + 1).collect()}
    assert again == snap
    got2 = {(r.rule_name, r.fingerprint, r.seq, r.status) for r in spark.read.parquet(f"{out}/attempts").collect()}
    assert got2 == want_att
    st = sink.read(spark, "alert_state")
    assert st.count() == with_fingerprint(batch_alerts).select("fingerprint").distinct().count()


def test_dedup_stream_equals_plan(spark):
    src = tempfile.mkdtemp(prefix="af-dec-")
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(300):
        t = t0 + dt.timedelta(minutes=i)
        rows.append(("r", f"f{i % 7}", t, i, t if (i // 3) % 2 else None, i % 5 != 0))
    schema = "rule_name string, fingerprint string, observed_at timestamp, seq long, ends_at timestamp, ok boolean"
    df = spark.createDataFrame(rows, schema)
    for k in range(3):  # three files in time order -> three micro-batches
        df.where((F.col("seq") >= k * 100) & (F.col("seq") < (k + 1) * 100)).coalesce(1) \
          .write.mode("overwrite").parquet(f"{src}/tmp{k}")
        part = [f for f in os.listdir(f"{src}/tmp{k}") if f.endswith(".parquet")][0]
        os.makedirs(f"{src}/in", exist_ok=True)
        os.link(f"{src}/tmp{k}/{part}", f"{src}/in/p{k}.parquet")
        t = 1_700_000_000 + k * 60
        os.utime(f"{src}/in/p{k}.parquet", (t, t))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/in")
    q = (SP.dedup_stream(stream).writeStream.format("memory").queryName("t1_out").outputMode("append")
         .trigger(availableNow=True).option("checkpointLocation", tempfile.mkdtemp(prefix="af-ck1-")).start())
    q.awaitTermination()
    got = {(r.seq, r.status) for r in spark.sql("select * from t1_out").collect()}
    inp = spark.read.schema(schema).parquet(f"{src}/in")
    want = {(r.seq, r.status) for r in delivery.delivery_plan(inp, ok="ok").where("deliver").collect()}
    assert got == want and len(got) > 0


class _State:
    """What the per-key function uses of a group state."""

    def __init__(self, value=None):
        self.value = value

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value


def test_dedup_equals_a_plain_walk_and_holds_little():
    def plain(rows, last):
        out = []
        for t, seq, desired, ok in sorted(rows, key=lambda r: r[:2]):
            if last != desired:
                last = desired if ok else desired.replace("-sent", "-failed")
                out.append((seq, last))
        return out, last

    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 40)
        rows = [(rng.randint(0, 9), i, rng.choice(["firing-sent", "resolved-sent"]), rng.random() < 0.5) for i in range(n)]
        rng.shuffle(rows)
        seed = rng.choice([None, "firing-sent", "firing-failed", "resolved-sent", "resolved-failed"])
        cuts = sorted(rng.choices(range(n + 1), k=2))
        frames = [pd.DataFrame(part, columns=["observed_at", "seq", "desired", "ok"]).assign(
            observed_at=lambda d: pd.to_datetime(d["observed_at"], unit="s")) for part in (rows[:cuts[0]], rows[cuts[0]:cuts[1]], rows[cuts[1]:]) if part]
        state = _State(seed and (seed,))
        got = [(r.seq, r.status) for f in SP._dedup(("r", "f"), iter(frames), state) for r in f.itertuples()]
        want, last = plain(rows, seed)
        assert got == want and (state.value or (None,))[0] == last

    def frames(n):
        for at in range(0, n, 10_000):
            t = pd.Timestamp("2024-01-01") + pd.to_timedelta(range(at, at + 10_000), unit="s")
            yield pd.DataFrame({"rule_name": "r" * 50, "fingerprint": "f" * 50, "observed_at": t, "seq": range(at, at + 10_000),
                                "desired": ["firing-sent", "resolved-sent"] * 5_000, "ok": True})

    tracemalloc.start()
    total = sum(len(f) for f in SP._dedup(("r", "f"), frames(1_000_000), _State()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 1_000_000 and peak < 150_000_000


def test_state_stream_drops_fingerprints_after_the_retention_window(spark):
    src = tempfile.mkdtemp(prefix="af-t2r-")
    t0, far = dt.datetime(2024, 1, 1), dt.datetime(9999, 12, 31, 1, 2, 3, 456789)
    schema = "fingerprint string, labels map<string,string>, starts_at timestamp, ends_at timestamp, observed_at timestamp, seq long"
    seen = []  # (micro-batch, hour, fingerprint); "back" is seen again after its removal, "late" comes too late
    for hour in range(12):
        seen += [(hour, hour, f"short-{hour}-{i}") for i in range(50)] + [(hour, hour, "steady")] * 3
    seen += [(0, 0, "back"), (9, 9, "back"), (10, 2, "late"), (10, 8.5, "steady")]
    rows = [(b, (fp, {"fp": fp, "q": '"}\n'}, t0 + dt.timedelta(minutes=n), far if n % 2 else None,
                 t0 + dt.timedelta(hours=hour, microseconds=n), n)) for n, (b, hour, fp) in enumerate(seen)]
    for k in range(12):
        part = spark.createDataFrame([r for b, r in rows if b == k], schema)
        part.coalesce(1).write.parquet(f"{src}/tmp{k}")
        (name,) = [f for f in os.listdir(f"{src}/tmp{k}") if f.endswith(".parquet")]
        os.makedirs(f"{src}/in", exist_ok=True)
        os.link(f"{src}/tmp{k}/{name}", f"{src}/in/p{k:02d}.parquet")
        os.utime(f"{src}/in/p{k:02d}.parquet", (1_700_000_000 + k * 60,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/in")
    out = []
    q = (SP.observed_state_stream(stream, retention_seconds=3 * 3600).writeStream.outputMode("update")
         .foreachBatch(lambda df, i: out.append((i, df.collect()))).trigger(availableNow=True)
         .option("checkpointLocation", tempfile.mkdtemp(prefix="af-ck4-")).start())
    q.awaitTermination()
    state, removed = {}, []
    for _, changed in sorted(out):
        for r in changed:
            if r.removed:
                removed.append(r.fingerprint)
                state.pop(r.fingerprint, None)
        for r in changed:
            if not r.removed:
                state[r.fingerprint] = r
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(sizes) <= 50 * 6 and sizes[-1] == len(state)  # rows fall, though 602 fingerprints were seen
    assert len(set(removed)) == len(removed) and "back" in removed
    # what is left equals the batch state of the window; the fingerprint that came back begins with its return
    log = spark.createDataFrame([r for _, r in rows if r[0] != "late" and not (r[0] == "back" and r[4] < t0 + dt.timedelta(hours=1))], schema)
    newest = t0 + dt.timedelta(hours=11, microseconds=max(n for n, (b, _, _) in enumerate(seen) if b == 11))
    want = {r.fingerprint: r for r in observed.retain(observed.alert_state(log), newest - dt.timedelta(hours=3)).collect()}
    assert {"back", "steady"} <= want.keys() == {fp for fp, r in state.items() if r.last_seen_at >= newest - dt.timedelta(hours=3)}
    for fp, r in want.items():
        assert r.asDict() == {k: v for k, v in state[fp].asDict().items() if k != "removed"}


def test_sink_retention_drops_old_fingerprints(spark):
    src = tempfile.mkdtemp(prefix="af-ret-")
    out = tempfile.mkdtemp(prefix="af-ret-out-")
    for i, (labels, t) in enumerate([({"a": "old"}, 1_700_000_000), ({"a": "new"}, 1_700_100_000)]):
        p = os.path.join(src, f"b{i}.json")
        with open(p, "w") as f:
            json.dump([{"labels": labels, "startsAt": "2023-11-14T00:00:00Z"}], f)
        os.utime(p, (t, t))
    stream, _ = S.read_alert_stream(spark, src, max_files_per_trigger=1)
    sink = SP.ReplaySink(example_ruleset(), out, retention_seconds=3600)
    SP.start_replay_stream(stream, sink, tempfile.mkdtemp(prefix="af-ret-ck-")).awaitTermination()
    last = max(int(r.batch_id) for r in spark.read.parquet(f"{out}/attempts").select("batch_id").distinct().collect())
    st = sink.read(spark, "alert_state", last + 1).collect()
    assert [r.labels for r in st] == [{"a": "new"}]


def _folders(path):
    return sorted(n for n in os.listdir(path) if n.startswith(("v=", "_bucket=")))


def test_snapshots_rewrite_touched_buckets_and_keep_two_versions(spark):
    """Twenty updates of two keys each over 64 buckets: a few buckets are rewritten each time, old versions go."""
    from pyspark.sql import types as T

    from alertflow.streaming.snapshots import Snapshots
    path, t0 = tempfile.mkdtemp(prefix="af-buckets-"), dt.datetime(2024, 1, 1)
    schema = T.StructType.fromDDL("k long, n long, at timestamp")
    table = Snapshots(path, schema, ["k"], buckets=64, time="at")
    want = {k: (0, t0) for k in range(300)}
    table.start(spark, spark.createDataFrame([(k, n, at) for k, (n, at) in want.items()], schema))
    rewritten = []
    for v in range(20):
        at = t0 + dt.timedelta(hours=v + 1)
        new = {v * 7 % 310: (v + 1, at), v * 13 % 310: (v + 1, at)}
        df = spark.createDataFrame([(k, n, a) for k, (n, a) in new.items()], schema)

        def merge(old):
            return old.join(df, "k", "left_anti").unionByName(df)

        rewritten.append(len(table.update(spark, v, table.touched(df), merge)))
        if v == 11:  # the same micro-batch again: same version, same rows
            table.update(spark, v, table.touched(df), merge)
        table.expire(spark, v + 1)
        want |= new
    assert max(rewritten) <= 2 and table.versions(spark) == [19, 20]
    assert {r.k: (r.n, r.at) for r in table.read(spark).collect()} == want
    # folders of other versions hold only buckets that are still in use
    used = {f for v in (19, 20) for f, _ in table.manifest(spark, v).values()}
    assert {f"{d}/{b}" for d in _folders(f"{path}/data") for b in _folders(f"{path}/data/{d}")} == used
    # buckets with rows older than the cutoff are touched without a change of their own
    cutoff = t0 + dt.timedelta(hours=10)
    gone = table.update(spark, 20, [], lambda old: old.where(F.col("at") >= F.lit(cutoff)), older_than=cutoff)
    assert len(gone) > 50 and {r.k for r in table.read(spark).collect()} == {k for k, (_, at) in want.items() if at >= cutoff}
    assert table.update(spark, 21, [], lambda old: old, older_than=cutoff) == []
    assert table.read(spark, 22).count() == table.read(spark, 21).count()


def test_snapshots_of_an_empty_table(spark):
    from alertflow import schemas
    from alertflow.streaming.snapshots import Snapshots
    table = Snapshots(tempfile.mkdtemp(prefix="af-buckets-"), schemas.NOTIFICATIONS, ["rule_name", "fingerprint"], buckets=4)
    assert table.read(spark).count() == 0 and table.versions(spark) == []
    table.start(spark, None)
    assert table.read(spark).count() == 0 and table.update(spark, 0, [], lambda old: old) == [] and table.versions(spark) == [0, 1]
