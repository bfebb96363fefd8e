import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from alertflow.functions.labels import with_fingerprint
from alertflow.operators import delivery, metrics, routing
from alertflow.sinks import outbox
from alertflow.sources import testdata
from alertflow.sources.config import example_ruleset
from tests.conftest import SF_SMALL


def _decisions(spark):
    rs = example_ruleset()
    a = with_fingerprint(testdata.load_alerts(spark, SF_SMALL))
    return routing.known_receiver_decisions(routing.route(a, rs), rs)


def test_live_delivery_equals_replay_with_same_outcomes(spark):
    dec = _decisions(spark)

    def deliver(receiver, url, body):
        # deterministic outcome from the payload: fails for the closed port
        return not url.endswith(":9999") and json.loads(body)["alerts"][0]["fingerprint"][-1] not in "01"

    live = outbox.live_deliver(dec, deliver)
    got = {(r.rule_name, r.fingerprint, r.seq, r.status) for r in live.collect()}
    ok = (~F.col("receiver_url").endswith(":9999")) & ~F.substring("fingerprint", 16, 1).isin("0", "1")
    plan = delivery.delivery_plan(dec, ok=ok)
    want = {(r.rule_name, r.fingerprint, r.seq, r.status) for r in plan.where("deliver").collect()}
    assert got == want and len(got) > 100


def test_recorded_runs_survive_a_failure_in_the_middle(spark):
    dec, log = _decisions(spark), tempfile.mkdtemp(prefix="af-log-")
    calls, mended = tempfile.mkdtemp(prefix="af-calls-"), tempfile.mkdtemp(prefix="af-flag-") + "/mended"

    def deliver(receiver, url, body, key):
        fingerprint = json.loads(body)["alerts"][0]["fingerprint"]
        if fingerprint[-1] == "7" and not os.path.exists(mended):
            raise ConnectionError("receiver went away")
        with open(f"{calls}/{os.getpid()}", "a") as f:
            f.write(f"{key}\n")
        return not url.endswith(":9999") and fingerprint[-1] not in "01"

    def made():
        return [key for name in os.listdir(calls) for key in open(f"{calls}/{name}").read().split()]

    def rows(df):
        return sorted((r.rule_name, r.fingerprint, r.seq, r.status) for r in df.collect())

    with pytest.raises(Exception, match="went away"):
        outbox.deliver_and_record(dec, deliver, log, "a")
    first = made()
    assert outbox.recorded_runs(spark, log) == [] and outbox.read_attempts(spark, log).count() == 0
    open(mended, "w").close()
    ok = (~F.col("receiver_url").endswith(":9999")) & ~F.substring("fingerprint", 16, 1).isin("0", "1")
    want = rows(delivery.attempts(delivery.delivery_plan(dec, ok=ok)))
    assert rows(outbox.deliver_and_record(dec, deliver, log, "a")) == want
    second = made()
    # the failed run used the keys of the one that counts; each of these was called once
    assert len(second) - len(first) == len(want) == len(set(second)) and set(first) <= set(second)
    assert rows(outbox.deliver_and_record(dec, deliver, log, "a")) == want and len(made()) == len(second)

    last = delivery.notification_snapshot(outbox.read_attempts(spark, log))
    again = rows(delivery.attempts(delivery.delivery_plan(dec, ok=ok, seed=last)))
    assert rows(outbox.deliver_and_record(dec, deliver, log, "b", seed=last.withColumn("status", F.lit("firing-sent")))) == again
    assert outbox.recorded_runs(spark, log) == ["a", "b"] and 0 < len(again) != len(want)
    with pytest.raises(ValueError):
        outbox.deliver_and_record(dec, deliver, log, "../a")


def test_outbox_write_and_counters(spark):
    dec = _decisions(spark)
    plan = delivery.delivery_plan(dec, ok=F.lit(True))
    ob = outbox.outbox(plan)
    d = tempfile.mkdtemp(prefix="af-outbox-")
    outbox.write_outbox(ob, d)
    back = spark.read.parquet(d)
    assert back.count() == plan.where("deliver").count()
    assert set(r.receiver for r in back.select("receiver").distinct().collect()) <= \
        {r.name for r in example_ruleset().receivers}
    body = json.loads(back.first().payload)
    assert set(body) == {"receiver", "status", "alerts"} and len(body["alerts"]) == 1
    c = metrics.counters(testdata.load_alerts(spark, SF_SMALL), plan).first()
    assert c.alerts_received == 1000 and c.notify_failure == 0 and c.notify_success == ob.count()
    snap_dir = tempfile.mkdtemp(prefix="af-snap-")
    p = outbox.write_snapshot(delivery.notification_snapshot(delivery.attempts(plan)), snap_dir, 1)
    assert spark.read.parquet(p).count() > 0
    outbox.write_json(ob.limit(5), tempfile.mkdtemp(prefix="af-json-") + "/o")


def test_replay_with_given_label_sets_equals_plain(spark):
    from alertflow.functions.labels import fingerprint_table
    from alertflow.plans.pipeline import replay
    a = testdata.load_alerts(spark, SF_SMALL)
    m = testdata.load_mutes(spark, SF_SMALL)
    plain = replay(a, example_ruleset(), mutes=m).plan.select("alert_id", "rule_name", "status")
    table = fingerprint_table(a)
    given = replay(with_fingerprint(a, table=table), example_ruleset(), mutes=m, fingerprinted=True,
                   label_sets=table).plan.select("alert_id", "rule_name", "status")
    assert plain.exceptAll(given).count() == 0 and given.exceptAll(plain).count() == 0
    assert plain.count() == 1017
