"""Structured Streaming forms of the pipeline (S3, R25 stream, T1, T2, T3).

``ReplaySink`` is the preferred form: ``foreachBatch`` runs the batch
pipeline of ``plans.pipeline`` on every micro-batch. Inside a batch it
re-reads the mutes (a mute written after the stream started applies to the
next alert), seeds the state machine with the latest attempts of the batch's
keys, appends the attempts and counters of the batch under ``batch_id=N`` (a
replayed batch overwrites its own folders, so retries are idempotent) and
updates ``notifications`` and ``alert_state``. These two are bucketed tables
with versions (``streaming.snapshots``): a batch reads and rewrites only the
buckets of its own keys, and versions that no retry can need are removed, so
neither the work of a batch nor the files grow with the stream's past.

``dedup_stream`` (T1) is the low-latency form: ``applyInPandasWithState``
keeps the last status per (rule, fingerprint) in the state store, no timers.
``observed_state_stream`` (T2) is the streaming aggregate of R11; with a
retention window, event-time timeouts drop fingerprints from the state store.
"""

from __future__ import annotations

import datetime as dt
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from alertflow import schemas
from alertflow.functions.labels import fingerprint_table, labels_from_json, labels_to_json, with_fingerprint
from alertflow.functions.status import desired_status
from alertflow.session import materialize
from alertflow.operators import delivery, metrics, observed
from alertflow.plans.pipeline import decision_keys, decision_table, replay
from alertflow.sources.config import RuleSet
from alertflow.streaming.snapshots import Snapshots


class ReplaySink:
    """``foreachBatch`` function running the whole Process pipeline. ``state_buckets`` should be of the order of the
    state's rows over a million, or of the keys of a batch if that is less."""

    def __init__(self, ruleset: RuleSet, out_dir: str, mutes_path: str | None = None,
                 failing_receivers=(), ok: str | Callable = "call_ok",
                 initial_notifications: str | None = None, initial_state: str | None = None,
                 retention_seconds: int | None = None, state_buckets: int = 256):
        self.retention = retention_seconds
        self.ruleset, self.out = ruleset, out_dir.rstrip("/")
        self.mutes_path, self.failing, self.ok = mutes_path, tuple(failing_receivers), ok
        self.initial = {"notifications": initial_notifications, "alert_state": initial_state}
        self.tables = {
            "notifications": Snapshots(f"{self.out}/notifications", schemas.NOTIFICATIONS, delivery.KEY, state_buckets),
            "alert_state": Snapshots(f"{self.out}/alert_state", schemas.ALERT_STATE, ["fingerprint"], state_buckets,
                                     time="last_seen_at")}

    def read(self, spark, name: str, version: int | None = None) -> DataFrame:
        """``notifications`` or ``alert_state`` after ``version`` micro-batches (the newest version unless given)."""
        return self.tables[name].read(spark, version)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        # Micro-batch ids are consecutive and batch b-1 is committed only
        # after its writes, so the state before batch b is version b. This
        # batch writes version b+1; a replayed batch reads the same input.
        spark = batch.sparkSession
        notif, state = self.tables["notifications"], self.tables["alert_state"]
        if batch_id == 0:
            for name, table in self.tables.items():
                path = self.initial[name]
                table.start(spark, spark.read.schema(table.schema).parquet(path) if path else None)
        if "call_ok" not in batch.columns:
            batch = batch.withColumn("call_ok", F.lit(True))
        mutes = spark.read.schema(schemas.MUTES).parquet(self.mutes_path) if self.mutes_path else None
        sets = fingerprint_table(batch)
        decided = decision_table(batch, self.ruleset, mutes, sets)
        seed = notif.read(spark, batch_id, notif.touched(decision_keys(decided, self.ruleset)))
        r = replay(batch, self.ruleset, mutes=mutes, seed=seed, ok=self.ok, failing_receivers=self.failing, table=decided)
        # the plan feeds three writes below: compute it once
        r.plan = materialize(r.plan)
        tried = delivery.attempts(r.plan)
        # A replayed micro-batch rewrites only its own folder
        tried.write.mode("overwrite").parquet(f"{self.out}/attempts/batch_id={batch_id}")
        notif.update(spark, batch_id, notif.touched(tried), lambda old: delivery.notification_snapshot(tried.unionByName(
            old.select("rule_name", "fingerprint", F.col("sent_at").alias("attempt_at"),
                       F.lit(None).cast("long").alias("seq"), "status"))))
        # R22 per batch (a foreachBatch frame is evaluated several times, so
        # df.observe would count more than once here)
        (metrics.counters(batch, r.plan)
         .write.mode("overwrite").parquet(f"{self.out}/counters/batch_id={batch_id}"))
        pushes = with_fingerprint(batch, table=sets)
        cutoff = None
        if self.retention:
            # Keep fingerprints seen within the window before this
            # batch's newest push (one aggregate over the batch)
            newest = batch.agg(F.max("observed_at")).first()[0]
            cutoff = None if newest is None else newest - dt.timedelta(seconds=self.retention)

        def merged(old: DataFrame) -> DataFrame:
            new = observed.alert_state(pushes, seed=old)
            return new if cutoff is None else observed.retain(new, cutoff)

        state.update(spark, batch_id, state.touched(sets), merged, older_than=cutoff)
        for table in self.tables.values():
            table.expire(spark, batch_id + 1)


def start_replay_stream(alerts_stream: DataFrame, sink: ReplaySink, checkpoint: str, trigger: dict | None = None):
    """Run ``sink`` on every micro-batch; progress is in ``checkpoint``."""
    w = alerts_stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


# ---------------------------------------------------------------- T1

DEDUP_OUT = T.StructType([
    T.StructField("rule_name", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("observed_at", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("desired", T.StringType()),
    T.StructField("status", T.StringType()),
])
DEDUP_STATE = T.StructType([T.StructField("status", T.StringType())])


_DEDUP_CHUNK = 10_000  # attempts per frame put out


def _dedup(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Vectorised per key: the stored status acts as a seed row, runs of
    equal ``desired`` are numbered, and a row is attempted when no earlier
    row of its run succeeded (the same rule as the batch plan, R13).

    Of each frame only the order, a status code and the outcome are held (18 bytes a row), as the rows of a key come
    unsorted; the attempts are put out in frames of bounded size."""
    codes: dict[str, int] = {}
    parts = []
    for pdf in pdfs:
        if len(pdf):
            kinds, names = pd.factorize(pdf["desired"])
            code = np.array([codes.setdefault(n, len(codes)) for n in names], np.int8)
            parts.append((pdf["observed_at"].to_numpy(), pdf["seq"].to_numpy(), code[kinds],
                          pdf["ok"].eq(True).to_numpy(bool)))
    if not parts:
        return
    at, seq, desired, ok = (np.concatenate(p) for p in zip(*parts, strict=True))
    del parts
    order = np.lexsort((seq, at))
    at, seq, desired, ok = at[order], seq[order], desired[order], ok[order]
    n = len(order)
    starts = np.concatenate([[True], desired[1:] != desired[:-1]])
    prev = state.get[0] if state.exists else None
    before = False  # whether the run of the first row has succeeded already
    if prev is not None and codes.get(prev.replace("-failed", "-sent")) == desired[0]:
        before = prev.endswith("-sent")
    # successes before each row, less those before its run began
    done = np.cumsum(ok) - ok
    first = np.flatnonzero(starts)
    base = done[first]
    base[0] -= before
    hits = np.flatnonzero(done == np.repeat(base, np.diff(np.append(first, n))))
    sent = np.array(list(codes), dtype=object)
    failed = np.array([c.replace("-sent", "-failed") for c in codes], dtype=object)

    def status(rows: np.ndarray) -> np.ndarray:
        return np.where(ok[rows], sent[desired[rows]], failed[desired[rows]])

    if len(hits):
        state.update((status(hits[-1:])[0],))
    for i in range(0, len(hits), _DEDUP_CHUNK):
        rows = hits[i:i + _DEDUP_CHUNK]
        yield pd.DataFrame({"rule_name": key[0], "fingerprint": key[1], "observed_at": at[rows], "seq": seq[rows],
                            "desired": sent[desired[rows]], "status": status(rows)})


def dedup_stream(decisions: DataFrame, ok: str = "ok") -> DataFrame:
    """Attempts of a decision stream, state = last status per key.
    Rows of one key inside one micro-batch are ordered by (observed_at, seq)."""
    d = decisions.select("rule_name", "fingerprint", "observed_at", "seq",
                         desired_status("ends_at", "observed_at").alias("desired"), F.col(ok).alias("ok"))
    return d.groupBy("rule_name", "fingerprint").applyInPandasWithState(
        _dedup, DEDUP_OUT, DEDUP_STATE, "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- T2

_OBSERVED_OUT = ("fingerprint string, labels string, starts string, ends string, first_seen long, last_seen long, "
                 "removed boolean")
_OBSERVED_STATE = "labels string, starts string, ends string, first_seen long, first_seq long, last_seen long, last_seq long"


def _expiry_ms(last_seen: int) -> int:
    return last_seen // 1000 + 1


def _observe(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold one fingerprint's pushes into its state, one frame at a time; times are microseconds."""
    columns = ["fingerprint", "labels", "starts", "ends", "first_seen", "last_seen", "removed"]

    def row(s: tuple, removed: bool) -> pd.DataFrame:
        labels, starts, ends, first, _, last, _ = s
        return pd.DataFrame([(key[0], labels, starts, ends, first, last, removed)], columns=columns)

    now = tuple(state.get) if state.exists else None
    if state.hasTimedOut:
        state.remove()
        yield row(now, True)
        return
    if now is not None and _expiry_ms(now[5]) < state.getCurrentWatermarkMs():
        now = None  # out of the window already, and seen again before its removal: a new alert
    for pdf in pdfs:
        if not len(pdf):
            continue
        order = pdf.sort_values(["seen", "seq"], kind="stable")
        old, new = order.iloc[0], order.iloc[-1]
        labels, starts, ends, first, first_seq, last, last_seq = now or (None,) * 7
        if now is None or (old.seen, old.seq) < (first, first_seq):
            starts, first, first_seq = old.starts, int(old.seen), int(old.seq)
        if now is None or (new.seen, new.seq) >= (last, last_seq):
            labels, ends, last, last_seq = new.labels, new.ends, int(new.seen), int(new.seq)
        now = (labels, starts, ends, first, first_seq, last, last_seq)
    if now is not None:
        state.update(now)
        state.setTimeoutTimestamp(_expiry_ms(now[5]))
        yield row(now, False)


def observed_state_stream(pushes: DataFrame, retention_seconds: int | None = None) -> DataFrame:
    """Continuous observed-alert state (update output mode).

    With ``retention_seconds`` (R26) the watermark follows the newest push at that distance. A fingerprint whose last push
    it has passed by a millisecond leaves the state store and is put out once more with ``removed`` true, so the store
    holds the fingerprints of one window, however long the stream runs. A push that is older than the watermark when it
    arrives is dropped; a fingerprint that comes back later starts anew, as after a deletion by the service."""
    if retention_seconds is None:
        return observed.alert_state_single(pushes)
    micros = {name: F.unix_micros(name).cast("string") for name in ("starts_at", "ends_at")}
    p = pushes.withWatermark("observed_at", f"{int(retention_seconds)} seconds").select(
        "fingerprint", "observed_at", F.unix_micros("observed_at").alias("seen"),
        F.coalesce(F.col("seq"), F.lit(-(1 << 63))).alias("seq"), labels_to_json("labels").alias("labels"),
        micros["starts_at"].alias("starts"), micros["ends_at"].alias("ends"))
    out = p.groupBy("fingerprint").applyInPandasWithState(
        _observe, _OBSERVED_OUT, _OBSERVED_STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return out.select("fingerprint", labels_from_json("labels").alias("labels"),
                      *(F.timestamp_micros(F.col(c).cast("long")).alias(name) for c, name in (
                          ("starts", "starts_at"), ("ends", "ends_at"), ("first_seen", "first_seen_at"),
                          ("last_seen", "last_seen_at"))), "removed")
