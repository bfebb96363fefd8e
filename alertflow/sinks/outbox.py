"""Webhook payloads, the outbox and live delivery.

The payload is built by ``to_json`` inside the JVM. Go prints times as
RFC 3339 with trailing fractional zeros trimmed; the same text is produced
here from ``date_format`` so payloads compare byte-for-byte on UTC times.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertflow import schemas
from alertflow.functions.labels import sorted_entries
from alertflow.functions.status import alert_status

# Fixed value: the zero time printed for an open alert.
ZERO_TIME_JSON = "0001-01-01T00:00:00Z"


def rfc3339(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    frac = F.regexp_replace(F.date_format(c, "SSSSSS"), "0+$", "")
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")), F.lit("Z"))


def _sorted_map(m) -> Column:
    return F.map_from_entries(sorted_entries(m))


def payload(now="observed_at") -> Column:
    """the webhook body for one decision (one-element alerts array).

    Empty annotations and generatorURL are dropped (``omitempty``), an open
    ``endsAt`` is the zero time, which ``omitempty`` does not drop.
    """
    status = alert_status("ends_at", now)
    ann = F.when(F.size("annotations") > 0, _sorted_map("annotations"))
    url = F.when(F.coalesce(F.col("generator_url"), F.lit("")) != "", F.col("generator_url"))
    start = F.when(F.col("starts_at").isNotNull(), rfc3339("starts_at"))
    end = F.coalesce(rfc3339("ends_at"), F.lit(ZERO_TIME_JSON))
    alert = F.struct(status.alias("status"), _sorted_map("labels").alias("labels"),
                     ann.alias("annotations"), start.alias("startsAt"), end.alias("endsAt"),
                     url.alias("generatorURL"), F.col("fingerprint").alias("fingerprint"))
    return F.to_json(F.struct(F.col("receiver").alias("receiver"), status.alias("status"),
                              F.array(alert).alias("alerts")))


def outbox(plan: DataFrame, now: str = "observed_at") -> DataFrame:
    """K1 (outbox form): one row per delivered decision with its payload."""
    return plan.where("deliver").select(
        "rule_name", "fingerprint", "receiver", "receiver_url", F.col(now).alias("attempt_at"), "seq",
        "status", payload(now).alias("payload"))


def write_outbox(ob: DataFrame, path: str) -> None:
    """K1 write: partitioned by receiver, so each receiver's sender reads
    only its own folder."""
    ob.write.mode("append").partitionBy("receiver").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """K6: lists as JSON lines (maps stay JSON objects)."""
    df.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def write_snapshot(df: DataFrame, base: str, version: int) -> str:
    """K2/R14 snapshots: a new versioned folder per write (no in-place
    update); readers pick the highest complete version."""
    out = f"{base}/v={version:08d}"
    df.write.mode("errorifexists").parquet(out)
    return out


LIVE_SCHEMA = T.StructType([
    T.StructField("rule_name", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("attempt_at", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("status", T.StringType()),
])


def idempotency_key(now: str = "observed_at") -> Column:
    """One text per (rule, fingerprint, order), the same in every retry: a receiver that remembers it takes a payload once."""
    return F.sha2(F.to_json(F.struct("rule_name", "fingerprint", F.unix_micros(now).alias("at"), "seq")), 256)


def live_deliver(decisions: DataFrame, deliver: Callable[..., bool],
                 seed: DataFrame | None = None, now: str = "observed_at", keyed: bool = False) -> DataFrame:
    """K1 live form: the outcome is decided by the call itself, so a failure
    must change the next decision of the same key. Rows are hash partitioned
    by key and sorted inside partitions; ``mapInPandas`` streams them
    batch by batch and keeps only the last status per key. ``deliver`` gets
    ``(receiver, url, payload)`` and returns success; with ``keyed`` the
    row's :func:`idempotency_key` comes as a fourth argument. Task retries may
    call twice, which the at-least-once contract allows."""
    from alertflow.functions.status import desired_status

    d = decisions.select("rule_name", "fingerprint", F.col(now).alias("attempt_at"), "seq", "receiver",
                         "receiver_url", desired_status("ends_at", now).alias("desired"),
                         payload(now).alias("payload"), F.lit(None).cast("string").alias("prev"),
                         F.col("seq").cast("string").alias("_seq"),
                         (idempotency_key(now) if keyed else F.lit(None).cast("string")).alias("_key"))
    if seed is not None:
        s = seed.select("rule_name", "fingerprint", F.lit(None).cast("timestamp").alias("attempt_at"),
                        F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("receiver"),
                        F.lit(None).cast("string").alias("receiver_url"), F.lit(None).cast("string").alias("desired"),
                        F.lit(None).cast("string").alias("payload"), F.col("status").alias("prev"), F.lit(None).cast("string").alias("_seq"),
                        F.lit(None).cast("string").alias("_key"))
        d = d.unionByName(s)
    d = (d.repartition("rule_name", "fingerprint")
         .sortWithinPartitions("rule_name", "fingerprint", F.col("attempt_at").asc_nulls_first(), "seq"))

    def run(batches):
        import pandas as pd
        last, status = None, None  # rows come sorted by key: only the current key's status is kept
        for pdf in batches:
            out = []
            for r in pdf.rename(columns={"_seq": "seq_text", "_key": "key"}).itertuples(index=False):
                k = (r.rule_name, r.fingerprint)
                if k != last:
                    last, status = k, None
                if r.desired is None:
                    status = r.prev
                    continue
                if status == r.desired:
                    continue
                ok = bool(deliver(r.receiver, r.receiver_url, r.payload, *([r.key] if keyed else [])))
                st = r.desired if ok else r.desired.replace("-sent", "-failed")
                status = st
                # seq travels as text: a column with NULL seeds would become floating point
                out.append((r.rule_name, r.fingerprint, r.attempt_at, None if r.seq_text is None else int(r.seq_text), st))
            yield pd.DataFrame(out, columns=[f.name for f in LIVE_SCHEMA.fields])

    return d.mapInPandas(run, LIVE_SCHEMA)


def recorded_runs(spark: SparkSession, log: str) -> list[str]:
    """Runs of :func:`deliver_and_record` that were committed, in the order of their names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(log)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{log}/run=*/_SUCCESS")) or []
    return sorted(s.getPath().getParent().getName()[len("run="):] for s in found)


def read_attempts(spark: SparkSession, log: str, runs: list[str] | None = None) -> DataFrame:
    """The attempt log (K3): rows of the committed runs, or of some of them."""
    runs = recorded_runs(spark, log) if runs is None else runs
    if not runs:
        return spark.createDataFrame([], schemas.ATTEMPTS)
    return spark.read.schema(schemas.ATTEMPTS).parquet(*[f"{log}/run={r}" for r in runs])


def deliver_and_record(decisions: DataFrame, deliver: Callable[[str, str, str, str], bool], log: str, run: str,
                       seed: DataFrame | None = None, now: str = "observed_at") -> DataFrame:
    """K1 and K3 in one job with a commit: calls ``deliver(receiver, url, payload, key)`` and records every attempt
    once under ``log``; returns the run's attempts.

    The tasks that make the calls write the attempts themselves, under Spark's file commit: of several attempts of one
    task only the committed one counts, and a run that fails leaves no row. Such a run is made again under the same
    idempotency keys. A run that was committed is returned as recorded, without a call. Earlier runs of the log are the
    history, before ``seed`` (rule_name, fingerprint, status) for keys the log does not know. ``run`` may hold letters,
    digits, ``.``, ``_`` and ``-``; runs of one log are made one after the other.
    """
    from alertflow.operators.delivery import KEY, notification_snapshot

    if not run or not set(run) <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-"):
        raise ValueError(f"bad run name {run!r}")
    spark, log = decisions.sparkSession, log.rstrip("/")
    runs = recorded_runs(spark, log)
    if run not in runs:
        known = notification_snapshot(read_attempts(spark, log, runs)).select(*KEY, "status")
        if seed is not None:
            known = known.unionByName(seed.select(*KEY, "status").join(known, KEY, "left_anti"))
        # history of this run's keys only
        known = known.join(decisions.select(*KEY), KEY, "left_semi")
        live_deliver(decisions, deliver, known, now, keyed=True).write.mode("overwrite").parquet(f"{log}/run={run}")
    return read_attempts(spark, log, [run])
