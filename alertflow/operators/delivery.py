"""Delivery de-duplication state machine.

Per ``(rule_name, fingerprint)`` the reference sends a push unless the last
recorded status equals the desired one, and records ``desired`` on success
or its ``-failed`` form on failure. Over an ordered log of pushes this is:

    a row with desired status d is delivered  <=>
    no earlier row with desired d and a successful call comes after the
    last earlier row whose desired status differs from d

(each maximal run of equal ``desired`` starts with an attempt and stops
attempting after its first success; a failure is retried by the next push).
With two desired values it needs four running maxima of the ordering key,
all "strictly before this row":

    last_ok[d]     latest earlier row with desired d and a successful call
    last_other[d]  latest earlier row with the other desired value

An ordinary key is one window partition: one exchange, one sort. Running
maxima are associative, so a hot key does not need one task: its rows are
range-partitioned by (key, order) with sampled bounds into slices of about
``target_rows`` rows, whatever their times, and each slice adds the carried
maxima of all earlier slices of its key (a second, much smaller window over
one summary row per slice). Prior history enters as one seed row per key that
sorts before everything else. Rows of equal order count by desired status,
then outcome, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertflow.functions.labels import broadcast_if_small
from alertflow.session import materialize
from alertflow.functions.status import (FIRING_FAILED, FIRING_SENT, ORDER_KEY_MIN, RESOLVED_FAILED, RESOLVED_SENT,
                                       desired_status, failed_status, order_key)

KEY = ["rule_name", "fingerprint"]
STATUS_VALUES = [FIRING_SENT, FIRING_FAILED, RESOLVED_SENT, RESOLVED_FAILED]
DEFAULT_CHUNK_SECONDS = 3600  # for callers that want fixed time slices
HOT_KEY_ROWS = 1_000_000      # a key with more rows is cut into slices
HOT_CHUNK_ROWS = 1_000_000    # about this many rows per slice of a hot key
_SEED_CHUNK = -(1 << 31)
_SEED_POS = -(1 << 62)


def _maxes(desired: Column, ok: Column, ordk: Column) -> list[Column]:
    fir = desired == FIRING_SENT
    res = desired == RESOLVED_SENT
    return [F.when(fir & ok, ordk), F.when(res & ok, ordk), F.when(fir, ordk), F.when(res, ordk)]


_NAMES = ["ok_f", "ok_r", "any_f", "any_r"]


def _hot_keys(counts: DataFrame, hot_rows: int) -> tuple[DataFrame | None, int]:
    """Keys with more than ``hot_rows`` rows (at most rows / hot_rows of them) and their number of rows; None if there
    are none. ``counts`` has the key columns and their rows ``_n``, or is itself the rows to count."""
    per_key = F.sum("_n") if "_n" in counts.columns else F.count(F.lit(1))
    stats = counts.groupBy(*KEY).agg(per_key.alias("_n")).where(F.col("_n") > hot_rows)
    n_rows = stats.agg(F.sum("_n")).first()[0]
    if not n_rows:
        return None, 0
    return broadcast_if_small(materialize(stats.select(*KEY))), n_rows


def _seed_rows(seed: DataFrame, keys: DataFrame) -> DataFrame:
    """The history of ``keys``, one row per key before all others."""
    return seed.join(keys.select(*KEY).distinct(), KEY, "left_semi").select(
        *KEY,
        F.when(F.col("status").startswith("resolved"), F.lit(RESOLVED_SENT))
         .otherwise(F.lit(FIRING_SENT)).alias("desired"),
        F.col("status").endswith("-sent").alias("_ok"),
        F.lit(ORDER_KEY_MIN).cast("decimal(38,0)").alias("_ord"),
        F.lit(_SEED_CHUNK).cast("long").alias("_chunk"),
        F.lit(True).alias("_seed"))


def _order(*keys: str):
    return Window.partitionBy(*keys).orderBy("_ord", "desired", "_ok")


def _decide(rows: DataFrame, cols: list[str], g: dict) -> DataFrame:
    """Plan columns from the running maxima strictly before each row."""
    fir = F.col("desired") == FIRING_SENT
    last_ok = F.when(fir, g["ok_f"]).otherwise(g["ok_r"])
    last_other = F.when(fir, g["any_r"]).otherwise(g["any_f"])
    deliver = last_ok.isNull() | (last_other.isNotNull() & (last_ok < last_other))
    status = F.when(deliver, F.when(F.col("_ok"), F.col("desired")).otherwise(failed_status(F.col("desired"))))
    return rows.where(~F.col("_seed")).select(*cols, "desired", deliver.alias("deliver"), status.alias("status"))


def _one_pass(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Whole keys: both windows share one exchange and one sort."""
    w = _order(*KEY)
    rows = rows.withColumn("_pos", F.row_number().over(w))
    m = _maxes(F.col("desired"), F.col("_ok"), F.col("_pos"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", *[F.max(x).over(before).alias(f"_l_{n}") for x, n in zip(m, _NAMES)])
    return _decide(local, cols, {n: F.col(f"_l_{n}") for n in _NAMES})


def _sliced(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Keys cut into slices (``_chunk``, in order)."""
    # position of each row in its key's order, as one long: chunk * 2**31 +
    # row number inside the chunk (both windows share one sort)
    w_pos = _order(*KEY, "_chunk")
    rows = rows.withColumn(
        "_pos", F.when(F.col("_seed"), F.lit(_SEED_POS))
        .otherwise(F.col("_chunk") * F.lit(1 << 31) + F.row_number().over(w_pos)))
    m = _maxes(F.col("desired"), F.col("_ok"), F.col("_pos"))
    w_local = w_pos.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", *[F.max(x).over(w_local).alias(f"_l_{n}") for x, n in zip(m, _NAMES)])

    # one summary row per (key, chunk) from the already partitioned rows,
    # then the maxima carried over from all earlier chunks of the key
    totals = local.groupBy(*KEY, "_chunk").agg(*[F.max(x).alias(f"_t_{n}") for x, n in zip(m, _NAMES)])
    w_chunks = Window.partitionBy(*KEY).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*KEY, "_chunk",
                          *[F.max(f"_t_{n}").over(w_chunks).alias(f"_c_{n}") for n in _NAMES])
    both = local.join(carry, [*KEY, "_chunk"], "inner")
    return _decide(both, cols, {n: F.greatest(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in _NAMES})


def hot_slices(rows: DataFrame, n_rows: int, target_rows: int) -> DataFrame:
    """Rows of hot keys with ``_chunk``: the range partition of (key, order) that holds them. Written once, as two
    branches read it and both must see the same slices."""
    n = max(2, -(-n_rows // target_rows))
    dealt = rows.repartitionByRange(n, *KEY, "_ord", "desired", "_ok")
    return materialize(dealt.withColumn("_chunk", F.spark_partition_id().cast("long")))


def delivery_plan(decisions: DataFrame, ok: Column | str = "call_ok", seed: DataFrame | None = None,
                  now: str = "observed_at", order: tuple = ("observed_at", "seq"),
                  chunk_seconds: int | None = None, hot_rows: int = HOT_KEY_ROWS,
                  target_rows: int = HOT_CHUNK_ROWS, keys: DataFrame | None = None,
                  most_rows: int | None = None) -> DataFrame:
    """Every decision row with ``desired``, ``deliver`` and the recorded
    ``status`` of the attempt (NULL when skipped).

    ``decisions`` needs ``rule_name, fingerprint, ends_at`` and the order
    columns; ``ok`` is the call outcome (known in a replay or simulation).
    ``seed`` is a ``notifications`` snapshot (rule_name, fingerprint, status)
    holding the history before the first row; only keys of ``decisions`` are
    taken from it.

    With ``chunk_seconds`` every key is cut into fixed time slices; by default
    keys are whole, and only those with more than ``hot_rows`` rows are cut
    into slices of about ``target_rows`` rows. ``keys`` is a small table of the
    keys (a superset will do) with an upper bound ``_n`` of each one's rows, such
    as the label sets' counts times the rules they hit; with it neither the hot
    keys nor the seeds need a second evaluation of ``decisions``; ``most_rows``
    bounds the rows of every key, so that a table without hot keys is not asked.
    """
    okc = F.col(ok) if isinstance(ok, str) else ok
    cols = decisions.columns
    rows = decisions.select(
        *cols,
        desired_status("ends_at", now).alias("desired"),
        F.coalesce(okc, F.lit(False)).alias("_ok"),
        order_key(order[0], order[1]).alias("_ord"),
        F.lit(False).alias("_seed"))

    def seeded(part: DataFrame, of: DataFrame) -> DataFrame:
        return part if seed is None else part.unionByName(_seed_rows(seed, of), allowMissingColumns=True)

    known = rows if keys is None else keys

    if chunk_seconds:
        chunk = F.floor(F.unix_micros(F.col(order[0])) / F.lit(chunk_seconds * 1_000_000))
        return _sliced(seeded(rows.withColumn("_chunk", chunk), known), cols)
    hot, n_rows = (None, 0) if most_rows is not None and most_rows <= hot_rows else _hot_keys(known, hot_rows)
    if hot is None:
        return _one_pass(seeded(rows, known), cols)
    cold = _one_pass(seeded(rows.join(hot, KEY, "left_anti"), known.join(hot, KEY, "left_anti")), cols)
    sliced = hot_slices(rows.join(hot, KEY, "left_semi").select(*rows.columns), n_rows, target_rows)
    return cold.unionByName(_sliced(seeded(sliced, hot), cols))


def attempts(plan: DataFrame, at: str = "observed_at", seq: str = "seq") -> DataFrame:
    """K3: the attempt log (rows that were delivered)."""
    return plan.where("deliver").select(
        *KEY, F.col(at).alias("attempt_at"), F.col(seq).alias("seq"), "status")


def notification_snapshot(attempt_log: DataFrame) -> DataFrame:
    """Last attempt per (rule_name, fingerprint). The status is coded
    as a small int and the order key is fixed width, so this is a hash
    aggregate with partial aggregation (a hot key is pre-reduced map-side)."""
    ordk = order_key("attempt_at", "seq")
    codes = F.array(*[F.lit(x) for x in STATUS_VALUES])
    code = F.array_position(codes, F.col("status"))
    g = attempt_log.groupBy(*KEY).agg(F.max_by("attempt_at", ordk).alias("sent_at"),
                                      F.max_by(code, ordk).alias("_code"))
    return g.select(*KEY, "sent_at", F.get(codes, (F.col("_code") - 1).cast("int")).alias("status"))


def last_attempt(decisions: DataFrame, notifications: DataFrame) -> DataFrame:
    """Previous status per decision (NULL when none)."""
    n = notifications.select(*KEY, F.col("status").alias("prev_status"))
    return decisions.join(n, KEY, "left")


def already_delivered(prev_status: Column, desired: Column) -> Column:
    """Skip predicate of one push against the recorded status."""
    return F.coalesce(prev_status == desired, F.lit(False))
