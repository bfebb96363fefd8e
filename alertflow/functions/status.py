"""Status, time and text column functions.

Time is always passed in: a column (``observed_at`` in a replay) or a
literal (``as_of`` in a listing). Intervals follow the reference exactly:
an alert is resolved when ``ends_at <= now``; a mute is active on the closed
interval ``[starts_at, ends_at]``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Notification status texts and the zero time of the source.
FIRING_SENT = "firing-sent"
FIRING_FAILED = "firing-failed"
RESOLVED_SENT = "resolved-sent"
RESOLVED_FAILED = "resolved-failed"
ZERO_TIME = "0001-01-01 00:00:00"
DISPLAY_FORMAT = "yyyy-MM-dd HH:mm:ss"
FORM_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_time(now) -> Column:
    """Accept a column name, a Column, a datetime or an ISO text."""
    if isinstance(now, Column):
        return now
    if isinstance(now, _dt.datetime):
        return F.lit(now).cast("timestamp")
    if isinstance(now, str) and (now[:1].isdigit()):
        return F.lit(now).cast("timestamp")
    return F.col(now)


def is_resolved(ends_at, now) -> Column:
    """Closed at now: ``ends_at`` set and ``ends_at <= now``."""
    e = _col(ends_at)
    return e.isNotNull() & (e <= as_time(now))


def alert_status(ends_at, now) -> Column:
    """firing / resolved."""
    return F.when(is_resolved(ends_at, now), F.lit("resolved")).otherwise(F.lit("firing"))


def desired_status(ends_at, now) -> Column:
    """the status recorded when the upcoming attempt succeeds."""
    return F.when(is_resolved(ends_at, now), F.lit(RESOLVED_SENT)).otherwise(F.lit(FIRING_SENT))


def failed_status(status) -> Column:
    """sent -> failed, other values unchanged."""
    s = _col(status)
    return (F.when(s == FIRING_SENT, F.lit(FIRING_FAILED))
            .when(s == RESOLVED_SENT, F.lit(RESOLVED_FAILED))
            .otherwise(s))


def observed_status(ends_at, now) -> Column:
    """firing / expired for stored alerts."""
    return F.when(is_resolved(ends_at, now), F.lit("expired")).otherwise(F.lit("firing"))


def mute_active(starts_at, ends_at, now) -> Column:
    """F8: closed interval at both ends."""
    t = as_time(now)
    return (_col(starts_at) <= t) & (t <= _col(ends_at))


def mute_status(starts_at, ends_at, now) -> Column:
    """pending / expired / active, tested in this order."""
    t = as_time(now)
    return (F.when(t < _col(starts_at), F.lit("pending"))
            .when(t > _col(ends_at), F.lit("expired"))
            .otherwise(F.lit("active")))


def zero_time_to_null(ts) -> Column:
    """the source's zero time means 'not set'."""
    c = _col(ts)
    return F.when(c <= F.lit(ZERO_TIME).cast("timestamp"), F.lit(None).cast("timestamp")).otherwise(c)


def parse_duration_ms(text) -> Column:
    """sum of ``(\\d+)([smhd])`` groups in milliseconds; zero -> NULL."""
    t = F.coalesce(_col(text), F.lit(""))
    nums = F.regexp_extract_all(t, F.lit(r"(\d+)([smhd])"), 1)
    units = F.regexp_extract_all(t, F.lit(r"(\d+)([smhd])"), 2)
    scale = lambda u: (F.when(u == "s", F.lit(1000)).when(u == "m", F.lit(60000))
                       .when(u == "h", F.lit(3600000)).otherwise(F.lit(86400000)))
    parts = F.zip_with(nums, units, lambda n, u: n.try_cast("long") * scale(u))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(total > 0, total)


def format_duration(ms) -> Column:
    """days, hours, minutes (seconds dropped); ``0m`` when all are zero."""
    m = _col(ms).cast("long")
    days = F.floor(m / 86400000)
    rest = m - days * 86400000
    hours = F.floor(rest / 3600000)
    rest2 = rest - hours * 3600000
    minutes = F.floor(rest2 / 60000)
    part = lambda v, u: F.when(v != 0, F.concat(v.cast("string"), F.lit(u)))
    out = F.concat_ws("", part(days, "d"), part(hours, "h"), part(minutes, "m"))
    return F.when(out == "", F.lit("0m")).otherwise(out)


def parse_form_time(text) -> Column:
    """F16: ``yyyy-MM-ddTHH:mm`` as UTC; unparsable -> NULL (then rejected)."""
    return F.try_to_timestamp(_col(text), F.lit(FORM_TIME_FORMAT))


def display_time(ts) -> Column:
    """display format in the session zone (UTC)."""
    return F.date_format(_col(ts), DISPLAY_FORMAT)


def is_blank(text) -> Column:
    """empty or only Unicode white space (NULL counts as blank)."""
    t = _col(text)
    return t.isNull() | t.rlike(r"(?U)^\s*$")


def mute_id(*cols) -> Column:
    """32 hex digits. Deterministic over the request's canonical
    fields so that a re-run writes the same ids (the reference draws random
    ids; determinism is the idempotent choice for batch imports)."""
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols]))


# Processing order (time, seq) as one fixed-width value: micros * 10**20 +
# (seq + 2**63). Exact for every timestamp and 64-bit seq, and a decimal(38,0)
# is a mutable aggregation buffer, so max_by/min_by over it hash-aggregate
# (a struct order key would force a sort-based aggregate).
_ORDER_SCALE = "100000000000000000000"
_SEQ_OFFSET = "9223372036854775808"
ORDER_KEY_MIN = "-99999999999999999999999999999999999999"


def order_key(ts, seq) -> Column:
    """Exact ``(ts, seq)`` order as ``decimal(38,0)``; a NULL seq sorts first."""
    d = "decimal(38,0)"
    micros = F.unix_micros(_col(ts)).cast(d)
    sq = F.coalesce(_col(seq).cast(d) + F.lit(_SEQ_OFFSET).cast(d), F.lit(0).cast(d))
    return (micros * F.lit(_ORDER_SCALE).cast(d) + sq).cast(d)
