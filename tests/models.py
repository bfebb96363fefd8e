"""Small sequential Python models of the reference's behaviour, used as the
ground truth in randomised tests. They follow the loops of the original
service one alert at a time."""

from __future__ import annotations

FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
MASK64 = (1 << 64) - 1


def fingerprint(labels: dict) -> str:
    h = FNV_OFFSET
    for k in sorted(labels, key=lambda s: s.encode("utf-8")):
        for part in (k, labels[k]):
            for b in part.encode("utf-8") + b"\xff":
                h ^= b
                h = (h * FNV_PRIME) & MASK64
    return f"{h:016x}"


def match_all(conds: dict | None, labels: dict) -> bool:
    return all(labels.get(k, "") == v for k, v in (conds or {}).items())


def contains(labels: dict, matchers: dict | None) -> bool:
    return all(k in labels and labels[k] == v for k, v in (matchers or {}).items())


def evaluate(rules, labels: dict) -> list:
    """rules: list of (name, match, receiver, cont) -> decided rule indexes."""
    out = []
    for i, (_, match, _, cont) in enumerate(rules):
        if not match_all(match, labels):
            continue
        out.append(i)
        if not cont:
            break
    return out


def desired(ends_at, now) -> str:
    return "resolved-sent" if (ends_at is not None and ends_at <= now) else "firing-sent"


def process(rows, history=None):
    """rows: iterable of (key, ord, desired, ok) in any order.
    Returns {ord: status or None} following the per-key sequential loop."""
    hist = dict(history or {})
    out = {}
    for key, ordk, des, ok in sorted(rows, key=lambda r: r[1]):
        prev = hist.get(key)
        if prev is not None and prev == des:
            out[ordk] = None
            continue
        st = des if ok else des.replace("-sent", "-failed")
        hist[key] = st
        out[ordk] = st
    return out, hist


def upsert(pushes):
    """pushes: (ord, fp, labels, starts_at, ends_at, seen_at) -> state per fp."""
    st = {}
    for ordk, fp, labels, starts, ends, seen in sorted(pushes, key=lambda r: r[0]):
        if fp not in st:
            st[fp] = dict(labels=labels, starts_at=starts, ends_at=ends, first_seen_at=seen, last_seen_at=seen)
        else:
            st[fp].update(labels=labels, ends_at=ends, last_seen_at=seen)
    return st
