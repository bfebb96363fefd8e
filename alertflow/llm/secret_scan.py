"""Secret scans: fixed patterns, and windows of high entropy in candidate strings.

``assign``, ``access`` and ``hex`` are the leftmost non-overlapping matches of
fixed patterns; a match that is too short is dropped and nothing inside it is
looked at again. The method adds spans of the kind ``entropy``: candidate
strings are the maximal runs of a character class (base64, alphanumeric,
hexadecimal, digits), and over each a window of fixed length slides whose
symbol counts change by one character in and one out, so that its Shannon
entropy is carried along in constant time per character. Runs of windows at or
above the class's threshold make one span. A class that holds all characters
of a span judges it: the narrowest one, as a window of hexadecimal digits
cannot reach the entropy of base64.

An allow-list suppresses entropy spans (never the fixed patterns): a candidate
string goes if it holds an allowed pattern, or if the characters before it end
in one. Spans that a fixed pattern already covers are not added.

Offsets are code points, ends exclusive. Every document is read once, on its
own, in bounded memory; nothing is shuffled.

Defined cases: a null text counts as empty; a null id stays null; repeated rows
each have their result; an empty table gives an empty result; columns of the
input other than id and text are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from alertflow.llm.common import read_table

#: Fixed kinds in the order in which equal starts are listed; the method's own kind comes last.
KINDS = ("assign", "access", "hex", "entropy")
#: Fixed patterns and the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


@dataclass(frozen=True)
class CharClass:
    """A character class, its window and the entropy (bits) from which a window counts."""
    name: str
    pattern: str
    window: int
    bits: float


#: From the narrowest class to the widest. The thresholds lie above what words, counters and repeated digits reach.
CLASSES = (
    CharClass("digits", r"[0-9]", 24, 3.25),
    CharClass("hex", r"[0-9a-fA-F]", 24, 3.3),
    CharClass("alnum", r"[A-Za-z0-9]", 24, 4.0),
    CharClass("base64", r"[A-Za-z0-9+/_=-]", 24, 4.1),
)

#: A candidate string that holds one of these is no secret.
ALLOW = (
    r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$",                # UUID
    r"(?i)example|placeholder|changeme|dummy|lorem|x{6}|0{8}|12345678|abcdefgh",
    r"^[A-Z]?[a-z]+$|^[A-Z]+$|^[a-z]+(?:[-_/][a-z]+)+$|^[A-Za-z][a-z]*(?:[A-Z][a-z]+)+$",  # words, joined words
    r"^[0-9]{1,4}(?:[-_/][0-9]+)+$",                                     # dates and numbered parts
)
#: Nor one whose ``BEFORE`` preceding characters end in one of these.
ALLOW_BEFORE = (
    r"(?i:sha(?:1|224|256|384|512)|md5|integrity)[\"'=: _-]{1,3}$",       # a digest that says so
    r"(?i:https?:|www\.)\S*$",                                           # part of an address
)
BEFORE = 32

_ONE = 1 << 32
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{min(c.window for c in CLASSES)},}}")

SPANS = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def hot_windows(candidate: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of windows whose entropy is ``bits`` or more.

    With counts c of the symbols in a window of W characters the entropy is log2 W - sum(c log2 c) / W; a step
    changes two counts, so the sum is carried along."""
    n = len(candidate)
    if n < window:
        return []
    # fixed-point, so that no rounding gathers along a long candidate
    part = [0] + [round(c * math.log2(c) * _ONE) for c in range(1, window + 1)]
    most = round(window * (math.log2(window) - bits) * _ONE)  # of the sum, for a window that counts
    counts: dict[str, int] = {}
    total = 0
    out: list[tuple[int, int]] = []
    for i, ch in enumerate(candidate):
        c = counts.get(ch, 0)
        total += part[c + 1] - part[c] if c < window else 0
        counts[ch] = c + 1
        if i >= window:
            gone = candidate[i - window]
            c = counts[gone]
            total += part[c - 1] - part[c] if c <= window else 0
            counts[gone] = c - 1
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


class Scanner:
    """The method with its parameters; compiled once per task."""

    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW,
                 allow_before: tuple[str, ...] = ALLOW_BEFORE):
        self.classes = [(c, re.compile(c.pattern + "+")) for c in classes]
        self.allow = [re.compile(p) for p in allow]
        self.allow_before = [re.compile(p) for p in allow_before]

    def allowed(self, text: str, start: int, end: int) -> bool:
        before, candidate = text[max(0, start - BEFORE):start], text[start:end]
        return any(p.search(candidate) for p in self.allow) or any(p.search(before) for p in self.allow_before)

    def entropy_spans(self, text: str) -> list[tuple[int, int]]:
        """Spans of high entropy that no allowed pattern explains; non-overlapping, in order."""
        out = []
        for run in _RUN.finditer(text):
            start, candidate = run.start(), run[0]
            # the narrowest class that holds a whole candidate string judges it; a wider one may judge what lies around
            found: list[tuple[int, int]] = []
            judged: list[tuple[int, int]] = []
            for c, pattern in self.classes:
                for m in pattern.finditer(candidate):
                    if m.end() - m.start() < c.window or any(a <= m.start() and m.end() <= b for a, b in judged):
                        continue
                    judged.append((m.start(), m.end()))
                    if self.allowed(text, start + m.start(), start + m.end()):
                        continue
                    found += [(m.start() + a, m.start() + b) for a, b in hot_windows(m[0], c.window, c.bits)]
            for a, b in sorted(found):
                if out and start + a <= out[-1][1]:
                    out[-1] = (out[-1][0], max(out[-1][1], start + b))
                else:
                    out.append((start + a, start + b))
        return out

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(base, all) spans as (start, kind, end), sorted."""
        base = base_spans(text)
        added, i = [], 0
        covered = _merged(base)
        for a, b in self.entropy_spans(text):
            while i < len(covered) and covered[i][1] <= a:
                i += 1
            if i < len(covered) and covered[i][0] <= a and b <= covered[i][1]:
                continue  # a fixed pattern already has all of it
            added.append((a, 3, b))
        return base, sorted(base + added)


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES,
         allow: tuple[str, ...] = ALLOW, allow_before: tuple[str, ...] = ALLOW_BEFORE) -> DataFrame:
    """Per document: doc_id, counts by kind, base_sha256 (digest of the fixed patterns' spans) and all spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allow, allow_before)
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, texts = [], []
            for value in b.column("text"):
                base, found = scanner.spans(value.as_py() or "")
                for k, n in enumerate(counts):
                    n.append(sum(1 for s in found if s[1] == k))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                texts.append(_joined(found))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(n, pa.int64()) for n in counts], pa.array(digests, pa.string()),
                 pa.array(texts, pa.string())], names=[f.split()[0] for f in SPANS.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(run, SPANS)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", classes: tuple[CharClass, ...] = CLASSES,
           allow: tuple[str, ...] = ALLOW, allow_before: tuple[str, ...] = ALLOW_BEFORE) -> DataFrame:
    """``docs`` with every span of ``text_col`` (overlapping ones as one) replaced by ``mask``; same columns, null
    texts stay null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allow, allow_before)
        for b in batches:
            texts = []
            for value in b.column(at):
                text = value.as_py()
                if text:
                    parts, last = [], 0
                    for start, end in _merged(scanner.spans(text)[1]):
                        parts += [text[last:start], mask]
                        last = end
                    text = "".join(parts) + text[last:]
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, b.column(at).type) if i == at else b.column(i) for i in range(b.num_columns)],
                schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")
