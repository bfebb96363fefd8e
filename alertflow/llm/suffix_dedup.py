"""Removal of repeated passages with a distributed, sparse suffix array.

A byte is removed if a ``SPAN``-byte string that covers it also starts
somewhere else, in the same text or in another. Sorting one suffix per byte
would move many times the corpus, so suffixes are taken at anchors: in every
``SPAN``-byte string the ``GRAM``-byte gram with the least hash. Equal strings
have the same anchor, so they can only be found at suffixes that begin with
the same gram. An anchor stands for the run of string starts that chose it.

A suffix is written as three tokens: its first eight bytes as they are, a code
of the bytes that all strings of the run share (the core), and a code of the
whole stretch that they cover. So suffixes are in the order of their text for
eight bytes and of their codes beyond, where only equality matters for what is
removed; moving all leading bytes would move several times the corpus.
Splitters sampled from the first level range-partition the suffixes by their
leading tokens (row and place break ties, so one passage of a third of all
rows is spread over many buckets), and every bucket is sorted by multikey
quicksort. Neighbours are compared: a run whose core stands alone is unique; one whose whole stretch has
an equal neighbour is repeated; any other run is cut into runs of ``STEP``
starts and finally into single starts, and goes through the same again, with
one witness for each repeated stretch that others share a core with. Runs at
the ends of a bucket count as undecided, and the last level compares the ends
of neighbouring buckets (one row per end, so bounded by the partitions).

Codes are 64-bit polynomial hashes with independent byte tables; a repetition
is only accepted on 128 equal bits. The number of buckets follows from the
number of runs (``RUNS_PER_BUCKET``), so a bucket's memory does not grow with
the corpus. The splitter sample (about 100 runs a bucket, a million at most,
from about 20 documents a bucket) balances buckets and has no part in results.

Defined cases: null text is empty; texts shorter than ``SPAN`` lose nothing;
rows with equal texts repeat each other, also under one id; a null id is
returned as it is; strings are judged on the input, not on what is left; an
empty table gives an empty result; extra columns are ignored. Rows are
numbered once and written with their texts before the first level, as a later
read of the input may be split otherwise (files are packed by the live cores)
and number them differently.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from alertflow.llm.common import mix64, read_table, staged

SPAN, GRAM, STEP = 200, 100, 8
#: String starts handled at once in a long text.
CHUNK = 1 << 20
#: Runs that one bucket sorts in memory (48 bytes each), and as many as make a bucket of its own worth while.
RUNS_PER_BUCKET, LEAST_RUNS = 500_000, 20_000
#: Segments up to this size are finished by a library sort.
SMALL = 4096

_RNG = np.random.default_rng(20240501)
_TABLES = [_RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_P = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_INV = [np.uint64(pow(int(p), -1, 1 << 64)) for p in _P]
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses, for places below ``n``."""
    global _powers
    if not _powers or len(_powers[0][0]) < n:
        size = max(n, 1 << 16)
        _powers = [tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (p, q))
                   for p, q in zip(_P, _INV, strict=True)]
    return _powers


class SpanHash:
    """Codes of any spans of one stretch of bytes, by prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, which: int):
        power, self.inverse = _tables(len(data) + 1)[which]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLES[which][data] * power[:len(data)], dtype=np.uint64)])

    def __call__(self, first, end) -> np.ndarray:
        return (self.sums[end] - self.sums[first]) * self.inverse[first]


def anchors(code: np.ndarray) -> np.ndarray:
    """For every string start, the place of the gram with the least hash in it (leftmost of equals)."""
    width = SPAN - GRAM + 1
    place = np.arange(len(code), dtype=np.uint64)
    least = (code >> np.uint64(22) << np.uint64(22)) | place
    size = 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:len(code) - width + 1], least[width - size:][:len(code) - width + 1])
    return (least & np.uint64((1 << 22) - 1)).astype(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(mix64(x).view(np.int64))


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers that are ordered as the bytes are."""
    token = np.zeros(len(at), np.uint64)
    for i in range(8):
        token = token << np.uint64(8) | data[at + i].astype(np.uint64)
    return (token ^ np.uint64(1 << 63)).view(np.int64)


def first_runs(data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of string starts by anchor: lo, hi, anchor, leading token, core code, stretch code."""
    for base in range(0, len(data) - SPAN + 1, CHUNK):
        part = data[base:base + CHUNK + SPAN - 1]
        one, two = SpanHash(part, 0), SpanHash(part, 1)
        at = np.arange(len(part) - GRAM + 1)
        gram = mix64(one(at, at + GRAM))
        chosen = anchors(gram)
        lo = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        hi = np.concatenate([lo[1:] - 1, [len(chosen) - 1]])
        a = chosen[lo]
        stretch = two(lo, hi + SPAN) + ((a - lo).astype(np.uint64) << np.uint64(32)) + (hi - lo).astype(np.uint64)
        yield lo + base, hi + base, a + base, leading(part, a), gram[a], stretch


def cut_runs(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, a: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The runs cut into runs of ``step`` starts, aligned to their anchor."""
    order = np.argsort(lo, kind="stable")
    lo, hi, a = lo[order], hi[order], a[order]
    first, last = (lo - a) // step, (hi - a) // step
    count = last - first + 1
    which = np.repeat(np.arange(len(lo)), count)
    q = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[which]
    sub_a = a[which]
    sub_lo, sub_hi = np.maximum(lo[which], sub_a + q * step), np.minimum(hi[which], sub_a + q * step + step - 1)
    # what all starts of the aligned run share, also where a neighbouring anchor has taken some of them
    core_lo, core_end = sub_a + q * step + step - 1, sub_a + q * step + SPAN
    base = 0
    while base < len(sub_lo):
        origin = int(min(core_lo[base], sub_lo[base]))
        end = max(base + 1, int(np.searchsorted(sub_lo, origin + CHUNK)))
        at = slice(base, end)
        top = int(max((sub_hi[at] + SPAN).max(), core_end[at].max()))
        origin = int(min(sub_lo[at].min(), core_lo[at].min()))
        part = data[origin:top]
        one, two = SpanHash(part, 0), SpanHash(part, 1)
        core = one(core_lo[at] - origin, core_end[at] - origin) + (q[at] + SPAN).astype(np.uint64)
        stretch = (two(sub_lo[at] - origin, sub_hi[at] + SPAN - origin)
                   + ((sub_a[at] - sub_lo[at] + SPAN).astype(np.uint64) << np.uint64(32)) + (sub_hi[at] - sub_lo[at]).astype(np.uint64))
        yield sub_lo[at], sub_hi[at], sub_a[at], leading(part, core_lo[at] - origin), mix64(core), stretch
        base = end


#: ``shape`` holds what ``lo`` leaves open of a run: hi - lo in the upper bits, anchor - lo in the lower eight.
_RUNS = "row long, lo long, shape int, lead long, core long, stretch long"
_KEY = ["lead", "core", "stretch", "row", "lo"]


def _run_batch(row: int, lo, hi, a, lead, core, stretch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(lo), row, np.int64)), pa.array(lo.astype(np.int64)),
         pa.array(((hi - lo) << 8 | (a - lo)).astype(np.int32)), pa.array(lead), _signed(core), _signed(stretch)],
        names=[c.split()[0] for c in _RUNS.split(", ")])


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _key(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column(c).to_numpy() for c in _KEY]


def bucket_of(key: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """For every key (its parts in order) the number of splitters that are not above it."""
    low = np.searchsorted(splitters[0], key[0], "left")
    high = np.searchsorted(splitters[0], key[0], "right")
    left = np.flatnonzero(low < high)
    while len(left):
        mid = (low[left] + high[left]) // 2
        below, equal = np.zeros(len(left), bool), np.ones(len(left), bool)
        for k, s in zip(key, splitters, strict=True):
            below |= equal & (s[mid] < k[left])
            equal &= s[mid] == k[left]
        right = below | equal
        low[left[right]], high[left[~right]] = mid[right] + 1, mid[~right]
        left = left[low[left] < high[left]]
    return low


def _first_level(docs: DataFrame, splitters: list[np.ndarray] | None = None, rate: float = 1.0) -> DataFrame:
    """Runs of all documents: with their buckets if splitters are given, else a share ``rate`` of them."""
    def dealt(out: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = _joined(out)
        if splitters is not None:
            return b.append_column("bucket", pa.array(bucket_of(_key(b), splitters).astype(np.int32)))
        if rate < 1:
            drawn = mix64((b.column(0).to_numpy() * 1_000_003 + b.column(1).to_numpy()).view(np.uint64))
            b = b.take(pa.array(np.flatnonzero(drawn < np.uint64(int(rate * (1 << 63)) * 2))))
        return b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, rows = [], 0
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text or len(text) < SPAN:
                    continue
                for r in first_runs(np.frombuffer(text, np.uint8)):
                    out.append(_run_batch(row, *r))
                    rows += len(r[0])
                    if rows > 200_000:
                        yield dealt(out)
                        out, rows = [], 0
            if out:
                yield dealt(out)

    schema = _RUNS if splitters is None else _RUNS + ", bucket int"
    return docs.select("row", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _buckets(spark: SparkSession, runs: int) -> int:
    """As many as bound a bucket's memory, and up to the session's number of shuffle partitions where runs are few."""
    return max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), runs // LEAST_RUNS + 1), runs // RUNS_PER_BUCKET + 1)


def _first_buckets(docs: DataFrame) -> DataFrame:
    """Runs of all documents, range-partitioned by sampled splitters: hashed once, but for the sample."""
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    runs = 2 * size // (SPAN - GRAM + 2)  # what a least hash in windows of that many grams makes of random text
    n = _buckets(docs.sparkSession, runs)
    wanted = min(100 * n, 1_000_000)
    share = min(1.0, max(2000, 20 * n) / max(1, rows))
    taken = docs if share == 1 else docs.sample(share, seed=11)
    sample = _first_level(taken, rate=min(1.0, wanted / max(1.0, share * runs))).select(*_KEY).toArrow()
    key = [sample.column(c).to_numpy() for c in _KEY]
    order = np.lexsort(key[::-1])
    at = order[(np.arange(1, n) * len(order)) // n] if len(order) else order
    return _first_level(docs, [k[at] for k in key]).repartitionById(n, F.col("bucket")).drop("bucket")


def _next_level(docs: DataFrame, undecided: DataFrame, step: int) -> DataFrame:
    """The undecided runs cut finer, range-partitioned. A document's list of runs is at most twice its text."""
    starts = undecided.agg(F.sum(F.expr(f"(shape >> 8) div {step} + 2"))).first()[0] or 0
    lists = undecided.groupBy("row").agg(F.collect_list(F.struct("lo", "shape")).alias("runs"))
    joined = docs.join(lists, "row").select("row", F.col("text").cast("binary").alias("text"), "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, rows = [], 0
            for i, (row, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                runs = b.column(2)[i].values
                lo, shape = (runs.field(k).to_numpy().astype(np.int64) for k in range(2))
                for r in cut_runs(np.frombuffer(text, np.uint8), lo, lo + (shape >> 8), lo + (shape & 255), step):
                    out.append(_run_batch(row, *r))
                    rows += len(r[0])
                    if rows > 200_000:
                        yield _joined(out)
                        out, rows = [], 0
            if out:
                yield _joined(out)

    return joined.mapInArrow(run, _RUNS).repartitionByRange(_buckets(docs.sparkSession, starts), *_KEY)


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """Order of the suffixes by multikey quicksort: a segment is split at one of its tokens into less, equal and
    greater; only the equal part goes on to the next token."""
    order = np.arange(len(tokens[0]))
    left = [(0, len(order), 0)]
    while left:
        first, end, depth = left.pop()
        part = order[first:end]
        if len(part) <= SMALL:
            order[first:end] = part[np.lexsort([t[part] for t in tokens[:depth - 1 if depth else None:-1]])]
            continue
        token = tokens[depth][part]
        drawn = np.sort(token[np.linspace(0, len(part) - 1, 63).astype(np.int64)])
        pivot = drawn[len(drawn) // 2]
        less, greater = token < pivot, token > pivot
        same = part[~(less | greater)]
        a, b = first + int(less.sum()), end - int(greater.sum())
        order[first:end] = np.concatenate([part[less], same, part[greater]])
        left += [(x, y, d) for x, y, d in ((first, a, depth), (a, b, depth + 1), (b, end, depth)) if y - x > 1 and d < len(tokens)]
    return order


#: Verdicts on a run: to be cut further, repeated; ends of a bucket (first, last) at the last level.
_CUT, _REPEATED, _FIRST, _LAST = 1, 2, 3, 4


def _verdicts(lead: np.ndarray, core: np.ndarray, stretch: np.ndarray, last_level: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted suffixes: which are repeated, which have to be cut."""
    n = len(core)
    new_core = np.concatenate([[True], (lead[1:] != lead[:-1]) | (core[1:] != core[:-1])])
    new_both = new_core | np.concatenate([[True], stretch[1:] != stretch[:-1]])
    repeated = ~new_both | np.concatenate([~new_both[1:], [False]])
    if last_level:
        return repeated, np.zeros(n, bool)
    core_of = np.cumsum(new_core) - 1
    kinds = np.bincount(core_of, weights=new_both)
    mixed = kinds > 1
    mixed[[0, -1]] = True  # more of the first and the last core may lie in the neighbouring buckets
    return repeated, mixed[core_of] & new_both


def _decide(buckets: DataFrame, last_level: bool) -> DataFrame:
    """row, lo, shape, verdict (and for ends: bucket and tokens) of range-partitioned runs."""
    schema = "row long, lo long, shape int, verdict int, bucket int, lead long, core long, stretch long"

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, whole = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if not whole:
            return
        columns = [np.concatenate([b.column(i).to_numpy() for b in whole]) for i in range(6)]
        del whole
        order = multikey_order(columns[3:])
        row, lo, shape, *tokens = (c[order] for c in columns)
        repeated, cut = _verdicts(*tokens, last_level)
        ends = [(np.array([0]), _FIRST), (np.array([len(row) - 1]), _LAST)] if last_level else []
        for at, verdict in [(np.flatnonzero(repeated), _REPEATED), (np.flatnonzero(cut), _CUT), *ends]:
            none = np.ones(len(at), bool) if verdict < _FIRST else None
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c[at]) for c in (row, lo, shape)), pa.array(np.full(len(at), verdict, np.int32)),
                 pa.array(np.full(len(at), pid, np.int32)), *(pa.array(t[at], mask=none) for t in tokens)],
                names=[c.split()[0] for c in schema.split(", ")])

    return buckets.mapInArrow(bucket, schema)


def _across_buckets(decided: DataFrame) -> DataFrame:
    """Single starts at the ends of neighbouring buckets that are equal; two rows per bucket come to the driver."""
    ends = decided.filter(F.col("verdict") >= _FIRST).orderBy("bucket", "verdict").toArrow().to_pylist()
    equal = [(x["row"], x["lo"], x["shape"]) for a, b in zip(ends, ends[1:], strict=False)
             if a["bucket"] != b["bucket"] and all(a[c] == b[c] for c in _KEY[:3]) for x in (a, b)]
    return decided.sparkSession.createDataFrame(equal, "row long, lo long, shape int")


def repeated_starts(docs: DataFrame) -> DataFrame:
    """row, lo, hi: runs of starts of ``SPAN``-byte strings that also start elsewhere. ``docs``: row, text."""
    found, runs = [], _first_buckets(docs)
    for step in (STEP, 1, None):
        decided = staged(_decide(runs, step is None), "suffix-level")
        found.append(decided.filter(F.col("verdict") == _REPEATED).select("row", "lo", "shape"))
        if step is None:
            found.append(_across_buckets(decided))
        else:
            runs = _next_level(docs, decided.filter(F.col("verdict") == _CUT), step)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.select("row", "lo", F.expr("lo + (shape >> 8)").alias("hi"))


def removed_spans(starts: DataFrame) -> DataFrame:
    """row, spans: the maximal removed spans (first byte, end) in order. Runs are merged as they stream by row and
    place, so a document's list has at most one entry per ``SPAN`` bytes."""
    by_place = Window.partitionBy("row").orderBy("lo")
    before = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    runs = starts.select("row", "lo", (F.col("hi") + SPAN).alias("end")).withColumn(
        "opens", F.coalesce(F.col("lo") > before, F.lit(True)).cast("long"))
    spans = runs.withColumn("span", F.sum("opens").over(by_place.rowsBetween(Window.unboundedPreceding, 0))).groupBy(
        "row", "span").agg(F.min("lo").alias("first"), F.max("end").alias("end"))
    return spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans (first byte, end)."""
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias(id_col),
                              F.col(text_col).alias("text")), "suffix-rows")
    spans_of = removed_spans(repeated_starts(rows.select("row", "text")))
    joined = rows.join(spans_of, "row", "left").select(id_col, F.col("text").cast("binary").alias("text"), "spans")
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text, spans = text or b"", spans or []
                kept, at = hashlib.sha256(), 0
                for s in spans:
                    kept.update(text[at:s["first"]])
                    at = s["end"]
                kept.update(text[at:])
                out.append((len(text), sum(s["end"] - s["first"] for s in spans), len(spans), kept.hexdigest(), spans))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([o[i] for o in out], t) for i, t in enumerate(
                    (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind)))],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                  "spans array<struct<first:bigint,end:bigint>>")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("spans")
