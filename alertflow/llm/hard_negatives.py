"""Hard-negative mining over an inverted multi-index.

Vectors are scaled to integers and scored by their integer inner product. Both
halves of the vector get a codebook (k-means over the ``FIT_ROWS`` rows whose
hashes are lowest, a fixed bound); a pair of codewords is a cell, and every row
is indexed under its cell. Each codeword keeps its radius, the largest distance
of any indexed row's half to it, so a cell's score is at most the sum of two
half-score bounds ``<a, c> + |a| r``.

Consecutive cells make shards of about ``shard_rows`` rows, a large cell is cut
into several. For an anchor a heap walks two sorted lists of half bounds (the
multi-sequence walk) and so visits cells in falling order of their bounds. It
stops where no further cell can hold a row of the answer:

* positives: the bound is below the score of the last of the first rows;
* negatives: it is below the last score of every positive's window, or below
  the windows themselves. A cell wholly above the windows is passed over.

Anchors go to the shards of the cells they would visit, together with what is
certified so far. A first round visits each anchor's nearest ``SEED_ROWS`` rows
and certifies a score; the second visits every cell that can still reach it.
Results are exact, not approximate. An anchor block holds at most
``ANCHOR_BLOCK`` anchors, so a task's input is one bounded shard and one
bounded block whatever the data; a hot cell is many shards. Every task sends on
at most the requested rows per anchor and window.

Defined cases: rows with a null label, a null vector or a null or non-finite
component take no part; shorter vectors count as filled with zeros; a row with
a null id is no anchor and comes last among ties; rows that repeat an id are
rows of their own, also as anchors; components so large that scores could pass
2**55 are an error; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from alertflow.llm.common import read_table, staged
from alertflow.llm.features import bounded_sample

#: Fixed values of the registered query.
SCALE, ANCHOR_EVERY, FLIP_EVERY, N_LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES, LOW, HIGH, WHOLE = 5, 10, 30, 90, 100

FIT_ROWS, FIT_ROUNDS = 16_384, 12
MAX_CODEWORDS, ROWS_PER_CELL = 64, 256
SEED_ROWS = 1_024
ANCHOR_BLOCK = 16_384
_MAX_PRODUCT = 1 << 55  # so that percentages of a score fit into 64 bits
_NO_ID = np.iinfo(np.int64).max

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def scaled_rows(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id",
                vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows that take part: rid (a number of its own), vec_id, label, anchor and the integer components q."""
    v = F.col(vector_col).cast("array<double>")
    usable = label.isNotNull() & v.isNotNull() & F.forall(
        v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    # components beyond any supported size only have to stay beyond it
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(1e15)), F.lit(-1e15))))
    rows = vectors.filter(usable).select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                                         F.coalesce(is_anchor, F.lit(False)).alias("anchor"), whole.alias("q"))
    # numbered once: every later job must see the same numbers
    return staged(staged(rows, "index-rows").withColumn("rid", F.monotonically_increasing_id()), "index-rids")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


# ------------------------------------------------------------------ codebooks

def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Codewords of ``x`` (fixed start, Lloyd rounds); fewer than ``k`` when there are fewer distinct rows."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    rng = np.random.default_rng(11)
    centres = [distinct[rng.integers(len(distinct))]]
    near = ((x - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        total = near.sum()
        if total <= 0:
            break
        centres.append(x[rng.choice(len(x), p=near / total)])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(FIT_ROUNDS):
        at = _nearest(x, c)[0]
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword and the distance to it."""
    at = ((c ** 2).sum(1) - 2 * x @ c.T).argmin(1)
    return at, np.sqrt(((x - c[at]) ** 2).sum(1))


@dataclass
class Index:
    """Codebooks, radii and shards; of bounded size (at most MAX_CODEWORDS**2 cells)."""
    dim: int
    codes: tuple[np.ndarray, np.ndarray]
    wide: bool                      # scalar products need 64-bit integers instead of doubles
    radii: tuple[np.ndarray, np.ndarray] | None = None
    cells: np.ndarray | None = None   # cells that hold rows, sorted
    counts: np.ndarray | None = None
    first: np.ndarray | None = None   # per cell: its first shard and number of shards
    parts: np.ndarray | None = None

    @property
    def half(self) -> int:
        return (self.dim + 1) // 2

    def matrix(self, column: pa.Array) -> np.ndarray:
        """The rows' components as one matrix, shorter rows filled with zeros."""
        n = column.value_lengths().to_numpy()
        flat = column.flatten().to_numpy()
        if len(n) and (n == self.dim).all():
            out = flat.reshape(len(n), self.dim)
        else:
            out = np.zeros((len(n), self.dim), np.int64)
            out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
        return out if self.wide else out.astype(np.float64)

    def halves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = q.astype(np.float64)
        return q[:, :self.half], q[:, self.half:]

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Upper half bounds and lower half bounds of one anchor for the codewords of both halves."""
        out = []
        for x, c, r in zip(self.halves(a[None, :]), self.codes, self.radii):
            mid, wide = c @ x[0], np.sqrt((x[0] ** 2).sum()) * r
            slack = 1e-9 * (np.abs(mid) + wide) + 1e-6  # rounding of these doubles; scores are integers
            out.append((mid + wide + slack, mid - wide - slack))
        return out[0][0], out[1][0], out[0][1], out[1][1]


def build(rows: DataFrame) -> tuple[Index, DataFrame] | None:
    """The index and its rows with their cell; None without rows."""
    top = rows.select(F.size("q").alias("d"), F.array_max(F.transform("q", lambda x: F.abs(x))).alias("m")).agg(
        F.count(F.lit(1)).alias("n"), F.max("d").alias("d"), F.max("m").alias("m")).first()
    if not top.n:
        return None
    dim, most = max(int(top.d), 1), int(top.m or 0)
    if most * most * dim >= _MAX_PRODUCT:
        raise ValueError(f"components of up to {most} after scaling are too large for 64-bit scores")
    k = int(min(MAX_CODEWORDS, max(2, np.ceil(np.sqrt(top.n / ROWS_PER_CELL)))))
    index = Index(dim, (np.empty(0), np.empty(0)), most * most * dim >= 1 << 53)
    sample = bounded_sample(rows.select("rid", "q"), "rid", FIT_ROWS).select("q").toArrow()
    halves = index.halves(index.matrix(sample["q"].combine_chunks()))
    index.codes = tuple(_kmeans(h, k) for h in halves)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                (c1, d1), (c2, d2) = (_nearest(x, c) for x, c in zip(index.halves(index.matrix(b.column("q"))), index.codes))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array((c1 * MAX_CODEWORDS + c2).astype(np.int32)), pa.array(d1), pa.array(d2)],
                    names=[*b.schema.names, "cell", "d1", "d2"])

    placed = staged(rows.mapInArrow(assign, _ddl(rows) + ", cell int, d1 double, d2 double"), "index-cells")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")) \
        .orderBy("cell").toArrow()
    index.cells, index.counts = cells["cell"].to_numpy(), cells["n"].to_numpy()
    index.radii = tuple(np.zeros(len(c)) for c in index.codes)
    np.maximum.at(index.radii[0], index.cells // MAX_CODEWORDS, cells["d1"].to_numpy())
    np.maximum.at(index.radii[1], index.cells % MAX_CODEWORDS, cells["d2"].to_numpy())
    _deal_shards(index, int(np.clip(top.n // 64, 256, 16_384)))
    return index, placed.drop("d1", "d2")


def _deal_shards(index: Index, shard_rows: int) -> None:
    """Consecutive cells share a shard up to ``shard_rows``; a larger cell has shards of its own."""
    index.parts = np.maximum(1, -(-index.counts // shard_rows))
    index.first = np.empty(len(index.cells), np.int64)
    shard, held = 0, 0
    for i, n in enumerate(index.counts):
        if held and (index.parts[i] > 1 or held + n > shard_rows):
            shard, held = shard + 1, 0
        index.first[i] = shard
        if index.parts[i] > 1:
            shard += int(index.parts[i])
        else:
            held += int(n)


# ------------------------------------------------------------------ the walk

def multi_sequence(u1: np.ndarray, u2: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(i, j, u1[i] + u2[j]) in falling order of the sum, from a heap over both lists in falling order."""
    o1, o2 = np.argsort(-u1, kind="stable").tolist(), np.argsort(-u2, kind="stable").tolist()
    v1, v2 = u1[o1].tolist(), u2[o2].tolist()
    done = [0] * len(o1)  # of row i the columns before done[i] have been given out
    heap = [(-(v1[0] + v2[0]), 0, 0)]
    while heap:
        b, i, j = heapq.heappop(heap)
        yield o1[i], o2[j], -b
        done[i] = j + 1
        if i + 1 < len(o1) and done[i + 1] == j:
            heapq.heappush(heap, (-(v1[i + 1] + v2[j]), i + 1, j))
        if j + 1 < len(o2) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (-(v1[i] + v2[j + 1]), i, j + 1))


def _route(index: Index, anchors: DataFrame, seed: bool) -> DataFrame:
    """Anchors once per shard that they visit: in the seed round the shards of the nearest ``SEED_ROWS`` rows, later
    those of every cell whose bound reaches ``least`` (null: all)."""
    number = {int(c): i for i, c in enumerate(index.cells)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            least = b.column("least").to_pylist()
            most = b.column("most").to_pylist()
            at, shards = [], []
            for r, a in enumerate(index.matrix(b.column("q"))):
                u1, u2, l1, l2 = index.bounds(a)
                rows, mine = 0, set()
                for i, j, bound in multi_sequence(u1, u2):
                    if rows >= SEED_ROWS if seed else least[r] is not None and bound < least[r]:
                        break
                    cell = number.get(i * MAX_CODEWORDS + j)
                    if cell is None or most[r] is not None and l1[i] + l2[j] > most[r]:
                        continue
                    rows += int(index.counts[cell])
                    mine.update(range(int(index.first[cell]), int(index.first[cell] + index.parts[cell])))
                at += [r] * len(mine)
                shards += sorted(mine)
            picked = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(shards, pa.int32())], names=[*b.schema.names, "shard"])

    return anchors.mapInArrow(run, _ddl(anchors) + ", shard int")


class _Shard:
    """The rows of one shard by cell."""

    def __init__(self, index: Index, t: pa.Table):
        order = np.argsort(t["cell"].to_numpy(), kind="stable")
        cell = t["cell"].to_numpy()[order]
        self.q = index.matrix(t["q"].combine_chunks())[order]
        self.ids = t["vec_id"].fill_null(_NO_ID).to_numpy()[order]
        self.rid, self.label = t["rid"].to_numpy()[order], t["label"].to_numpy()[order]
        cells, at = np.unique(cell, return_index=True)
        ends = [*at[1:], len(cell)]
        self.slices = {(int(c) // MAX_CODEWORDS, int(c) % MAX_CODEWORDS): slice(a, b) for c, a, b in zip(cells, at, ends)}
        self.c1, self.c2 = np.unique(cells // MAX_CODEWORDS), np.unique(cells % MAX_CODEWORDS)

    def visit(self, index: Index, a: np.ndarray) -> Iterator[tuple[float, float, slice]]:
        """(upper bound, lower bound, rows) of the cells in falling order of the upper bound."""
        u1, u2, l1, l2 = index.bounds(a)
        for i, j, bound in multi_sequence(u1[self.c1], u2[self.c2]):
            i, j = int(self.c1[i]), int(self.c2[j])
            if (i, j) in self.slices:
                yield bound, l1[i] + l2[j], self.slices[i, j]


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, of equal ones the smaller ids."""
    if len(scores) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= bar)
        return at[np.lexsort((ids[at], -scores[at]))][:k]
    return np.lexsort((ids, -scores))[:k]


class _Best:
    """The ``k`` first rows of one anchor and window [low, high] in one shard."""

    def __init__(self, k: int, least: int | None, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.least = max((x for x in (least, low) if x is not None), default=None)
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = np.ones(len(scores), bool) if self.least is None else scores >= self.least
        if self.high is not None:
            keep &= scores <= self.high
        if keep.any():
            s, i = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.ids, ids[keep]])
            at = _first(s, i, self.k)
            self.scores, self.ids = s[at], i[at]
            if len(at) == self.k:
                self.least = int(s[at[-1]])

    def open_to(self, bound: float) -> bool:
        return self.least is None or bound >= self.least


def _scored(index: Index, shard: _Shard, rows: slice, a: np.ndarray) -> np.ndarray:
    s = shard.q[rows] @ a
    return s if index.wide else s.astype(np.int64)


def _meet(index: Index, rows: DataFrame, routed: DataFrame, n_blocks: int, answer, kinds: str) -> DataFrame:
    """Every shard meets every block of anchors routed to it; ``answer(shard, anchors)`` gives columns of ``kinds``."""
    number = {int(c): i for i, c in enumerate(index.cells)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = np.array([number[c] for c in b.column("cell").to_pylist()])
                rid = b.column("rid").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                shard = index.first[cell] + (rid % index.parts[cell].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard.astype(np.int32))], names=[*b.schema.names, "shard"])

    dealt = rows.mapInArrow(place, _ddl(rows) + ", shard int").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [k.split()[0] for k in kinds.split(", ")]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * len(names), names=names)
        columns = answer(_Shard(index, left), right)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return dealt.groupBy("shard", "block").cogroup(routed.groupBy("shard", "block")).applyInArrow(run, kinds)


def _ranked(found: DataFrame, by: list[str], score: str, row_id: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(row_id))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# ------------------------------------------------------------------ positives, then negatives

def _positives(index: Index, rows: DataFrame, anchors: DataFrame, n_blocks: int, k: int) -> DataFrame:
    """The first ``k`` other rows of each anchor's label: rid, positive_id, positive_score, rank."""
    def answer(shard: _Shard, asked: pa.Table) -> list[list]:
        out: list[list] = [[], [], []]
        for a, rid, label, least in zip(index.matrix(asked["q"].combine_chunks()), asked["rid"].to_pylist(),
                                        asked["label"].to_pylist(), asked["least"].to_pylist()):
            best = _Best(k, least)
            for bound, _, rs in shard.visit(index, a):
                if not best.open_to(bound):
                    break
                mine = (shard.label[rs] == label) & (shard.rid[rs] != rid)
                if mine.any():
                    best.add(_scored(index, shard, rs, a)[mine], shard.ids[rs][mine])
            out[0] += [rid] * len(best.ids)
            out[1] += best.ids.tolist()
            out[2] += best.scores.tolist()
        return out

    kinds = "rid long, positive_id long, positive_score long"
    none = anchors.withColumns({"least": F.lit(None).cast("long"), "most": F.lit(None).cast("long")})
    seeds = _meet(index, rows, _route(index, none, seed=True), n_blocks, answer, kinds)
    sure = (_ranked(seeds, ["rid"], "positive_score", "positive_id", k).filter(F.col("rank") == k)
            .select("rid", F.col("positive_score").alias("least")))
    sure = staged(none.drop("least").join(sure, "rid", "left"), "index-sure").select(*none.columns)
    found = _meet(index, rows, _route(index, sure, seed=False), n_blocks, answer, kinds)
    return staged(_ranked(found, ["rid"], "positive_score", "positive_id", k), "index-positives")


def _negatives(index: Index, rows: DataFrame, anchors: DataFrame, n_blocks: int, k: int) -> DataFrame:
    """For anchors with ``windows`` (array of structs w, low, high, least), the first ``k`` rows of other labels whose
    scores lie in each window: rid, w, negative_id, negative_score, rank."""
    def answer(shard: _Shard, asked: pa.Table) -> list[list]:
        out: list[list] = [[], [], [], []]
        for a, rid, label, windows in zip(index.matrix(asked["q"].combine_chunks()), asked["rid"].to_pylist(),
                                          asked["label"].to_pylist(), asked["windows"].to_pylist()):
            best = [_Best(k, w["least"], w["low"], w["high"]) for w in windows]
            high = max(w["high"] for w in windows)
            for bound, floor, rs in shard.visit(index, a):
                if not any(b.open_to(bound) for b in best):
                    break
                if floor > high:
                    continue
                scores = _scored(index, shard, rs, a)
                mine = (shard.label[rs] != label) & (scores <= high)
                if mine.any():
                    scores, ids = scores[mine], shard.ids[rs][mine]
                    for b in best:
                        b.add(scores, ids)
            for w, b in zip(windows, best):
                out[0] += [rid] * len(b.ids)
                out[1] += [w["w"]] * len(b.ids)
                out[2] += b.ids.tolist()
                out[3] += b.scores.tolist()
        return out

    kinds = "rid long, w long, negative_id long, negative_score long"

    def ends(a: DataFrame) -> DataFrame:
        reach = F.transform("windows", lambda w: F.greatest(w["low"], w["least"]))
        return a.withColumns({"least": F.array_min(reach), "most": F.array_max(F.transform("windows", lambda w: w["high"]))})

    seeds = _meet(index, rows, _route(index, ends(anchors), seed=True), n_blocks, answer, kinds)
    sure = (_ranked(seeds, ["rid", "w"], "negative_score", "negative_id", k).filter(F.col("rank") == k)
            .groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("w", "negative_score"))).alias("sure")))
    known = F.transform("windows", lambda w: F.struct(
        w["w"].alias("w"), w["low"].alias("low"), w["high"].alias("high"),
        F.coalesce(F.col("sure")[w["w"]], w["least"]).alias("least")))
    sure = staged(anchors.join(sure, "rid", "left").withColumn("windows", known).select(*anchors.columns), "index-windows")
    found = _meet(index, rows, _route(index, ends(sure), seed=False), n_blocks, answer, kinds)
    return _ranked(found, ["rid", "w"], "negative_score", "negative_id", k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id",
         vector_col: str = "embedding", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH) -> DataFrame:
    """For each anchor row and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of
    other labels whose score lies between ``low`` and ``high`` percent of the positive's; columns of ``RESULT``.

    ``is_anchor`` and ``label`` are expressions over ``vectors`` (label: its column of that name unless given);
    0 <= low < high, so a negative positive score has no window."""
    rows = scaled_rows(vectors, is_anchor, F.col("label") if label is None else label, id_col, vector_col, scale)
    built = build(rows)
    if built is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    index, placed = built
    asked = placed.filter("anchor")
    n_blocks = max(1, -(-asked.count() // ANCHOR_BLOCK))
    anchors = asked.select("rid", "label", "q", F.pmod(F.xxhash64("rid"), F.lit(n_blocks)).cast("int").alias("block"))
    found = _positives(index, placed.drop("anchor"), anchors, n_blocks, positives)
    window = found.filter("positive_score >= 0").selectExpr(
        "rid", "cast(rank as long) AS w", f"(positive_score * {low} + {WHOLE - 1}) div {WHOLE} AS low",
        f"(positive_score * {high}) div {WHOLE} AS high", "cast(NULL AS long) AS least").filter("low <= high")
    windows = window.groupBy("rid").agg(F.collect_list(F.struct("w", "low", "high", "least")).alias("windows"))
    hard = _negatives(index, placed.drop("anchor"), anchors.join(windows, "rid"), n_blocks, negatives)

    def named(c: str) -> Column:
        return F.when(F.col(c) != F.lit(int(_NO_ID)), F.col(c)).alias(c)

    return (hard.join(found.withColumn("w", F.col("rank").cast("long")).drop("rank"), ["rid", "w"])
            .join(asked.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
            .select("anchor_id", named("positive_id"), "rank", named("negative_id"), "positive_score", "negative_score"))


def query_label() -> Column:
    """The registered query's label: rows whose id is divisible by 7 get the next one."""
    return F.when(F.col("vec_id") % FLIP_EVERY == 0, (F.col("label") + 1) % N_LABELS).otherwise(F.col("label"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % ANCHOR_EVERY == 0, query_label())


ORACLE = """
WITH clean AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.rid, a.vec_id AS anchor_id, b.vec_id, b.label = a.label AS same,
    list_inner_product(a.q, b.q)::BIGINT AS score
  FROM clean a JOIN clean b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS w FROM pairs WHERE same),
hard AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score,
    n.score AS negative_score, row_number() OVER (PARTITION BY p.rid, p.w ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM pos p JOIN pairs n ON n.rid = p.rid AND NOT n.same
    AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
  WHERE p.w <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 10"""
