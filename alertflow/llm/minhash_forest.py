"""Near-duplicate detection with an LSH forest.

Documents become sets of 5-word shingles (A-Z lower-cased; 64-bit hashes).
Equal sets are one class and go on as one. A class has ``TREES * DEPTH``
MinHash values; every tree is a sorted order of all classes by its ``DEPTH``
values. Candidates of a class are the neighbours that follow it in an order
and share the longest prefixes: it scans on while at least ``MIN_DEPTH``
values agree and until ``PARTNERS`` partners look similar. In sparse regions a
prefix of two values suffices; in dense ones the partners are those with much
deeper prefixes, so a group of any size yields a number of candidates in
proportion to it, never all pairs. The orders are range-partitioned by their
values (a hot region is split over many tasks); the ends of neighbouring
partitions are compared afterwards.

Links are confirmed on full sets in two steps: each class with its likeliest
candidate first, then every candidate pair whose classes are still in
different components. Pairs inside one component cannot change the result.
The scan notes the regions (rows of one order that share ``MIN_DEPTH`` values)
in which it left a class before the region's end: by ``PARTNERS``, by
``REACH`` or at the end of a partition. Those are gone through without a limit
once the components are known: all pairs of a region whose classes are in
different components, on full sets, block by block. So every pair that shares
a region and has ``LIKELY`` values in common is linked, if it is similar enough
and not in one component anyhow; rejected pairs use up nothing. Work grows with
the square of a region of near misses, rows by the number of its blocks.

Defined cases: null or wordless texts are linked with nothing and stay; with
one to four words the whole sequence is the one shingle; a row without id has
no component (null) and stays; rows that repeat an id are judged each by its
own text; equal texts have similarity 1 and one class; an empty table gives an
empty result; extra columns are ignored by ``near_duplicates`` and kept by
``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame, SparkSession

from alertflow.llm.common import free_names, mix64, read_table, staged
from alertflow.llm.components import connected_components, extended_components

WORDS, SIMILARITY = 5, 75  # words of a shingle; percent
TREES, DEPTH, MIN_DEPTH = 16, 8, 2
HASHES = TREES * DEPTH
#: Similar-looking partners sought per class and order by the scan, and how far it goes among equal prefixes.
PARTNERS, REACH = 2, 64
#: Share of agreeing MinHash values below which a pair is not confirmed: five standard errors below 75 %.
LIKELY = 72 / HASHES
#: Most classes and shingles of a block, about, when the rest of a region is compared.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1 << 20
_CACHE_ROWS = 300_000
_MULTIPLIERS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_ROWS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z and [\x20\x09-\x0D] only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    width = min(n, WORDS)
    code = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        code = code * _BASE + h[k:n - width + 1 + k]
    return np.unique(mix64(code))


def signature(s: np.ndarray) -> np.ndarray:
    """``HASHES`` minima (uint32)."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        least = np.minimum(least, (s[i:i + 2048, None] * _MULTIPLIERS).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def _sketch(sig: np.ndarray) -> bytes:
    """Four bits of every minimum, for estimates within an order."""
    low = (sig & 15).astype(np.uint8)
    return (low[0::2] | low[1::2] << 4).tobytes()


def _profiles(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, fp (128-bit digest of the set; null if empty), sig."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, fps, sigs = [], [], []
            for t in b.column(2).to_pylist():
                s = shingles(t)
                sizes.append(len(s))
                fps.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).astype(">u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()),
                 pa.array(sigs, pa.binary())], names=["doc_id", "text_key", "n_shingles", "fp", "sig"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run, f"doc_id {id_type}, text_key long, n_shingles long, fp binary, sig binary")


def _orders(classes: DataFrame) -> DataFrame:
    """One row per class and tree, in the trees' orders: tree, key (the tree's values, big-endian), cid, sketch, comp."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cids, sigs = b.column(0), b.column(1).to_pylist()
            sketches = [_sketch(np.frombuffer(s, ">u4")) for s in sigs]
            for tree in range(TREES):
                at = slice(tree * DEPTH * 4, (tree + 1) * DEPTH * 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(cids), pa.int32()), pa.array([s[at] for s in sigs], pa.binary()), cids,
                     pa.array(sketches, pa.binary()), b.column(2)], names=["tree", "key", "cid", "sketch", "comp"])

    rows = classes.select("cid", "sig", "comp").mapInArrow(run, "tree int, key binary, cid long, sketch binary, comp long")
    return rows.repartitionByRange("tree", "key", "cid").sortWithinPartitions("tree", "key", "cid")


class _Window:
    """Rows of one order as arrays: tree, key values, cid, sketch, component (-1: none known)."""

    def __init__(self, tree, key, cid, sketch, comp):
        self.columns = (tree, key, cid, sketch, comp)
        self.tree, self.key, self.cid, self.sketch, self.comp = self.columns

    @classmethod
    def of(cls, b: pa.RecordBatch) -> _Window:
        n = b.num_rows
        return cls(b.column("tree").to_numpy(), np.frombuffer(b"".join(b.column("key").to_pylist()), ">u4").reshape(n, DEPTH),
                   b.column("cid").to_numpy(),
                   np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(n, HASHES // 2),
                   b.column("comp").to_numpy())

    def __len__(self) -> int:
        return len(self.cid)

    def rows(self, at) -> _Window:
        return _Window(*(c[at] for c in self.columns))

    def like(self, at: int) -> np.ndarray:
        """Rows of the same tree that share the shortest prefix with row ``at``."""
        return np.flatnonzero((self.tree == self.tree[at]) & (self.key[:, :MIN_DEPTH] == self.key[at, :MIN_DEPTH]).all(axis=1))

    def plus(self, other: _Window) -> _Window:
        return _Window(*(np.concatenate([x, y]) for x, y in zip(self.columns, other.columns, strict=True)))

    def regions(self, at) -> tuple[np.ndarray, np.ndarray]:
        """Distinct tree and shortest prefix of the rows."""
        pairs = np.unique(np.stack([self.tree[at].astype(np.int64), _region(self.key[at])]), axis=1)
        return pairs[0], pairs[1]

    def candidates(self, first_new: int, quota: int, likely_from: float, last_old: int | None = None
                   ) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """Pairs (i < j) with j among the rows from ``first_new`` on (and i before ``last_old``): cids and agreement;
        and the rows that were cut off, with more rows to go in their region."""
        n = len(self)
        start = max(0, first_new - REACH - 1)
        left = np.arange(start, n if last_old is None else last_old)
        partners = np.zeros(n, np.int32)
        found, cut = [], []
        for step in range(1, REACH + 2):
            left = left[left + step < n]
            right = left + step
            left = left[(self.tree[left] == self.tree[right])
                        & (self.key[left, :MIN_DEPTH] == self.key[right, :MIN_DEPTH]).all(axis=1)]
            full = (partners[left] >= quota) | (step > REACH)
            cut.append(left[full])
            left = left[~full]
            if not len(left):
                break
            right = left + step
            other = (self.comp[left] != self.comp[right]) | (self.comp[left] < 0)
            i, j = left[other], right[other]
            differ = self.sketch[i] ^ self.sketch[j]
            agree = ((differ & 15) == 0).sum(axis=1) + ((differ >> 4) == 0).sum(axis=1)
            likely = agree >= likely_from * HASHES
            partners[i[likely]] += 1
            new = likely & (j >= first_new)
            found.append((self.cid[i[new]], self.cid[j[new]], agree[new]))
        pairs = tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return pairs, np.concatenate(cut)


def _region(key: np.ndarray) -> np.ndarray:
    """The shortest prefix (``MIN_DEPTH`` values of 32 bits) as one number."""
    key = key.astype(np.uint64)
    return (key[..., 0] << np.uint64(32) | key[..., 1]).view(np.int64)


_PAIRS = "kind int, pid int, a long, b long, agree int, tree int, key binary, cid long, sketch binary, comp long"


def _pair_batch(a, b, agree) -> pa.RecordBatch:
    n, empty = len(a), lambda kind: pa.nulls(len(a), kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(n, np.int32)), empty(pa.int32()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)),
         pa.array(agree.astype(np.int32)), empty(pa.int32()), empty(pa.binary()), empty(pa.int64()), empty(pa.binary()),
         empty(pa.int64())], names=[c.split()[0] for c in _PAIRS.split(", ")])


def _edge_batch(w: _Window, kind: int, pid: int) -> pa.RecordBatch:
    n, empty = len(w), lambda t: pa.nulls(len(w), t)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n, pa.int32()), pa.array([pid] * n, pa.int32()), empty(pa.int64()), empty(pa.int64()),
         empty(pa.int32()), pa.array(w.tree.astype(np.int32)),
         pa.array([k.astype(">u4").tobytes() for k in w.key], pa.binary()), pa.array(w.cid.astype(np.int64)),
         pa.array([s.tobytes() for s in w.sketch], pa.binary()), pa.array(w.comp.astype(np.int64))],
        names=[c.split()[0] for c in _PAIRS.split(", ")])


def _cut_batch(tree, region) -> pa.RecordBatch:
    """A region that the scan has not gone through (kind 3): its number is written as ``a``."""
    n = len(tree)
    columns = {"kind": np.full(n, 3, np.int32), "a": region, "tree": tree.astype(np.int32)}
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[c]) if c in columns else pa.nulls(n, kind) for c, kind in (
            ("kind", None), ("pid", pa.int32()), ("a", None), ("b", pa.int64()), ("agree", pa.int32()), ("tree", None),
            ("key", pa.binary()), ("cid", pa.int64()), ("sketch", pa.binary()), ("comp", pa.int64()))],
        names=[c.split()[0] for c in _PAIRS.split(", ")])


def _scan(ordered: DataFrame, quota: int = PARTNERS, likely: float = LIKELY) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b, agree) of sorted, range-partitioned orders, ends of partitions included; and the regions
    (tree, region) in which a class was cut off, by its quota, by ``REACH`` or by the end of the partition."""
    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, kept, head = TaskContext.get().partitionId(), None, None
        for b in batches:
            if not b.num_rows:
                continue
            new = _Window.of(b)
            head = new.rows(slice(0, REACH)) if head is None else (
                head.plus(new.rows(slice(0, REACH - len(head)))) if len(head) < REACH else head)
            both, first = (new, 0) if kept is None else (kept.plus(new), len(kept))
            pairs, cut = both.candidates(first, quota, likely)
            yield _pair_batch(*pairs)
            yield _cut_batch(*both.regions(cut))
            kept = both.rows(slice(max(0, len(both) - REACH - 1), None))
        if kept is not None:
            # only rows that share the shortest prefix with the end itself can have a partner beyond it
            yield _cut_batch(*kept.regions([-1]))
            yield _edge_batch(head.rows(head.like(0)), 1, pid - 1)
            yield _edge_batch(kept.rows(kept.like(-1)), 2, pid)

    def across(key, table):
        parts = {k: table.filter(pc.equal(table["kind"], k)).sort_by(
            [("tree", "ascending"), ("key", "ascending"), ("cid", "ascending")]).combine_chunks() for k in (1, 2)}
        if not (parts[1].num_rows and parts[2].num_rows):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "agree": pa.array([], pa.int32())})
        old, new = (_Window.of(parts[k].to_batches()[0]) for k in (2, 1))
        a, b, agree = old.plus(new).candidates(len(old), quota, likely, len(old))[0]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "agree": agree.astype(np.int32)})

    found = staged(ordered.mapInArrow(within, _PAIRS), "forest-scan")
    inner = found.filter("kind = 0").select("a", "b", "agree")
    ends = found.filter("kind IN (1, 2)").groupBy("pid").applyInArrow(across, "a long, b long, agree int")
    cut = found.filter("kind = 3").select("tree", F.col("a").alias("region")).distinct()
    return inner.union(ends).groupBy("a", "b").agg(F.max("agree").alias("agree")), cut


def _regions(classes: DataFrame) -> DataFrame:
    """One row per class and tree: tree, region, cid, n_shingles, comp."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            key = np.frombuffer(b"".join(b.column(3).to_pylist()), ">u4").reshape(n, TREES, DEPTH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), pa.array(_region(key).ravel()),
                 *(pa.array(np.repeat(b.column(i).to_numpy(), TREES)) for i in range(3))],
                names=["tree", "region", "cid", "n_shingles", "comp"])

    return classes.select("cid", "n_shingles", "comp", "sig").mapInArrow(
        run, "tree int, region long, cid long, n_shingles long, comp long")


def _compare(tree: int, old: int, cid, comp, sig, sets) -> tuple[list[int], list[int]]:
    """Links (a, b) between different components, as few as join them; ``old`` rows are compared with the others, or all
    rows with each other if there are no others. A pair that shares a region of an earlier tree is left to that one."""
    n, comp = len(cid), comp.copy()
    earlier, low = _region(sig.reshape(n, TREES, DEPTH))[:, :tree], (sig & 15).astype(np.uint8)
    size = np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark, a, b = np.zeros(len(words), bool), [], []
    for i in range(old):
        j = np.arange(old if old < n else i + 1, n)
        j = j[(comp[j] != comp[i]) & (100 * np.minimum(size[j], size[i]) >= SIMILARITY * np.maximum(size[j], size[i]))]
        j = j[~(earlier[j] == earlier[i]).any(axis=1)]
        j = j[(low[j] == low[i]).sum(axis=1) >= LIKELY * HASHES]
        if not len(j):
            continue
        own = flat[first[i]:first[i] + size[i]]
        mark[own] = True
        ends = np.cumsum(size[j])
        both = np.add.reduceat(mark[flat[np.arange(ends[-1]) + np.repeat(first[j] - ends + size[j], size[j])]],
                               ends - size[j], dtype=np.int64)
        mark[own] = False
        for k in j[100 * both >= SIMILARITY * (size[j] + size[i] - both)]:
            if comp[k] != comp[i]:
                a.append(min(cid[i], cid[k]))
                b.append(max(cid[i], cid[k]))
                comp[comp == comp[k]] = comp[i]
    return a, b


def _rest(classes: DataFrame, cut: DataFrame, docs: DataFrame, components: DataFrame) -> DataFrame:
    """The links (a, b) that the scan has missed in the regions where a class was cut off: all pairs of a region whose
    classes are in different components, on full sets. Regions are dealt as pairs of blocks, and a task returns no more
    links than join its classes."""
    known = classes.join(components.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("root", "cid"))
    members = staged(_regions(known).join(cut, ["tree", "region"]), "forest-members")
    blocks = F.greatest(F.ceil(F.count("cid") / BLOCK_CLASSES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks")
    sizes = (members.groupBy("tree", "region").agg(blocks, F.min("comp").alias("least"), F.max("comp").alias("most"))
             .filter("least < most").select("tree", "region", "blocks"))
    rows = staged(members.join(sizes, ["tree", "region"]).drop("n_shingles"), "forest-members")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column(3).to_pylist()]
            same = [xxhash.xxh3_128_digest(s.tobytes()) == fp for s, fp in zip(sets, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["cid", "sig", "shingles"]).filter(pa.array(same, pa.bool_()))  # not another text under the same id

    wanted = classes.join(rows.select("cid").distinct(), "cid").select("doc_id", "cid", "sig", "fp")
    sets = staged(docs.join(wanted, "doc_id").select("cid", "sig", "fp", "text")
                  .mapInArrow(full, "cid long, sig binary, shingles binary"), "forest-sets")
    dealt = (rows.withColumn("block", F.pmod(F.xxhash64("cid"), "blocks"))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("tree", "region", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
                     (F.col("block") > F.col("other")).alias("second"), "cid", "comp").join(sets, "cid"))

    def links(key, table):
        table = table.sort_by([("second", "ascending"), ("cid", "ascending")]).combine_chunks()
        old = table.num_rows - int(pc.sum(table["second"]).as_py() or 0)
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), ">u4").reshape(-1, HASHES)
        sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
        a, b = _compare(key[0].as_py(), old, table["cid"].to_numpy(), table["comp"].to_numpy(), sig, sets)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("tree", "region", "one", "two").applyInArrow(links, "a long, b long")


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; texts are fetched by the classes' least ids."""
    ends = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    wanted = classes.join(ends, "cid").select("cid", "fp", "doc_id")
    texts = docs.join(wanted, "doc_id").select("cid", "fp", "text")
    rows = (pairs.select("a", "b")
            .join(texts.select(F.col("cid").alias("a"), F.col("fp").alias("fp_a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("cid").alias("b"), F.col("fp").alias("fp_b"), F.col("text").alias("text_b")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, last = [], (None, None)
            columns = [b.column(i).to_pylist() for i in range(2, 6)]
            for fp_a, text_a, fp_b, text_b in zip(*columns, strict=True):
                sets = []
                for fp, text in ((fp_a, text_a), (fp_b, text_b)):
                    if last[0] != fp:
                        s = shingles(text)
                        last = (fp, s if xxhash.xxh3_128_digest(s.tobytes()) == fp else None)
                    sets.append(last[1])
                if any(s is None for s in sets):  # another text under the same id
                    ok.append(False)
                    continue
                both = len(np.intersect1d(*sets, assume_unique=True))
                ok.append(100 * both >= SIMILARITY * (len(sets[0]) + len(sets[1]) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows.select("a", "b", "fp_a", "text_a", "fp_b", "text_b").mapInArrow(run, "a long, b long")


def _other_components(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs whose classes are not in one component yet."""
    left = components.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    right = components.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    return (pairs.join(left, "a", "left").join(right, "b", "left")
            .filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "agree"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, text_key (hash of the text)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    profiles = staged(_profiles(docs), "forest-profiles")
    classes = staged(profiles.filter("fp IS NOT NULL AND doc_id IS NOT NULL").groupBy("fp")
                     .agg(F.min("doc_id").alias("doc_id"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n_shingles"))
                     .withColumn("cid", F.monotonically_increasing_id()), "forest-classes")
    pairs, cut = _scan(_orders(classes.withColumn("comp", F.lit(-1).cast("long"))))
    pairs = staged(pairs, "forest-pairs")

    # each class with its likeliest candidate
    best = F.max(F.struct("agree", "a", "b")).alias("best")
    likeliest = (pairs.select(F.col("a").alias("c"), "*").union(pairs.select(F.col("b").alias("c"), "*"))
                 .groupBy("c").agg(best).select("best.a", "best.b").distinct())
    links = staged(_confirm(likeliest, classes, docs), "forest-links")
    components = connected_components(links)
    rest = staged(_other_components(pairs, components).join(likeliest, ["a", "b"], "left_anti"), "forest-rest")
    components = extended_components(components, staged(_confirm(rest, classes, docs), "forest-links"))
    components = extended_components(components, staged(_rest(classes, cut, docs, components), "forest-links"))

    roots = classes.select("cid", "doc_id", "fp").join(components.withColumnRenamed("node", "cid"), "cid", "left")
    roots = roots.withColumn("root", F.coalesce("root", "cid"))
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = staged(roots.join(least, "root").select("fp", "component_id"), "forest-components")
    joined = profiles.select("doc_id", "text_key", "n_shingles", "fp").join(of_class, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_key")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that a smaller id of their component stands for; same columns."""
    same_id, same_text = free_names(docs, "near_id", "near_text")
    gone = (near_duplicates(docs, id_col, text_col).filter(~F.col("kept"))
            .select(F.col("doc_id").alias(same_id), F.col("text_key").alias(same_text)).distinct())
    here = (F.col(f"`{id_col}`") == F.col(same_id)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(same_text))
    return docs.join(gone, here, "left_anti")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("text_key")
