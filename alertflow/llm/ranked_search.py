"""Ranked lexical search by NRA (no random access) over impact-sorted lists.

Terms are the maximal matches of ``TERM`` with A-Z lower-cased. A document is
read once: its postings for the query terms (term, occurrences) and its length
are staged, and the corpus statistics (N, L, df) are summed over all of them.

The search is document-partitioned. Each task takes the staged postings of its
documents in shards of at most ``SHARD_POSTINGS`` postings, sorts every term's
list by falling impact and answers each query from sequential reads of its
lists alone: every list is read to the same depth, which grows block by block.
Each document has a lower bound (what was read of it) and an upper bound (the
frontier of every list in which it was not yet met is added). Reading goes on
until no document outside the answer can reach it, ties included, and the
members' own scores are resolved: for those, the rest of the lists is read on
to the end. A document that cannot reach the k-th score that an earlier shard
of the same task has certified is out as well. The answers of the tasks (at
most k rows per query each) are merged in two steps, so that no task gathers
one query's rows of all tasks.

Queries are answered in blocks of about ``QUERY_BLOCK_BYTES`` of text, each
against all documents; only the terms of one block are sent to the tasks.

Defined cases: a null or empty text has no terms and is never found; a query
without terms has no rows; documents that repeat an id are documents of their
own; a null id counts as one and loses ties against others; a repeated item_id
is answered once per row; empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from alertflow.llm.common import read_table, staged
from alertflow.llm.features import sum_counts

#: Fixed pattern of a term.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fixed values of the score.
WEIGHT_SCALE, TF_SCALE, TF_FACTOR, LENGTH_FACTOR = 1000, 1_000_000_000, 1000, 8
LENGTH_BASE, LENGTH_SHARE = 10, 90
TOP_K = 10

SHARD_POSTINGS = 4_000_000
QUERY_BLOCK_BYTES = 4 << 20
FIRST_DEPTH = 32
_NO_ID = np.iinfo(np.int64).max

#: Bytes: A-Z lower-cased, every other ASCII byte outside 0-9 and a-z a space; bytes of longer characters stay.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

RESULT = "item_id long, rank int, doc_id long, score long"


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_BYTES).split()


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with a term: doc_id, n (all its terms), and its query terms with their occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lengths, found, times, ends = [], [], [], [], [0]
            texts = b.column("text").cast(pa.binary())
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts):
                words = terms(text.as_py()) if text.is_valid else []
                if not words:
                    continue
                counts = Counter(x for x in map(vocabulary.get, words) if x is not None)
                ids.append(doc_id)
                lengths.append(len(words))
                found.extend(counts.keys())
                times.extend(counts.values())
                ends.append(len(found))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(at, pa.array(found, pa.int32())),
                pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))], names=["doc_id", "n", "terms", "times"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n long, terms array<int>, times array<long>")


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts(times: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A posting's score without its term's weight."""
    m = LENGTH_BASE + (LENGTH_SHARE * n * n_docs) // n_terms
    return (TF_SCALE * times) // (TF_FACTOR * times + LENGTH_FACTOR * m)


class Shard:
    """Impact-sorted lists over a bounded number of documents; documents are numbered in id order, null ids last."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray,
                 weights: np.ndarray, n_docs: int, n_terms: int):
        by_id = np.argsort(ids, kind="stable")
        number = np.empty(len(ids), np.int64)
        number[by_id] = np.arange(len(ids))
        self.ids = ids[by_id]
        score = weights[term] * impacts(times, n[doc], n_docs, n_terms)
        doc = number[doc]
        order = np.lexsort((doc, -score, term))
        self.doc, self.score = doc[order], score[order]
        self.at = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def top(self, query: np.ndarray, k: int, reached: int = 0) -> list[tuple[int, int]]:
        """The ``k`` best (score, id) above 0, higher first, then smaller ids; those that cannot reach the score
        ``reached`` may be left out."""
        lists = [(self.doc[a:b], self.score[a:b]) for a, b in zip(self.at[query], self.at[query + 1]) if a < b]
        lists = [(d, s) for d, s in lists if s[0] > 0]
        if not lists:
            return []
        lower = np.zeros(len(self.ids), np.int64)
        read, depth, longest = 0, FIRST_DEPTH, max(len(d) for d, _ in lists)
        while True:
            frontiers = []
            for d, s in lists:  # sequential reads of the next block of every list
                lower[d[read:depth]] += s[read:depth]
                frontiers.append(int(s[depth - 1]) if depth < len(d) else 0)
            upper = lower + sum(frontiers)
            for (d, _), frontier in zip(lists, frontiers):
                if frontier:
                    upper[d[:depth]] -= frontier
            best = _best(lower, k)
            bar = max(int(lower[best[-1]]) if len(best) == k else 1, reached, 1)
            open_ = upper >= bar
            if open_.sum() <= k:
                members = np.flatnonzero(open_)
                break
            outside = open_ & (upper > lower)
            outside[best] = False
            if not outside.any():
                members = best[open_[best]]
                break
            read, depth = depth, min(depth * 2, longest)
        # membership is settled: the members' scores are read on to the end of every list
        member = np.zeros(len(self.ids), bool)
        member[members] = True
        for d, s in lists:
            rest, more = d[depth:], s[depth:]
            mine = member[rest]
            lower[rest[mine]] += more[mine]
        members = members[np.lexsort((members, -lower[members]))]
        return [(int(lower[i]), int(self.ids[i])) for i in members if lower[i] > 0]


def _best(lower: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` highest positive values (of equal ones the first), highest first."""
    n_pos = int(np.count_nonzero(lower))
    k = min(k, n_pos)
    if not k:
        return np.empty(0, np.int64)
    bar = np.partition(lower, len(lower) - k)[len(lower) - k]
    over = np.flatnonzero(lower > bar)
    at = np.concatenate([over, np.flatnonzero(lower == bar)[:k - len(over)]])
    return at[np.lexsort((at, -lower[at]))]


def search_shards(staged_postings: DataFrame, queries: list[np.ndarray], items: list, weights: np.ndarray, n_docs: int,
                  n_terms: int, k: int) -> DataFrame:
    """Per task the best ``k`` documents of each query: query, item_id, doc_id, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        held: list[pa.RecordBatch] = []
        size = 0

        def answer() -> None:
            shard = _shard(held, weights, n_docs, n_terms)
            for q, query in enumerate(queries):
                reached = best[q][-1][0] if len(best[q]) == k else 0
                best[q] = sorted(best[q] + shard.top(query, k, reached), key=lambda x: (-x[0], x[1]))[:k]

        for b in batches:
            held.append(b)
            size += len(b.column("terms").flatten()) + b.num_rows
            if size >= SHARD_POSTINGS:
                answer()
                held, size = [], 0
        if held:
            answer()
        rows = [(q, items[q], None if d == _NO_ID else d, s) for q, found in enumerate(best) for s, d in found]
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()),
                                          pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                                         names=["query", "item_id", "doc_id", "score"])

    return staged_postings.mapInArrow(run, "query int, item_id long, doc_id long, score long")


def _shard(batches: list[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int) -> Shard:
    t = pa.Table.from_batches(batches).combine_chunks()
    lists = t["terms"].combine_chunks()
    return Shard(t["doc_id"].fill_null(_NO_ID).to_numpy(), t["n"].to_numpy(),
                 np.repeat(np.arange(t.num_rows), lists.value_lengths().to_numpy()),
                 lists.flatten().to_numpy(), t["times"].combine_chunks().flatten().to_numpy(), weights, n_docs, n_terms)


def _ranked(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """(id, terms) of the queries, in blocks of bounded text."""
    q = queries.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    n_bytes = q.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, math.ceil(n_bytes / QUERY_BLOCK_BYTES))
    part: Column = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for block in range(blocks):
        yield [(r.item_id, sorted(set(terms(r.text.encode())))) for r in q.filter(part == block).collect() if r.text]


def search(docs: DataFrame, queries: DataFrame, k: int = TOP_K, doc_id: str = "doc_id", doc_text: str = "text",
           query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """The ``k`` best documents of every query row: item_id, rank, doc_id, score."""
    out: DataFrame | None = None
    for block in _query_blocks(queries, query_id, query_text):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in block for t in ts}))}
        if not vocabulary:
            continue
        held = staged(postings(docs, vocabulary, doc_id, doc_text), "search-postings")
        totals = held.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_terms")).first()
        if not totals.n_docs:
            continue
        def seen(b: pa.RecordBatch, size: int = len(vocabulary)) -> np.ndarray:
            return np.bincount(b.column("terms").flatten().to_numpy(), minlength=size).reshape(1, size)

        df = sum_counts(held, ["terms"], seen, (1, len(vocabulary)))[0]
        asked = [(i, np.array([vocabulary[t] for t in ts], np.int64)) for i, ts in block if ts]
        found = search_shards(held, [q for _, q in asked], [i for i, _ in asked], term_weights(totals.n_docs, df),
                              totals.n_docs, totals.n_terms, k)
        # in two steps: no task gathers one query's rows of all tasks
        some = _ranked(found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))), ["query", "part"], k)
        best = _ranked(some.drop("rank", "part"), ["query"], k).select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out if out is not None else docs.sparkSession.createDataFrame([], RESULT)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = rf"""
WITH words AS (SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all({_LOWER.format("text")}, '{TERM}') AS ws FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT row, doc_id, len(ws)::BIGINT AS n FROM words WHERE len(ws) > 0),
totals AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM sizes),
used AS (SELECT row, unnest(ws) AS term FROM words),
tfs AS (SELECT row, term, count(*)::BIGINT AS tf FROM used GROUP BY row, term),
dfs AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY term),
items AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all({_LOWER.format("text")}, '{TERM}')) AS ts
  FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT q, item_id, unnest(ts) AS term FROM items),
scored AS (
  SELECT a.q, a.item_id, t.row, s.doc_id,
    sum(d.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (10 + (90 * s.n * c.nd) // c.nt))))::BIGINT AS score
  FROM asked a JOIN tfs t USING (term) JOIN dfs d USING (term) JOIN sizes s ON s.row = t.row, totals c
  GROUP BY a.q, a.item_id, t.row, s.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
