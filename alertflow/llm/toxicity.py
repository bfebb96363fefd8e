"""Toxicity by maximum-scoring segments over token log-odds.

Token weights: log-odds of a token in toxic against other labelled documents
under an informative Dirichlet prior (the token's frequency in the whole
corpus), divided by its standard error. A token counts once per document, and
equal labelled texts count once, so neither repetition inside a text nor a
group of copies passes for evidence. Tokens whose weight is significant
score their weight, every other token scores ``-drift``. One linear scan per
document finds all maximal segments of positive total (Ruzzo-Tompa). Segment
scores are put on the scale of chance by extreme-value statistics: ``lambda``
solves E[exp(lambda * s)] = 1 over tokens of non-toxic documents, and a
segment's evidence is ``lambda * S - ln(K * n)`` in a document of n tokens; a
document's evidence adds up its significant segments. A logistic curve,
fitted on labelled documents kept out of the weights, maps evidence to 0..1.

The prior counts every document. Weights and curve are learned from at most
``max_labelled`` labelled rows (those with the lowest id hash). Inputs of a
score are the text alone.

Defined cases: null and empty texts have no token and get the score of no
evidence; without any usable label the curve is flat at the share of label 1
(0 without labels); labels that are null or for unknown documents are ignored;
repeated label rows of one document count once, the higher label wins; rows
are scored one by one; extra columns are ignored by ``score`` and kept by
``reject_toxic``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession

from alertflow.llm.common import read_table, staged
from alertflow.llm.features import bounded_sample, id_remainder, logistic_on_bins, sum_counts

#: A token needs to be in so many toxic labelled texts.
MIN_TOXIC = 3
#: Weights below this many standard errors count as no evidence, and so do tokens whose count among toxic texts
#: could be chance: the binomial tail, times the number of tokens tested, must stay below ``CHANCE``.
Z_MIN, CHANCE = 2.5, 0.05
MAX_LABELLED = 20_000
#: Characters cut from both ends of a word.
PUNCTUATION = b".,!?|#*$%&;:\"'()[]<>"
_CACHE_ROWS = 300_000


class TokenIds(dict):
    """Word -> 64-bit id of the word without outer punctuation, remembered for up to ``_CACHE_ROWS`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_ROWS:
            self.clear()
        token = self[word] = xxhash.xxh3_64_intdigest(word.strip(PUNCTUATION)) - (1 << 63)
        return token


_ids = TokenIds()


def token_ids(text: str | None) -> np.ndarray:
    """Id of each word of the text, lower-cased (A-Z), in order."""
    words = text.encode().lower().split() if text else []
    return np.fromiter(map(_ids.__getitem__, words), np.int64, len(words))


@dataclass
class Model:
    tokens: np.ndarray    # ids of the tokens that count as evidence, sorted
    weights: np.ndarray   # their z
    drift: float          # what every other token costs
    lam: float
    log_k: float
    slope: float
    offset: float

    def segments(self, ids: np.ndarray) -> list[tuple[int, int, float]]:
        """All significant segments (first token, last token + 1, evidence > 0)."""
        if not len(ids) or not len(self.tokens):
            return []
        place = np.minimum(np.searchsorted(self.tokens, ids), len(self.tokens) - 1)
        at = np.flatnonzero(self.tokens[place] == ids)
        if not len(at):
            return []
        s = np.full(len(ids), -self.drift)
        s[at] = self.weights[place[at]]
        edge = self.log_k + np.log(len(ids))
        return [(a, b, e) for a, b, total in maximal_segments(s, at) if (e := self.lam * total - edge) > 0]

    def evidence(self, ids: np.ndarray) -> float:
        return float(sum(e for *_, e in self.segments(ids)))

    def score(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.offset, -30, 30))))


def maximal_segments(s: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float]]:
    """Ruzzo-Tompa over the positive positions ``at`` of ``s``: disjoint maximal
    scoring segments (start, end, total), linear in the number of positives."""
    total = np.concatenate([[0.0], np.cumsum(s)])
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum left of start, sum up to end
    for i in at.tolist():
        start, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r in stack]


def log_odds(toxic, other, corpus, n_toxic: float, n_other: float, n_corpus: float) -> np.ndarray:
    """z of each token's log-odds; the prior is as heavy as the labelled tokens."""
    p0 = n_toxic + n_other
    prior = corpus / max(1, n_corpus) * p0 + 1e-9
    a, b = toxic + prior, other + prior
    delta = np.log(a / (n_toxic + p0 - a + 1e-9)) - np.log(b / (n_other + p0 - b + 1e-9))
    return delta / np.sqrt(1 / a + 1 / b)


def binomial_log_tail(hits: np.ndarray, misses: np.ndarray, share: float) -> np.ndarray:
    """Chernoff bound of ln P(at least ``hits`` of hits + misses) when each is a hit with probability ``share``."""
    n, share = hits + misses, min(max(share, 1e-9), 1 - 1e-9)
    rate = np.clip(hits / n, 1e-12, 1 - 1e-12)
    bound = -n * (rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share)))
    return np.where(rate > share, bound, 0.0)


def karlin_lambda(values: np.ndarray, share: np.ndarray) -> float:
    """Positive root of E[exp(lambda * s)] = 1 for a score with negative mean."""
    low, high = 0.0, 1.0
    value = lambda x: float((share * np.exp(np.clip(x * values, -700, 700))).sum()) - 1
    while value(high) < 0 and high < 1e3:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return (low + high) / 2


def _document_counts(rows: DataFrame, groups: int, only: np.ndarray | None = None) -> DataFrame:
    """token, n0 .. n(groups-1): documents with the token by group. The row of the null token has the totals of
    all tokens. ``rows``: text and group; ``only``: sorted ids of the tokens to count (default all)."""
    shared = rows.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = shared.value
        for b in batches:
            texts, group = b.column(0).to_pylist(), b.column(1).to_pylist()
            for g in range(groups):
                parts = [np.unique(token_ids(t)) for t, k in zip(texts, group, strict=True) if k == g]
                found = np.concatenate([np.zeros(0, np.int64), *parts])
                total = len(found)
                if want is not None and len(want):
                    found = found[want[np.minimum(np.searchsorted(want, found), len(want) - 1)] == found]
                token, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None, *token.tolist()], pa.int64()), pa.array([g] * (len(token) + 1), pa.int32()),
                     pa.array([total, *n.tolist()], pa.int64())], names=["token", "g", "n"])

    return rows.mapInArrow(run, "token long, g int, n long").groupBy("token").agg(
        *[F.coalesce(F.sum(F.when(F.col("g") == g, F.col("n"))), F.lit(0)).alias(f"n{g}") for g in range(groups)])


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from ``labels`` rows for which ``learn`` (a condition on its id column) holds."""
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if learn is not None:
        usable = usable.filter(learn)
    sample = bounded_sample(usable.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__label")),
                            "__id", max_labelled)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = texts.join(F.broadcast(sample), "__id")  # bounded by max_labelled rows of two numbers
    calibration = id_remainder(F.col("__id"), 4) == 2
    # 0/1: labels behind the weights; 2/3: labels behind the curve
    group = (F.col("__label").cast("int") + F.when(calibration, 2).otherwise(0)).cast("int")
    grouped = staged(rows.select("__text", group.alias("__group"), F.xxhash64("__text").alias("__hash"))
               .dropDuplicates(["__hash", "__group"]).drop("__hash"), "toxic-labelled")
    # a token is a candidate if it is in enough toxic texts, and in a larger share of them than of the others
    counted = staged(_document_counts(grouped, 4), "toxic-counts")
    totals = counted.filter("token IS NULL").toArrow()
    n_other, n_toxic, n_other2, n_toxic2 = (float(_column(totals, f"n{g}").sum()) for g in range(4))
    found = (counted.filter((F.col("token").isNotNull()) & (F.col("n1") >= MIN_TOXIC)
                            & (F.col("n1") * F.lit(n_other) > F.col("n0") * F.lit(n_toxic)))
             .orderBy("token").toArrow())
    tokens = found["token"].to_numpy()
    if len(tokens):
        prior = _document_counts(texts.select("__text", F.lit(0)), 1, tokens).toArrow()
        known = prior["token"].is_valid().to_numpy()
        n_corpus = float(_column(prior, "n0")[~known].sum())
        corpus = np.zeros(len(tokens))
        corpus[np.searchsorted(tokens, prior["token"].drop_null().to_numpy())] = _column(prior, "n0")[known]
        tail = binomial_log_tail(_column(found, "n1"), _column(found, "n0"), n_toxic / max(1.0, n_toxic + n_other))
        z = log_odds(_column(found, "n1"), _column(found, "n0"), corpus, n_toxic, n_other, n_corpus)
        strong = (z >= Z_MIN) & (tail + np.log(len(tokens)) < np.log(CHANCE))
    else:
        z, strong = np.zeros(0), np.zeros(0, bool)
    tokens, weights = tokens[strong], z[strong]
    # how often non-toxic documents show each weight; the floor keeps lambda finite when none does
    share = (_column(found, "n0") + _column(found, "n2"))[strong] / max(1.0, n_other + n_other2)
    drift = max(0.05 * Z_MIN, 4 * float((share * weights).sum()))
    if len(weights):
        values, odds = np.append(weights, [weights.max(), -drift]), np.append(share, [1e-6, 0.0])
        odds[-1] = 1 - odds.sum()
        lam, hit = karlin_lambda(values, odds), float(odds[:-1].sum())
    else:
        lam, hit = 1.0, 1.0
    model = Model(tokens, weights, drift, lam, float(np.log(hit)), 0.0, 0.0)
    held = _evidence_counts(grouped.filter("__group >= 2"), model)
    if held[1].sum() < 5:  # too few kept out: fall back on all labelled rows
        held = held + _evidence_counts(grouped.filter("__group < 2"), model)
    centres = np.arange(held.shape[1]) / 10
    if held[0].sum() and held[1].sum():
        model.slope, model.offset = logistic_on_bins(centres, held[0], held[1])
        model.slope = max(model.slope, 0.0)
    else:
        model.offset = -30.0 if not held[1].sum() else 30.0
    return model


def _evidence_counts(grouped: DataFrame, model: Model, bins: int = 120) -> np.ndarray:
    """Documents by label and by log1p(evidence) in tenths."""
    shared = grouped.sparkSession.sparkContext.broadcast(model)

    def counts(b: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((2, bins), np.int64)
        for text, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            e = np.log1p(shared.value.evidence(token_ids(text)))
            out[g % 2, min(bins - 1, int(round(e * 10)))] += 1
        return out

    return sum_counts(grouped, ["__text", "__group"], counts, (2, bins))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, score (0..1), predicted, passages (word ranges with their evidence)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))
        for b in batches:
            found = [m.segments(token_ids(t)) for t in b.column(1).to_pylist()]
            scores = [m.score(sum(e for *_, e in f)) for f in found]
            passages = [[{"first": int(i), "end": int(j), "evidence": float(e)} for i, j, e in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                 pa.array(passages, kind)], names=[id_col, "score", "predicted", "passages"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {id_type}, score double, predicted int, "
             "passages array<struct<first:bigint,end:bigint,evidence:double>>")


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more; decided row by row, nothing is joined."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, at = shared.value, names.index(text_col)
        for b in batches:
            clean = [m.score(m.evidence(token_ids(t))) < 0.5 for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    model = fit(docs, read_table(spark, sf_dir, "labels"), learn=~held_out)
    scored = score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
