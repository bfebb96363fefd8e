"""Language identification by hierarchical discrimination.

Features: hashed byte bigrams and trigrams of the whole text, ln(1 + count),
scaled to length 1. First a linear SVM per family (one against the rest) picks
the language family; then one-versus-one linear SVMs, trained only on the
languages of that family, vote on the language. Margins become probabilities
by a logistic curve each; the score is P(family) * P(language in family).

The classifier is fitted on at most ``max_train`` rows, the same number per
language where there are enough (lowest id hash first); prediction reads the
text alone. Languages missing from ``FAMILIES`` are a family of their own.

Defined cases: null text or a text without any letter gives ``und`` with score
0; rows without a language are never learned from; without any row to learn
from every text is ``und``; with one language learned, that one is predicted;
rows are judged one by one; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from alertflow.llm.common import read_table
from alertflow.llm.features import id_remainder, logistic_on_bins

BITS = 11
DIMS = 2 << BITS  # bigrams, then trigrams
MAX_LANGUAGES = 256
MAX_TRAIN = 4_000
UNKNOWN = "und"

#: Language families (public linguistic classification; fixed values, extend freely).
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "pl", "cs", "uk", "bg"],
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTER = re.compile(r"[^\W\d_]")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells and values of the text's vector."""
    b = np.frombuffer(f" {text} ".encode().lower(), np.uint8).astype(np.uint32)
    pair = b[:-1] | b[1:] << np.uint32(8)
    triple = pair[:-1] | b[2:] << np.uint32(16)
    mult, shift = np.uint32(2654435761), np.uint32(32 - BITS)
    counts = np.concatenate([np.bincount((pair * mult >> shift).astype(np.int64), minlength=1 << BITS),
                             np.bincount((triple * mult >> shift).astype(np.int64), minlength=1 << BITS)])
    cells = np.flatnonzero(counts)
    values = np.log1p(counts[cells])
    return cells, values / np.sqrt((values**2).sum())


@dataclass
class LinearSvm:
    """Squared-hinge linear SVM and the logistic curve over its margins."""

    w: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 150) -> LinearSvm:
        """y in {-1, 1}, classes weighted equally; accelerated gradient descent on the primal."""
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
        w, bias, vw, vb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
        rate = 1 / (1 / c + 4.0)
        for t in range(steps):
            slack = np.maximum(0, 1 - y * (x @ vw + vb)) * y * weight
            nw, nb = vw + rate * (2 * (slack @ x) - vw / c), vb + rate * 2 * slack.sum()
            beta = t / (t + 3)
            vw, vb = nw + beta * (nw - w), nb + beta * (nb - bias)
            w, bias = nw, nb
        svm = cls(w, bias)
        margins = x @ w + bias
        svm.slope, svm.offset = logistic_on_bins(margins, (y < 0) * weight * len(y), (y > 0) * weight * len(y))
        return svm

    def probability(self, cells: np.ndarray, values: np.ndarray) -> float:
        margin = float(self.w[cells] @ values) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


@dataclass
class Model:
    members: dict[str, list[str]] = field(default_factory=dict)       # family -> its learned languages
    family: dict[str, LinearSvm] = field(default_factory=dict)
    pairs: dict[tuple[str, str], LinearSvm] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.members or not _LETTER.search(text):
            return UNKNOWN, 0.0
        cells, values = features(text)
        odds = {f: self.family[f].probability(cells, values) if f in self.family else 1.0 for f in self.members}
        family = max(sorted(odds), key=odds.get)
        p_family = odds[family] / max(1e-12, sum(odds.values()))
        langs = self.members[family]
        votes = dict.fromkeys(langs, 0.0)
        for a, b in combinations(langs, 2):
            p = self.pairs[a, b].probability(cells, values)
            votes[a] += p
            votes[b] += 1 - p
        lang = max(langs, key=votes.get)
        p_lang = votes[lang] / (len(langs) - 1) if len(langs) > 1 else 1.0
        return lang, min(1.0, max(0.0, p_family * p_lang))


def train(x: np.ndarray, langs: list[str]) -> Model:
    names = np.array(langs, dtype=object)
    learned = sorted(set(langs))
    family_of = np.array([_FAMILY_OF.get(lang, lang) for lang in langs], dtype=object)
    members: dict[str, list[str]] = {}
    for lang in learned:
        members.setdefault(_FAMILY_OF.get(lang, lang), []).append(lang)
    model = Model(members)
    if len(members) > 1:
        for f in members:
            model.family[f] = LinearSvm.train(x, np.where(family_of == f, 1.0, -1.0))
    for of_family in members.values():
        for a, b in combinations(of_family, 2):
            rows = (names == a) | (names == b)
            model.pairs[a, b] = LinearSvm.train(x[rows], np.where(names[rows] == a, 1.0, -1.0))
    return model


def fit(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", max_train: int = MAX_TRAIN) -> Model:
    """Learn from rows with a language for which ``learn`` holds."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if learn is not None:
        rows = rows.filter(learn)
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("lang")), F.lit(1 << 30)) / (1 << 30)
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place.alias("place"))
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:  # one machine per pair of related languages: a column of free text is refused
        raise ValueError(f"more than {MAX_LANGUAGES} different values of {lang_col}")
    counts = {r["lang"]: r["n"] for r in found}
    if not counts:
        return Model()
    quota = max_train / len(counts)
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, quota / n))])
    sample = rows.filter(F.col("place") < share[F.col("lang")]).orderBy("place", F.xxhash64("text")).limit(max_train)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(lang, *features(t)) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                     if _LETTER.search(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32())),
                 pa.array([f[2].astype(np.float32) for f in found], pa.list_(pa.float32()))], names=["lang", "cells", "vals"])

    got = sample.select("lang", "text").mapInArrow(vectors, "lang string, cells array<int>, vals array<float>").toArrow()
    x = np.zeros((got.num_rows, DIMS), np.float32)
    for i, (cells, vals) in enumerate(zip(got["cells"], got["vals"], strict=True)):
        x[i, cells.values.to_numpy()] = vals.values.to_numpy()
    return train(x, got["lang"].to_pylist()) if got.num_rows else Model()


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    found = predict(docs, fit(docs, learn=~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
