"""Quality rules and a log-likelihood ratio of hashed n-grams.

Base rules: word and symbol counts, repeated lines, words inside repeated
3-word windows; a document fails with fewer than 50 words, or with more than
half of its words in repeated windows. Verdict of the method: two multinomials
over hashed byte n-grams, one of the trusted target (labelled rows of quality
1), one of the raw corpus (every document, whole texts); a document's score is
the mean of ln(target / raw) over its n-grams. It is kept if the score reaches
the threshold, a number fixed once per corpus from the labelled rows that pass
the base rules (dropping a trusted one costs ``TRUSTED_COST`` times as much as
keeping a bad one; the middle of the best interval). Every document is
thresholded the same way.

The target is learned from at most ``max_labelled`` labelled rows (lowest id
hash); the raw counts cover all documents.

Defined cases: null text is empty; a text of fewer than 4 bytes has score 0;
without labels the target equals the raw corpus and no document is rejected
by the method; labels that are null or of unknown documents are ignored, of
repeated ones the lower counts; rows are judged one by one; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from alertflow.llm.common import read_table, staged
from alertflow.llm.features import bounded_sample, sum_counts

BITS = 16
CELLS = 1 << BITS
MAX_LABELLED = 20_000
TRUSTED_COST = 5
MIN_WORDS, MAX_REPEAT = 50, 0.5
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
#: Score bins of the threshold: hundredths from -10 to 5.
_LOW, _BINS = -10.0, 1500


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text, first included."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    k = len(known)
    pair = ids[:-2] * k + ids[1:-1]
    if k > 2_000_000:  # keep the window codes within 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, count = np.unique(pair * k + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[at] > 1)
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[starts + shift] = True
    return int(inside.sum())


def base_metrics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode().split()  # bytes split on exactly [\x20\x09-\x0D]
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return (len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or n_repeat_words > MAX_REPEAT * n_words


def gram_cells(text: str | None) -> np.ndarray:
    """Hashed 4-byte n-grams of the text."""
    b = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.zeros(0, np.int64)
    x = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    return (x * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class Model:
    ratio: np.ndarray   # ln(target / raw) per cell
    threshold: float

    def score(self, text: str | None) -> float:
        cells = gram_cells(text)
        return float(self.ratio[cells].mean()) if len(cells) else 0.0


def _gram_counts(batch: pa.RecordBatch) -> np.ndarray:
    out = np.zeros((1, CELLS), np.int64)
    for text in batch.column(0).to_pylist():
        out[0] += np.bincount(gram_cells(text), minlength=CELLS)
    return out


def _bin(score: float) -> int:
    return int(min(_BINS - 1, max(0, np.floor((score - _LOW) * 100))))


def best_threshold(bad: np.ndarray, trusted: np.ndarray) -> float:
    """Cut between bins that costs least; the middle of the widest run of equal cost; -inf if nothing is to be cut."""
    if not bad.sum() or not trusted.sum():
        return float("-inf")
    kept_bad = bad.sum() - np.concatenate([[0], np.cumsum(bad)])
    lost = np.concatenate([[0], np.cumsum(trusted)])
    cost = kept_bad / bad.sum() + TRUSTED_COST * lost / trusted.sum()
    best = np.flatnonzero(cost == cost.min())
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    run = max(runs, key=len)
    return float("-inf") if run[0] == 0 else _LOW + (run[0] + run[-1]) / 200


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    sample = bounded_sample(usable.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label")),
                            "__id", max_labelled)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    # the sample is bounded by max_labelled rows of two numbers
    labelled = staged(texts.join(F.broadcast(sample), "__id").select("__text", F.col("__label").cast("int").alias("__label")),
                      "quality-labelled")
    raw = sum_counts(texts, ["__text"], _gram_counts, (1, CELLS))[0].astype(float)
    target = sum_counts(labelled.filter("__label = 1"), ["__text"], _gram_counts, (1, CELLS))[0].astype(float)
    if not target.sum():
        target = raw
    # half a count, spread over the cells: both multinomials keep mass everywhere
    smooth = 0.5
    ratio = (np.log((target + smooth) / (target.sum() + smooth * CELLS))
             - np.log((raw + smooth) / (raw.sum() + smooth * CELLS)))
    shared = docs.sparkSession.sparkContext.broadcast(Model(ratio, 0.0))

    def bins(b: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((2, _BINS), np.int64)
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n_words, *_, n_repeat = base_metrics(text)
            if not base_failed(n_words, n_repeat):
                out[int(label == 1), _bin(shared.value.score(text))] += 1
        return out

    bad, trusted = sum_counts(labelled, ["__text", "__label"], bins, (2, _BINS))
    return Model(ratio, best_threshold(bad, trusted))


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            base = [base_metrics(t) for t in texts]
            failed = [base_failed(x[0], x[4]) for x in base]
            scores = [m.score(t) for t in texts]
            kept = [not f and s >= m.threshold for f, s in zip(failed, scores, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([x[i] for x in base], pa.int64()) for i in range(5)),
                 pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(scores, pa.float64())], names=names)

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
             "n_repeat_words long, base_failed boolean, kept boolean, score double")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, read_table(spark, sf_dir, "labels")))
