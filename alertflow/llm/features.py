"""Hashed counts shared by the learned operators, and their bounded label samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame


def bounded_sample(rows: DataFrame, id_col: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, those whose ids hash lowest (the same on every run)."""
    return rows.orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(limit)


def sum_counts(df: DataFrame, columns: list[str], counts: Callable[[pa.RecordBatch], np.ndarray],
               shape: tuple[int, int]) -> np.ndarray:
    """Sum of ``counts(batch)`` (an integer array of ``shape``) over all rows.

    Every task adds up its batches and emits its non-zero cells; the cells are
    summed by a shuffle, so the driver receives at most ``shape`` numbers."""
    rows_, cells = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for b in batches:
            total += counts(b)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["cell", "n"])

    summed = (df.select(*columns).mapInArrow(run, "cell long, n long")
              .groupBy("cell").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(rows_ * cells, np.int64)
    out[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    return out.reshape(shape)


def logistic_on_bins(centres: np.ndarray, negative: np.ndarray, positive: np.ndarray,
                     steps: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic curve through binned counts (Newton steps, small ridge)."""
    a, b = 1.0, 0.0
    n = negative + positive
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * centres + b, -30, 30)))
        g = np.array([((positive - n * p) * centres).sum() - 1e-3 * a, (positive - n * p).sum() - 1e-3 * b])
        w = n * p * (1 - p)
        h = np.array([[(w * centres**2).sum() + 1e-3, (w * centres).sum()], [(w * centres).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        a, b = a + float(np.clip(da, -2, 2)), b + float(np.clip(db, -2, 2))
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def id_remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n
