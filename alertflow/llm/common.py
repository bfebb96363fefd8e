"""Shared pieces of the training-data operators.

White space is ``[\\x20\\x09-\\x0D]`` everywhere; a word is a maximal run of
other characters. Intermediate tables are written as Parquet to the shared
folder that the cluster names in ``spark.checkpoint.dir``, so a lost executor
costs a re-read, never a recomputation of the whole lineage.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from alertflow.session import ensure_checkpoint_dir, ship_package

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts lineage; the
    reread table has known sizes, so the planner picks joins by size)."""
    spark = df.sparkSession
    ship_package(spark)
    path = f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have (upper and lower case count as equal), one for each of ``wanted``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word (vectorised)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
