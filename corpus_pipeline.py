"""The corpus pipeline: each stage applies one operator of ``alertflow.llm`` to what its predecessor kept.

toxicity -> exact dedup -> MinHash near-dedup -> mixing -> SentencePiece. All
stages but the last return the columns of their input; the last one adds
``token_ids``. Null, empty and repeated rows are treated as the operators'
modules define; an empty table passes through as an empty table.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from alertflow.llm import exact_dedup, minhash_forest, mixing, sentencepiece_scan, toxicity
from alertflow.llm.common import read_table, staged
from alertflow.llm.features import id_remainder


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; learned from the labels of the registered query's training rows."""
    learn = id_remainder(F.col("doc_id"), 5) != 0
    return toxicity.reject_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels"), learn=learn))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the longest stays."""
    return exact_dedup.drop_copies(docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the smallest id stays."""
    return minhash_forest.drop_near_duplicates(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are left out or repeated (up to twice) so that sources meet their targets."""
    return mixing.apply_mix(docs)


def stage_sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids."""
    return sentencepiece_scan.add_tokens(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("exact_dedup", stage_exact_dedup),
    ("near_dedup", stage_near_dedup),
    ("mixing", stage_mixing),
    ("sentencepiece", stage_sentencepiece),
]

#: Scores, signatures and tokens are not expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
