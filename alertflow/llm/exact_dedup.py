"""Exact dedup by content-defined chunk recipes.

A text without its white space is cut where its own content says so: a chunk
is at least ``MIN`` characters, ends after a boundary pair, and is at most
``MAX``. Only chunk digests travel: (64-bit key, SHA-256) per chunk. Keys are
deduplicated into a dictionary that verifies them: a key that stands for more
than one content gets one identifier per content. A document is then the
ordered list of its chunk identifiers, and equal lists are equal texts. Long
texts never move; of equal ones a running maximum keeps (most code points,
smallest doc_id), so a group of any size is pre-aggregated before the shuffle.

Defined cases: null counts as empty, and all texts without a visible character
form one group; a null doc_id is an id of its own and loses ties against
others; of rows that repeat id and length one row stays; an empty table gives
an empty result; extra columns are ignored by ``exact_groups`` and kept by
``drop_copies``. Only DataFrame functions are used.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from alertflow.llm.common import SPACE, free_names, read_table, staged

MIN, MAX = 512, 4096
#: A chunk ends after one of these pairs (any fixed set with a frequency near 1 in 100 serves).
BOUNDARY = r"[aeiou][gkpvy]"

_CHUNK = rf"(?s).{{{MIN},{MAX}}}?(?<={BOUNDARY})|.{{1,{MAX}}}"


def normalised(text: Column) -> Column:
    return F.coalesce(F.translate(text, " \t\n\x0b\x0c\r", ""), F.lit(""))


def chunks(norm: Column) -> Column:
    """The text's chunks in order; concatenated they are the text."""
    return F.regexp_extract_all(norm, F.lit(_CHUNK), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: row_id, doc_id, n_points, text_sha256 and the recipe (ordered chunk identifiers)."""
    norm = normalised(F.col(text_col))
    cut = F.transform(chunks(F.col("norm")), lambda c: F.struct(
        F.xxhash64(c).alias("key"), F.unhex(F.sha2(c.cast("binary"), 256)).alias("sha")))
    rows = staged(docs.select(F.col(id_col).alias("doc_id"),
                              F.coalesce(F.length(F.col(text_col)), F.lit(0)).alias("n_points"), norm.alias("norm"))
                  .select("doc_id", "n_points", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
                          cut.alias("cut"))
                  .withColumn("row_id", F.monotonically_increasing_id()), "dedup-chunks")
    used = rows.select("row_id", F.posexplode("cut").alias("pos", "chunk")).select("row_id", "pos", "chunk.*")
    # the dictionary: a key with one content is its own identifier, any other key is told apart by content
    shared = (used.groupBy("key").agg(F.min("sha").alias("low"), F.max("sha").alias("high"))
              .filter(F.col("low") != F.col("high")).select("key"))
    clash = staged(shared, "dedup-clash")
    ident = F.when(F.col("clash"), F.concat(F.hex("key"), F.lit(":"), F.hex("sha"))).otherwise(F.hex("key"))
    listed = (used.join(clash.withColumn("clash", F.lit(True)), "key", "left")
              .withColumn("clash", F.coalesce("clash", F.lit(False)))
              .groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", ident.alias("id")))).alias("list")))
    return (rows.drop("cut").join(listed, "row_id", "left")
            .withColumn("recipe", F.coalesce(F.col("list.id"), F.array().cast("array<string>"))).drop("list"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    r = staged(recipes(docs, id_col, text_col), "dedup-recipes")
    best = F.max(F.struct(F.col("n_points"), F.col("doc_id").isNotNull().alias("has_id"),
                          (-F.col("doc_id")).alias("low"), (-F.col("row_id")).alias("first"))).alias("best")
    groups = (r.groupBy("recipe").agg(best, F.count(F.lit(1)).alias("group_size"))
              .filter("group_size > 1")
              .select("recipe", "group_size", F.struct((-F.col("best.low")).alias("doc_id"),
                                                       (-F.col("best.first")).alias("row_id")).alias("keeper")))
    # written, so that both sides of the join are dealt for it: a large group's rows can be split among tasks
    joined = r.join(staged(groups, "dedup-groups"), "recipe", "left")
    alone = F.col("keeper").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keeper.row_id") == F.col("row_id"))).alias("kept"), "text_sha256")


def _row_key(id_col: Column, sha: Column) -> Column:
    return F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("null")), sha)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per group of equal texts; same columns.

    What is joined are the keys (id, digest) of the rows that go, which lie in groups of two and more: while they are
    few, no text moves. Rows that repeat the id and text of a row that stays are dealt with on their own, if there are
    any: of those a longest stays."""
    key, n = free_names(docs, "copy_key", "copy_n")
    groups = exact_groups(docs, id_col, text_col).filter("group_size > 1")
    keys = staged(groups.groupBy(_row_key(F.col("doc_id"), F.col("text_sha256")).alias(key)).agg(
        F.count(F.lit(1)).alias("rows"), F.max("kept").alias("kept")).filter("NOT kept OR rows > 1"), "dedup-leaving")
    sha = F.sha2(normalised(F.col(f"`{text_col}`")).cast("binary"), 256)
    mine = docs.withColumn(key, _row_key(F.col(f"`{id_col}`"), sha))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = mine.join(keys.select(key), key, "left_anti").select(*columns)
    repeated = keys.filter("kept")
    if repeated.isEmpty():
        return rest
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.length(F.col(f"`{text_col}`")).desc()))
    once = mine.join(repeated.select(key), key, "left_semi").withColumn(n, first).filter(F.col(n) == 1)
    return rest.unionByName(once.select(*columns))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


def oracle_ctes(table: str = "documents") -> str:
    """DuckDB CTE ``grouped`` (doc_id, keep_id, group_size, kept, text_sha256) over ``table``."""
    return rf"""
normed AS (SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') AS norm
  FROM {table}),
grouped AS (
  SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
    row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
  FROM normed WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


ORACLE = f"WITH {oracle_ctes()}\nSELECT doc_id, keep_id, group_size, kept, text_sha256 FROM grouped"
