"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 36-bit hash of its id. Token sums by (source, top 12
bits) are running-summed per source; the bucket in which a source's budget
runs out is split by the next 12 bits, then by the last 12, and nothing else
is looked at again. What comes out is one threshold per source: a document is
taken ``base + (hash < threshold)`` times. No document is sorted; a source
with a third of all rows is summed map-side and never gathered.

Targets: sources by code point, null last, weigh ``weights`` repeating, and
share ``share`` times all sizes; a target stops at ``cap`` times its source's
size and the excess goes to the others by weight until none is above (solved
in one pass over the sources in the order in which they reach their cap).

A source whose target is a whole number of copies (one at its cap) takes exactly
these, so no document comes out more than ``cap`` times.

Defined cases: a null text has size 0; a null source is a source of its own;
a source of size 0 has target 0; a null id hashes as ''; rows with one id
share one decision; an empty table gives an empty result. Extra columns are
ignored by ``mix_plan`` and kept by ``apply_mix``. The number of sources is a
dimension of the corpus (they are ranked in one small window over one row per
source).
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from alertflow.llm.common import free_names, read_table, staged, word_count

#: Parameters of the registered query (fixed values).
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0

_LEVEL_BITS, _LEVELS = 12, 3
_HASH_BITS = _LEVEL_BITS * _LEVELS


def source_key(source: Column) -> Column:
    """Never null: 's' + source, or 'null'."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


def id_hash(id_col: Column) -> Column:
    """First 36 bits of md5 over the id as text."""
    text = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: skey, source_size, target."""
    sums = sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.first("source").alias("source"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sums.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("w", weight)
    # in order of the level at which a source reaches its cap
    order = Window.orderBy((F.col("most") / F.col("w")), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = (ranked.withColumn("most", F.col("source_size") * F.lit(cap))
              .withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
              .withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                          / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
              .withColumn("at", F.row_number().over(order))
              # the first source that stays below its cap fixes the level of all that follow
              .withColumn("final", F.min(F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct("at", "level")))
                          .over(whole)["level"]))
    target = F.when(F.col("final").isNull(), F.col("most")).otherwise(
        F.least(F.col("w") * F.col("final"), F.col("most")))
    return levels.select("skey", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, id_col: str = "doc_id",
             text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(sized, thresholds): per document doc_id, skey, size, h; per source
    skey, source_size, target, base (whole copies of all) and threshold."""
    sized = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                               source_key(F.col(source_col)).alias("skey"), word_count(F.col(text_col)).alias("size"),
                               id_hash(F.col(id_col)).alias("h")), "mix-sized")
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = staged(source_targets(sized, weights, share, cap).withColumn("base", base)
                   .withColumn("need", F.col("target") - F.col("base") * F.col("source_size"))
                   .withColumn("prefix", F.lit(0).cast("long")), "mix-targets")
    for level in range(1, _LEVELS + 1):
        state = staged(_refine(sized, state, level), f"mix-level{level}")
    # a source that takes whole copies only takes no more of any document, wordless ones included
    whole = (F.col("base") > 0) & (F.col("target") <= F.col("base") * F.col("source_size"))
    return sized, state.select("skey", "source_size", "target", "base",
                               F.when(whole, F.lit(0).cast("long")).otherwise(F.col("prefix")).alias("threshold"))


def _refine(sized: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """Extend each source's hash prefix by 12 bits: to the bucket in which the rest of its budget runs out."""
    shift, last = _HASH_BITS - level * _LEVEL_BITS, level == _LEVELS
    rows = sized.select("skey", "size", F.shiftright("h", shift).alias("bucket"))
    if level > 1:
        at = state.select("skey", F.col("prefix"))
        rows = rows.join(at, "skey").filter(F.shiftright("bucket", _LEVEL_BITS) == F.col("prefix")).drop("prefix")
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("size"))
    run = Window.partitionBy("skey").orderBy("bucket")
    cum = (sums.withColumn("cum", F.sum("size").over(run)).join(state.select("skey", "need"), "skey")
           .filter(F.col("cum") > F.col("need"))
           .groupBy("skey").agg(F.min(F.struct("bucket", "cum", "size")).alias("edge")))
    edge, need = F.col("edge"), F.col("need")
    before = edge["cum"] - edge["size"]
    # beyond the last bucket when the budget never runs out within the prefix
    beyond = F.shiftleft(F.col("prefix") + 1, _LEVEL_BITS) if level > 1 else F.lit(1 << _LEVEL_BITS)
    prefix = F.coalesce(edge["bucket"], beyond.cast("long"))
    if last:  # take the edge's documents too when that comes nearer to the budget
        prefix = prefix + F.coalesce((edge["cum"] - need < need - before).cast("long"), F.lit(0))
    return (state.join(cum, "skey", "left")
            .select("skey", "source_size", "target", "base", (need - F.coalesce(before, F.lit(0))).alias("need"),
                    prefix.alias("prefix")))


def _copies(h: Column) -> Column:
    return F.col("base") + (h < F.col("threshold")).cast("long")


def mix(docs: DataFrame, **params) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    sized, thresholds = mix_plan(docs, **params)
    return (sized.join(thresholds, "skey").withColumn("copies", _copies(F.col("h")))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **params) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (0 to ``cap`` times); same columns.

    Only the per-source thresholds are joined: no text is shuffled while they are small."""
    _, thresholds = mix_plan(docs, id_col=id_col, source_col=source_col, **params)
    key, plan, copy = free_names(docs, "mix_key", "mix_plan", "mix_copy")
    t = thresholds.select(F.col("skey").alias(key), F.struct("base", "threshold").alias(plan))
    copies = F.col(plan)["base"] + (id_hash(F.col(f"`{id_col}`")) < F.col(plan)["threshold"]).cast("long")
    return (docs.withColumn(key, source_key(F.col(f"`{source_col}`"))).join(t, key)
            .withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


def oracle_ctes(table: str = "documents") -> str:
    """DuckDB CTEs ending in ``mixed`` (doc_id, size, source_size, target, taken, copies) over ``table``."""
    return rf"""
sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h
  FROM {table}),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w,
    row_number() OVER (ORDER BY source IS NULL, source) AS rk, source_size * 2.0::DOUBLE AS most FROM sums),
levels AS (
  SELECT *, row_number() OVER (ORDER BY most / w, rk) AS pos, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY most / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl
  FROM ranked),
final AS (SELECT arg_min(lvl, pos) FILTER (lvl <= most / w) AS f FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN f IS NULL THEN most ELSE least(w * f, most) END AS target FROM levels, final),
needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base,
    target - base * source_size AS need FROM targets),
runs AS (
  SELECT source, h, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS cum
  FROM sized GROUP BY source, h),
edges AS (
  SELECT n.source, arg_min(r.h, r.h) AS edge, arg_min(r.cum, r.h) AS cum, arg_min(r.cum - r.size, r.h) AS below
  FROM needs n JOIN runs r ON n.source IS NOT DISTINCT FROM r.source AND r.cum > n.need GROUP BY n.source),
cuts AS (
  SELECT n.*, CASE WHEN n.base > 0 AND n.need <= 0 THEN 0
    ELSE coalesce(e.edge + (e.cum - n.need < n.need - e.below)::BIGINT, 68719476736) END AS cut
  FROM needs n LEFT JOIN edges e ON n.source IS NOT DISTINCT FROM e.source),
mixed AS (
  SELECT s.doc_id, s.size, c.source_size, c.target, c.base + (s.h < c.cut)::BIGINT AS copies,
    (s.size * (c.base + (s.h < c.cut)::BIGINT))::BIGINT AS taken
  FROM sized s JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source)"""


ORACLE = f"WITH {oracle_ctes()}\nSELECT doc_id, size, source_size, target, taken, copies FROM mixed"
