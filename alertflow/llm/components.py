"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from alertflow.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a > b). Every node's partners are hung on the least node around it: the larger partners and itself
    (large star) or itself and the smaller ones (small star). Minima are aggregated map-side and joined back, so a
    node with any number of partners is never gathered."""
    up = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        around = up.union(down)
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = around.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs); root is the least node reachable.

    The number of rounds grows with the logarithm of the number of nodes; what is left at the end are
    stars, one per component."""
    spread = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = staged(spread, "edges"), None
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        now = staged(_star(staged(_star(now, True), "large-star"), False), "small-star")
        # the sum of the targets falls with every change
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")),
                             F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def extended_components(known: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, root) of the edges behind ``known``, as :func:`connected_components` returns them, and of
    ``edges`` (a, b). Known components count as one node each, so only what ``edges`` changes is worked out."""
    def at_root(name: str) -> DataFrame:
        return known.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))

    between = (edges.join(at_root("a"), "a", "left").join(at_root("b"), "b", "left")
               .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = connected_components(between)
    tops = moved.select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = known.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return staged(old.union(moved.join(known, "node", "left_anti").select("node", "root")), "components")
