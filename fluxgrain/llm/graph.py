"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (large) or smaller (small) neighbours on its least one."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") > F.col("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is its smallest reachable node.

    Edges are (a, b) pairs of longs in either order; loops, nulls and repetitions don't matter.
    Each round's edges go to the shared folder, so that lineage stays short.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") > F.col("b")).distinct()
    now, before = materialise(pairs, "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before, last = mark, now
        now = materialise(_star(_star(last, large=True), large=False), "edges")
        release(last)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
