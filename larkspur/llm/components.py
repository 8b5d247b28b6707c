"""Connected components of a large edge list, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches) for every node of an edge. edges: a, b (long); loops, repeats and both directions are fine, an edge with a null end is none, and without edges there are no nodes.

    Each round joins every neighbour of a node to the smallest of them, larger neighbours first and then smaller ones, until nothing changes; the
    rounds grow with the logarithm of the longest path. Every round is written, so a lost executor costs one round.
    """
    u, v = F.greatest("a", "b"), F.least("a", "b")
    now = written(edges.dropna().where("a <> b").select(u.alias("u"), v.alias("v")).distinct(), "links")
    before, state = None, _state(now)
    while state != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "links")
        before, state = state, _state(now)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
