"""Connected components over an edge table, all in Spark: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a, b; long); root is the smallest node it reaches.

    Every round hangs neighbours on the smallest neighbour until only stars remain. A hub's neighbours are
    reduced by partial minima, and joined by joins of two exchanged sides, whose large partitions can be split.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = _mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc")
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        after = _mark(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stored(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "cc")
