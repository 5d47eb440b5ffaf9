"""Neighbour graphs as edge tables (src, rank, dst, score) and their maintenance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import batch_topk


def knn_graph(rows: DataFrame, k: int, dim: int, include_self: bool = False) -> DataFrame:
    """The ``k`` best neighbours of every row, exactly."""
    found = batch_topk(rows.select(F.col("ord").alias("qid"), "vector"), rows, k, dim, exclude_self=not include_self)
    return found.select(F.col("qid").alias("src"), "rank", F.col("ord").alias("dst"), "score")


def prune(edges: DataFrame, m: int) -> DataFrame:
    """With back links, the ``m`` best edges of every node."""
    ways = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    both = edges.select(F.explode(ways).alias("e"), "score").select(F.col("e.a").alias("src"), F.col("e.b").alias("dst"), "score").distinct()  # one pass: the edges may be dear
    window = Window.partitionBy("src").orderBy(F.col("score").desc(), F.col("dst").asc())
    return both.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= m)


def without_nodes(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges that touch none of the deleted nodes (column ord)."""
    gone = deleted.select(F.col("ord").alias("__gone"))
    return edges.join(gone, edges["src"] == F.col("__gone"), "left_anti").join(gone, edges["dst"] == F.col("__gone"), "left_anti")


def entry_point(rows: DataFrame) -> DataFrame:
    """The first live row."""
    return rows.where(~F.col("deleted")).agg(F.min("ord").alias("entry"))


def level_of(key, m: int, levels: int):
    """A level drawn from the MD5 of the key: P(level >= l) = m ** -l, at most levels - 1."""
    u = (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)
    return F.least(F.floor(-F.log(u) / F.lit(math.log(m))).cast("int"), F.lit(levels - 1))
