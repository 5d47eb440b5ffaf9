"""Feeding a stored collection from a stream of (id, vector, metadata) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.shared import release
from ..sources.store import append


def ingest(stream: DataFrame, path: str, checkpoint: str, order: str = "batch_ord") -> StreamingQuery:
    """Starts a query that inserts every micro-batch, writing its new rows only.

    A batch that runs again changes nothing, as its ids are known. Without a column ``order`` the rows of a batch are
    numbered by a hash of their id; of rows with one id the least metadata, then vector, counts.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if order not in batch.columns:
            batch = batch.withColumn(order, F.xxhash64("id"))
        append(spark, path, batch, order)
        release(spark)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).start()
