"""Inserts, deletes, updates and synchronisation: every one gives a new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled
from .collection import Collection, prepare, promote, stored_metadata
from .search import partition_of


def first_of_batch(batch: DataFrame, order: str = "batch_ord") -> DataFrame:
    """Of rows with the same id the first by ``order``; of equals the least metadata, then vector."""
    window = Window.partitionBy("id").orderBy(order, "metadata", "vector")
    return batch.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def new_rows(collection: Collection, batch: DataFrame, order: str = "batch_ord") -> DataFrame:
    """Rows of the batch whose id isn't live yet, one each; a known id changes nothing."""
    return first_of_batch(batch, order).join(collection.live().select("id"), "id", "left_anti")


def numbered(rows: DataFrame, start: int, order: str) -> DataFrame:
    """Adds ord: ``start`` and on, in the order of a column.

    Rows are range-partitioned and sorted; each partition adds what the partitions before it hold, so no task
    sees all rows. The rows per partition, one number each, go through the driver. Partition bounds come from
    a sample, so the placed rows are settled first.
    """
    placed = settled(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id()))
    per = placed.groupBy("__p").agg(F.count("*").alias("n"), F.min("__k").alias("first")).collect()
    at, base = start, []
    for r in sorted(per, key=lambda r: r["__p"]):
        base.append(F.struct(F.lit(r["__p"]).alias("__p"), F.lit(at - r["first"]).cast("long").alias("add")))
        at += r["n"]
    if not base:
        return placed.withColumn("ord", F.lit(start).cast("long")).drop("__p", "__k")
    add = F.map_from_entries(F.array(*base))[F.col("__p")]
    return placed.withColumn("ord", F.col("__k") + add).drop("__p", "__k")


def next_ord(collection: Collection) -> int:
    top = collection.rows.agg(F.max("ord")).first()[0]
    return 0 if top is None else top + 1


def insert(collection: Collection, batch: DataFrame, order: str = "batch_ord") -> Collection:
    """Appends the batch (id, vector, metadata, ``order``); ids that are live already stay as they are.

    Raises when more rows than ``max_count`` would be allocated; a batch of known ids never does.
    """
    return collection.with_rows(collection.rows.unionByName(appended(collection, batch, order), allowMissingColumns=True))


def appended(collection: Collection, batch: DataFrame, order: str = "batch_ord") -> DataFrame:
    """The rows that ``insert`` adds, ready to be stored; with a ``partition_size``, each has its part."""
    config = collection.config
    fresh = numbered(new_rows(collection, batch, order), next_ord(collection), order).drop(order).withColumn("deleted", F.lit(False))
    if config.max_count is not None and collection.rows.count() + fresh.count() > config.max_count:
        raise ValueError("the collection is full")
    return with_part(prepare(fresh, config), collection)


def with_part(rows: DataFrame, collection: Collection) -> DataFrame:
    """Adds the part that each row belongs to, where the collection has parts: a full part is followed by a new one."""
    size = collection.config.partition_size
    return rows if size is None else rows.withColumn("part", partition_of(size))


def delete(collection: Collection, ids: DataFrame) -> Collection:
    """Marks the live rows with these ids (column id) deleted; unknown ids change nothing."""
    gone = ids.select("id").distinct().withColumn("__gone", F.lit(True))
    rows = collection.rows.join(gone, "id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("__gone", F.lit(False))).drop("__gone")
    return collection.with_rows(rows.select(*collection.rows.columns))


def _one_each(updates: DataFrame, *columns: str) -> DataFrame:
    """One row per id: of each column the last value that isn't null by ``batch_ord``; of equals, or without it, the greatest."""
    by = lambda c: F.when(F.col(c).isNotNull(), F.struct("batch_ord", c) if "batch_ord" in updates.columns else F.struct(c))
    return updates.groupBy("id").agg(*[F.max_by(c, by(c)).alias(c) for c in columns])


def update_metadata(collection: Collection, updates: DataFrame) -> Collection:
    """New metadata for live rows (id, metadata, maybe batch_ord); ordinals stay, promoted fields follow.

    Of several updates of one id the last counts, see ``_one_each``.
    """
    new = _one_each(updates, "metadata").select("id", F.col("metadata").alias("__new"))
    rows = collection.rows.join(new, "id", "left")
    new = stored_metadata(F.col("__new"), collection.config)
    rows = rows.withColumn("metadata", F.when(~F.col("deleted") & F.col("__new").isNotNull(), new).otherwise(F.col("metadata"))).drop("__new")
    return collection.with_rows(promote(rows, collection.config).select(*collection.rows.columns))


def update(collection: Collection, updates: DataFrame) -> Collection:
    """New vectors or metadata for live rows (id, vector, metadata; null: as before).

    A row with a new vector is deleted and appended again, with a new ordinal after all others, in the order of
    the old ones; one with new metadata alone keeps its place. Unknown ids change nothing. Several updates of
    one id count as one, see ``_one_each``.
    """
    new = _one_each(updates, "vector", "metadata").select("id", F.col("vector").alias("__vector"), F.col("metadata").alias("__metadata"))
    both = collection.rows.join(new, "id", "left")
    moved = ~F.col("deleted") & F.col("__vector").isNotNull()
    touched = ~F.col("deleted") & F.col("__metadata").isNotNull()
    kept = both.withColumns({"deleted": F.col("deleted") | moved, "metadata": F.when(touched & ~moved, stored_metadata(F.col("__metadata"), collection.config)).otherwise(F.col("metadata"))})
    added = both.where(moved).select("id", F.col("ord").alias("__old"), F.col("__vector").alias("vector"), F.coalesce("__metadata", "metadata").alias("metadata"), F.lit(False).alias("deleted"))
    added = numbered(added, next_ord(collection), "__old").drop("__old")
    columns = collection.rows.columns
    kept = promote(kept.drop("__vector", "__metadata"), collection.config).select(*columns)
    added = with_part(prepare(added, collection.config), collection)
    return collection.with_rows(kept.unionByName(added.select(*columns)))


def vacuum(collection: Collection) -> Collection:
    """Live rows only, numbered anew without gaps."""
    live = collection.live().withColumnRenamed("ord", "__old")
    return collection.with_rows(with_part(numbered(live, 0, "__old").drop("__old"), collection).select(*collection.rows.columns))


def latest_by_id(rows: DataFrame) -> DataFrame:
    """Of rows with the same id the one with the largest ordinal; partial maxima meet, not rows."""
    others = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*others), "ord").alias("r")).select("id", "r.*")


def missing_rows(source: Collection, target: Collection) -> DataFrame:
    """Live rows of the source whose id isn't live in the target."""
    return source.live().join(target.live().select("id"), "id", "left_anti")


def sync_from(target: Collection, source: Collection) -> Collection:
    """Appends what is missing, in the source's order; existing rows are neither updated nor deleted."""
    return insert(target, missing_rows(source, target).select("id", "vector", "metadata", F.col("ord").alias("batch_ord")))
