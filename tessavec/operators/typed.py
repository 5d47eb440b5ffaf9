"""Collections whose metadata is the JSON of a typed item."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import checked_query
from ..plans.predicate import Predicate, lookups
from . import mutate
from .collection import Collection, where_rows
from .search import exact_topk, hybrid_post


@dataclass(frozen=True)
class TypedCollection:
    """``schema``: the item's DDL. ``defaults``: values of fields that can't be null, where the JSON lacks them.

    ``indexed`` names fields that ``collection.rows`` has as columns of their own.
    """

    collection: Collection
    schema: str
    indexed: Sequence[str] = ()
    defaults: dict[str, object] = field(default_factory=dict)

    def rows(self) -> DataFrame:
        """Live rows with their item; metadata that is JSON null or no JSON has none."""
        text = F.trim("metadata")
        item = F.when(text.startswith("{"), F.from_json("metadata", f"{self.schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"}))
        rows = self.collection.live().withColumn("item", item)
        return rows.withColumn("item", F.when(F.col("item.__bad").isNull() & F.col("item").isNotNull(), F.col("item").dropFields("__bad")))

    def _column(self, name: str) -> Column:
        if name in self.indexed:
            return F.col(name)
        x = F.col(f"item.{name}")
        return F.coalesce(x, F.lit(self.defaults[name])) if name in self.defaults else x

    def _matches(self, predicate: Predicate) -> Column:
        return F.col("item").isNotNull() & predicate.column(self._column)

    def mode(self, predicate: Predicate) -> str:
        """``pre`` where indexed fields answer the predicate, else ``post``."""
        return "post" if lookups(predicate, self.indexed) is None else "pre"

    def where(self, predicate: Predicate, max_results: int = 100) -> DataFrame:
        return where_rows(self.rows(), self._matches(predicate), max_results).select("id", "item")

    def search(self, query: Sequence[float], predicate: Predicate | None = None, k: int = 5, ef: int = 50, mode: str | None = None) -> DataFrame:
        """(id, score, item). Without ``mode``: exact over the matching rows if indexed fields answer, else a filtered beam."""
        rows, distance = self.rows(), self.collection.config.distance
        query = checked_query(query, self.collection.config.dim)
        if predicate is None:
            found = exact_topk(rows, query, k, None, distance)
        elif (mode or self.mode(predicate)) == "pre":
            found = exact_topk(rows, query, k, self._matches(predicate), distance)
        else:
            found = hybrid_post(rows, query, self._matches(predicate), k, ef, distance)
        return found.select("id", "score", "item")


    def _with(self, collection: Collection) -> TypedCollection:
        return replace(self, collection=collection)

    def add(self, items: DataFrame, order: str = "batch_ord") -> TypedCollection:
        """Inserts (id, vector, item, ``order``): the item becomes the metadata, and indexed fields follow. A null id gets a random one."""
        batch = _as_metadata(items).withColumn("id", F.coalesce("id", F.uuid()))
        return self._with(mutate.insert(self.collection, batch, order))

    def update(self, items: DataFrame) -> TypedCollection:
        """New vectors and items of live rows (id, vector, item; null: as before); unknown ids change nothing."""
        return self._with(mutate.update(self.collection, _as_metadata(items)))

    def update_items(self, items: DataFrame) -> TypedCollection:
        """New items of live rows (id, item); vectors and ordinals stay."""
        return self._with(mutate.update_metadata(self.collection, _as_metadata(items)))

    def delete(self, ids: DataFrame) -> TypedCollection:
        return self._with(mutate.delete(self.collection, ids))


def _as_metadata(items: DataFrame) -> DataFrame:
    return items.withColumn("metadata", F.when(F.col("item").isNotNull(), serialize(F.col("item")))).drop("item")


def serialize(item: Column) -> Column:
    return F.to_json(item)
