"""Collections: immutable snapshots of (ord, id, vector, metadata, deleted) and promoted item fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CollectionConfig
from ..functions.vector import is_valid_vector, l2_normalize, truncated_utf8
from ..sources.shared import release

COLUMNS = ("ord", "id", "vector", "metadata", "deleted")


@dataclass(frozen=True)
class Collection:
    rows: DataFrame
    config: CollectionConfig

    def live(self) -> DataFrame:
        return self.rows.where(~F.col("deleted"))

    def get_by_id(self, doc_id: str) -> DataFrame:
        """Vector and metadata of a live row; empty where there is none."""
        return self.live().where(F.col("id") == doc_id).select("id", "vector", "metadata")

    def counts(self) -> DataFrame:
        """allocated_count (with deleted rows), deleted_count, live_count."""
        gone = F.col("deleted").cast("int")
        return self.rows.agg(F.count("*").alias("allocated_count"), F.coalesce(F.sum(gone), F.lit(0)).cast("long").alias("deleted_count"), F.coalesce(F.sum(1 - gone), F.lit(0)).cast("long").alias("live_count"))

    def healthy(self) -> bool:
        return self.config.healthy() and set(COLUMNS) <= set(self.rows.columns)

    def close(self) -> int:
        """Releases the intermediate results of this session's mutations; save what is to be kept before."""
        return release(self.rows.sparkSession)

    def with_rows(self, rows: DataFrame) -> Collection:
        return replace(self, rows=rows)


def from_rows(df: DataFrame, config: CollectionConfig) -> Collection:
    """``df`` has ord, id, vector, metadata and maybe deleted; prepares vectors and metadata as an insert does."""
    if "deleted" not in df.columns:
        df = df.withColumn("deleted", F.lit(False))
    return Collection(prepare(df, config), config)


def empty_id_filled(df: DataFrame) -> DataFrame:
    """Rows of before ids existed get random ones."""
    return df.withColumn("id", F.coalesce("id", F.uuid()))


def prepare(df: DataFrame, config: CollectionConfig) -> DataFrame:
    """Checks vectors, makes unit vectors under cosine, cuts metadata, promotes indexed item fields.

    A vector of another dimension or with null, NaN or infinite components raises when the rows are read.
    """
    v = F.col("vector")
    checked = F.when(is_valid_vector(v, config.dim), v).otherwise(F.raise_error(F.lit(f"a vector needs {config.dim} finite components")).cast("array<float>"))
    df = df.withColumn("vector", checked)
    if config.distance == "cosine":
        df = df.withColumn("vector", l2_normalize(F.col("vector")))
    return promote(df.withColumn("metadata", stored_metadata(F.col("metadata"), config)), config)


def stored_metadata(text: Column, config: CollectionConfig) -> Column:
    """Metadata as every write keeps it: cut at the limit of bytes, if there is one."""
    return text if config.metadata_max_bytes is None else truncated_utf8(text, config.metadata_max_bytes)


def promote(df: DataFrame, config: CollectionConfig) -> DataFrame:
    """Indexed fields as columns, from the metadata's JSON; equality on them reaches the Parquet scan."""
    if not config.indexed:
        return df
    top = {n: t for n, t in config.indexed.items() if n not in config.paths}
    found = {n: F.get_json_object("metadata", path).cast(config.indexed[n]) for n, path in config.paths.items()}
    if top:
        item = F.from_json("metadata", ", ".join(f"`{n}` {t}" for n, t in top.items()))
        found |= {n: item[n] for n in top}
    return df.withColumns(found)


def opaque(function, *names: str) -> Column:
    """A predicate from a Python function of the values of some columns (``metadata`` if none are named).

    It runs on Arrow batches; no index can answer it, so it belongs after cheaper predicates.
    """

    @F.pandas_udf("boolean")
    def matches(*columns: pd.Series) -> pd.Series:
        return pd.Series([bool(function(*values)) for values in zip(*columns, strict=True)], dtype="bool")

    return matches(*[F.col(n) for n in names or ("metadata",)])


def where_rows(rows: DataFrame, predicate: Column, max_results: int = 100, order: str = "ord") -> DataFrame:
    """The first ``max_results`` matching rows in the order of their ordinals; none for 0 or less."""
    return rows.where(predicate).orderBy(order).limit(max(0, max_results))


def where(collection: Collection, predicate: Column, max_results: int = 100) -> DataFrame:
    return where_rows(collection.live(), predicate, max_results).select("id", "metadata")


def where_indexed(collection: Collection, pairs: Sequence[tuple[str, object]], max_results: int = 100) -> DataFrame:
    """Conjunction of equalities on promoted fields; no pairs give no rows."""
    if not pairs:
        return collection.live().select("id", "metadata").limit(0)
    predicate = F.lit(True)
    for name, value in pairs:
        predicate = predicate & (F.col(name) == F.lit(value))
    return where(collection, predicate, max_results)


def first_match(collection: Collection, predicate: Column) -> DataFrame:
    return where(collection, predicate, 1)


def postings(rows: DataFrame, fields: Sequence[str] | Mapping[str, Column]) -> DataFrame:
    """One row per (field, value, ord), which no hot value can overflow; null values have none.

    ``fields`` are names of columns, or extractors by name: columns over the row, of which an array gives several values.
    """
    named = dict(fields) if isinstance(fields, Mapping) else {f: F.col(f) for f in fields}
    kinds = rows.select(*[c.alias(f"f{k}") for k, c in enumerate(named.values())]).schema.fields
    pairs = []
    for (name, column), kind in zip(named.items(), kinds, strict=True):
        values = column if isinstance(kind.dataType, T.ArrayType) else F.array(column)
        pairs.append(F.transform(values, _posting(name)))
    every = F.flatten(F.filter(F.array(*pairs), lambda x: x.isNotNull()))
    return rows.select("ord", F.explode(F.array_distinct(every)).alias("p")).where("p.value is not null").select("p.field", "p.value", "ord")


def _posting(name: str):
    return lambda value: F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"))


def inverted_index(rows: DataFrame, fields: Sequence[str] | Mapping[str, Column]) -> DataFrame:
    """(field, value, n, lowest): of every posting list its length and first ordinal."""
    return postings(rows, fields).groupBy("field", "value").agg(F.count("*").alias("n"), F.min("ord").alias("lowest"))
