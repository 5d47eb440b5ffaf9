"""Helpers that the training-data operators share: shared storage, sizing, column handling."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: list[tuple[SparkSession, str]] = []
_TABLES: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a purely local session may go without the setting; it then gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jvm_dir = sc._jsc.sc().getCheckpointDir()
        where = jvm_dir.get() if jvm_dir.isDefined() else None
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tessavec-checkpoints-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tessavec-{name}-{uuid.uuid4().hex}"
    if not _OWN:
        atexit.register(_remove_all)
    _OWN.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Drops this session's catalog entries and removes its intermediate files; results not yet written become unreadable."""
    for session, table in [t for t in _TABLES if t[0] is spark]:
        session.sql(f"DROP TABLE IF EXISTS {table}")
    for session, path in [p for p in _OWN if p[0] is spark]:
        remove(session, path)
    _TABLES[:] = [t for t in _TABLES if t[0] is not spark]
    _OWN[:] = [p for p in _OWN if p[0] is not spark]


def _remove_all() -> None:
    for spark in {id(s): s for s, _ in _OWN}.values():
        try:
            release(spark)
        except Exception:  # the session may be gone already; the folder is then the cluster's to clear
            continue


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, which cuts the lineage; in folders by a column if given.

    Any executor may be lost afterwards: the rows are in the shared store, not in a block manager.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """As ``stored``, bucketed by a column: grouping or joining by it reads the rows where they are."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(table)
    _TABLES.append((spark, table))
    return spark.table(table)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark's Hadoop configuration resolves it; the same on the driver and all executors."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def parts_for(texts: DataFrame, text_col: str, chars: int = 16 << 20) -> int:
    """How many buckets or shards: of about so many characters each, and at least ``spark.sql.shuffle.partitions``."""
    total = texts.agg(F.sum(F.length(quoted(text_col)) + 16)).first()[0] or 0
    return max(partitions(texts.sparkSession), -(-total // chars))


def frugal(run, rows: int = 1024):
    """A function for mapInArrow that sees at most ``rows`` rows at once and gives memory back when its task ends.

    Python workers outlive their tasks, and what their allocators keep counts against the executor.
    """

    def small(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                yield batch.slice(a, rows)

    def wrapped(batches):
        try:
            yield from run(small(batches))
        finally:
            give_back()

    return wrapped


def with_columns_of(df: DataFrame, run, added: dict[str, T.DataType], rows: int = 1024) -> DataFrame:
    """``df.mapInArrow`` of a function that returns all columns of its batches and ``added`` ones after them.

    mapInArrow takes names for paths, so the columns go through it by number and may have any names.
    """
    names = [*df.columns, *added]
    numbers = [f"c{k}" for k in range(len(names))]
    kinds = [f.dataType for f in df.schema.fields] + list(added.values())

    def numbered(batches):
        for batch in run(batches):
            yield batch.rename_columns(numbers)

    schema = T.StructType([T.StructField(n, t) for n, t in zip(numbers, kinds, strict=True)])
    return df.toDF(*numbers[: len(df.columns)]).mapInArrow(frugal(numbered, rows), schema).toDF(*names)


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops input columns that clash with the columns an operator adds."""
    lower = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in lower])


def quoted(name: str):
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def without_ids(df: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows whose id isn't in ``gone`` (column gone); rows with a null id stay. Columns may have any names."""
    packed = df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"), quoted(id_col).alias("id"))
    left = packed.join(gone, packed["id"] == gone["gone"], "left_anti")
    return left.select("row.*")


def hot_keys(table: DataFrame, size: str = "size", shares: int = 1024) -> DataFrame | None:
    """Of ``table``, with one row a key and how many rows have it: the keys with a part of all rows of 1 / ``shares`` or more.

    There can be no more than ``shares`` of them, so they may be broadcast. None where there are none.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    hot = table.where(F.col(size) >= max(1000, -(-total // shares)))
    return None if hot.isEmpty() else hot


def hot_join(rows: DataFrame, table: DataFrame, key: str, size: str = "size") -> DataFrame:
    """Inner join with ``table``, which has each key once and says how many of the rows have it.

    The few hot keys are broadcast and join without a shuffle; the other keys are small and join by exchange.
    ``rows`` is read twice then and should be stored.
    """
    hot = hot_keys(table, size)
    if hot is None:
        return rows.join(table, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def ascii_lower(text):
    """Lower-cases A-Z only; null counts as empty. Texts of ASCII alone take the faster ``lower``."""
    text = F.coalesce(text, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))
