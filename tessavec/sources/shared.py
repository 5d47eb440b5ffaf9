"""Intermediate results in storage that all executors share, and their release."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEPT: list[tuple[SparkSession, str]] = []


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Path) of a path, resolved by the session's configuration."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local session may go without and gets a temporary folder."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tessavec-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as Parquet in the shared folder; later reads see the same rows.

    The files stay until ``release`` or until the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessavec-settled-{uuid.uuid4().hex}"
    if not _KEPT:
        atexit.register(_at_exit)
    _KEPT.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes what ``settled`` has kept for this session and says how many results that were.

    Collections that were computed from them must have been saved or must no longer be read.
    """
    mine = [x for x in _KEPT if x[0] is spark]
    _KEPT[:] = [x for x in _KEPT if x[0] is not spark]
    for _, path in mine:
        remove(spark, path)
    return len(mine)


def _at_exit() -> None:
    for spark, path in _KEPT:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already; the folder is then the cluster's to clear
            return
