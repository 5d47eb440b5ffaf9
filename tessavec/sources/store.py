"""Collections in storage: data folders that never change, and numbered versions that say which of them count.

``<path>/_versions/<number>.json`` names the data folders, the deletions and the configuration of one version. A
version file is written beside its place and then renamed to it, which fails if the number is taken; so versions
appear whole, readers see the old or the new one, and of two writers one starts again on the other's version. An
insert writes its own rows only, and a delete only the ordinals that go. ``compact`` rewrites the rows into one folder,
and ``clean`` removes what no remaining version names.

On object stores without an atomic rename, writers of one collection must be kept apart by other means.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CollectionConfig
from ..operators import mutate
from ..operators.collection import Collection
from .shared import file_system, remove


@dataclass(frozen=True)
class Version:
    """``data``: folders of rows. ``gone``: folders of ordinals (column ord) that are deleted. ``schema``: of the rows, as JSON."""

    number: int
    config: CollectionConfig
    schema: str
    data: tuple[str, ...] = ()
    gone: tuple[str, ...] = ()

    def to_json(self) -> str:
        return json.dumps({"config": json.loads(self.config.to_json()), "schema": json.loads(self.schema), "data": self.data, "gone": self.gone}, sort_keys=True)

    @staticmethod
    def from_json(number: int, text: str) -> Version:
        x = json.loads(text)
        return Version(number, CollectionConfig.from_json(json.dumps(x["config"])), json.dumps(x["schema"]), tuple(x["data"]), tuple(x["gone"]))


class Taken(Exception):
    """Another writer has made the version of this number."""


def _folder(path: str) -> str:
    return f"{path}/_versions"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all versions, ascending; none where there is no collection."""
    fs, at = file_system(spark, _folder(path))
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def read_version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version of the collection, the newest by default."""
    if number is None:
        found = versions(spark, path)
        if not found:
            raise FileNotFoundError(f"no collection at {path}")
        number = found[-1]
    fs, at = file_system(spark, f"{_folder(path)}/{number:012d}.json")
    stream = fs.open(at)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return Version.from_json(number, text)


def _commit(spark: SparkSession, path: str, version: Version) -> None:
    """Makes the version; raises ``Taken`` if its number is taken."""
    final = f"{_folder(path)}/{version.number:012d}.json"
    own = f"{_folder(path)}/_{uuid.uuid4().hex}"
    fs, at = file_system(spark, own)
    out = fs.create(at)
    out.write(bytearray(version.to_json().encode()))
    out.close()
    sc = spark.sparkContext
    rename = sc._jvm.org.apache.hadoop.fs
    options = sc._gateway.new_array(getattr(rename, "Options$Rename"), 0)
    try:
        context = rename.FileContext.getFileContext(fs.makeQualified(at).toUri(), sc._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(at), fs.makeQualified(file_system(spark, final)[1]), options)
    except Py4JJavaError as e:
        fs.delete(at, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise Taken(final) from e
        raise


def _write(rows: DataFrame, path: str) -> str:
    """The rows in a new folder, of which the name is given back; parts become folders in it."""
    name = f"data-{uuid.uuid4().hex}"
    (rows.write.partitionBy("part") if "part" in rows.columns else rows.write).parquet(f"{path}/{name}")
    return name


def _changed(spark: SparkSession, path: str, change: Callable[[Version], Version], tries: int = 20) -> int:
    """Commits what ``change`` makes of the newest version, again on the newer one where another writer was first."""
    for _ in range(tries):
        last = read_version(spark, path)
        new = change(last)
        try:
            _commit(spark, path, replace(new, number=last.number + 1))
            return last.number + 1
        except Taken:
            continue
    raise TimeoutError(f"other writers were first {tries} times")


def save(collection: Collection, path: str) -> int:
    """Writes all rows as the next version, whatever the version before has; its number."""
    spark = collection.rows.sparkSession
    name, schema = _write(collection.rows, path), collection.rows.schema.json()
    while True:
        number = max(versions(spark, path), default=-1) + 1
        try:
            _commit(spark, path, Version(number, collection.config, schema, (name,)))
            return number
        except Taken:
            continue


def load(spark: SparkSession, path: str, number: int | None = None) -> Collection:
    """The newest version, or that of a number."""
    return _collection(spark, path, read_version(spark, path, number))


def _collection(spark: SparkSession, path: str, version: Version) -> Collection:
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(json.loads(version.schema))
    rows = None
    for name in version.data:
        part = spark.read.schema(schema).parquet(f"{path}/{name}").select(*schema.names)
        rows = part if rows is None else rows.unionByName(part)
    rows = spark.createDataFrame([], schema) if rows is None else rows
    if version.gone:
        gone = spark.read.schema("ord long").parquet(*[f"{path}/{name}" for name in version.gone]).distinct().withColumn("__gone", F.lit(True))
        rows = rows.join(gone, "ord", "left").withColumn("deleted", F.col("deleted") | F.coalesce("__gone", F.lit(False)))
    return Collection(rows.select(*schema.names), version.config)


def create(spark: SparkSession, path: str, config: CollectionConfig) -> Collection:
    """An empty collection; raises where there is one already."""
    kind = "double" if config.distance == "cosine" else "float"
    extra = "".join(f", `{n}` {t}" for n, t in config.indexed.items()) + (", part long" if config.partition_size else "")
    rows = spark.createDataFrame([], f"ord long, id string, vector array<{kind}>, metadata string, deleted boolean{extra}")
    try:
        _commit(spark, path, Version(0, config, rows.schema.json()))
    except Taken as e:
        raise FileExistsError(f"there is a collection at {path}") from e
    return load(spark, path)


def append(spark: SparkSession, path: str, batch: DataFrame, order: str = "batch_ord") -> int:
    """Inserts a batch into the stored collection, writing its new rows only; the version's number.

    A batch of ids that are all live already makes a version with an empty folder, and no other change.
    """

    def change(last: Version) -> Version:
        base = _collection(spark, path, last)
        rows = mutate.appended(base, batch, order)
        missing = [f for f in base.rows.schema.fields if f.name not in rows.columns]
        rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}).select(*base.rows.columns)
        return replace(last, data=(*last.data, _write(rows, path)))

    return _changed(spark, path, change)


def delete(spark: SparkSession, path: str, ids: DataFrame) -> int:
    """Deletes the live rows with these ids (column id) in the stored collection, writing their ordinals only."""

    def change(last: Version) -> Version:
        name = f"gone-{uuid.uuid4().hex}"
        live = _collection(spark, path, last).live()
        live.join(ids.select("id").distinct(), "id", "left_semi").select("ord").write.parquet(f"{path}/{name}")
        return replace(last, gone=(*last.gone, name))

    return _changed(spark, path, change)


def compact(spark: SparkSession, path: str) -> int:
    """Rewrites the newest version's rows into one folder, with deletions applied; ordinals stay."""

    def change(last: Version) -> Version:
        return replace(last, data=(_write(_collection(spark, path, last).rows, path),), gone=())

    return _changed(spark, path, change)


def clean(spark: SparkSession, path: str, keep: int = 1, min_age_seconds: float = 3600) -> list[str]:
    """Removes all but the newest ``keep`` versions and the folders that only they name; the names of those folders.

    Folders younger than ``min_age_seconds`` stay, as a writer may be about to name them. Readers of a removed version fail.
    """
    found = versions(spark, path)
    kept = found[-max(1, keep) :]
    named = {n for v in kept for r in (read_version(spark, path, v),) for n in (*r.data, *r.gone)}
    for v in found[: -len(kept)]:
        remove(spark, f"{_folder(path)}/{v:012d}.json")
    fs, at = file_system(spark, path)
    now, gone = spark.sparkContext._jvm.System.currentTimeMillis(), []
    for f in fs.listStatus(at):
        name = f.getPath().getName()
        old = now - f.getModificationTime() >= min_age_seconds * 1000
        if name.startswith(("data-", "gone-")) and name not in named and old:
            remove(spark, f"{path}/{name}")
            gone.append(name)
    return sorted(gone)
