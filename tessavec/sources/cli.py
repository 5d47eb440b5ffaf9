"""Command line: ``init`` makes an empty collection, ``add`` appends a vector, ``search`` prints the exact best."""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import SparkSession

from ..config import CollectionConfig
from ..functions.vector import checked_query
from ..operators.search import exact_topk
from .store import append, create, load


def parse_vector(text: str) -> list[float]:
    return [float(x) for x in text.split(",")]


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    parser = argparse.ArgumentParser(prog="tessavec")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("init", "add", "search"):
        commands.add_parser(name).add_argument("--path", required=True)
    commands.choices["init"].add_argument("--dim", type=int, default=1536)
    commands.choices["init"].add_argument("--max", type=int, default=10_000)
    for name in ("add", "search"):
        commands.choices[name].add_argument("--vector", required=True, type=parse_vector)
    commands.choices["add"].add_argument("--metadata", default="{}")
    commands.choices["add"].add_argument("--id", default=None)
    commands.choices["search"].add_argument("--top", type=int, default=3)
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("tessavec").getOrCreate()
    said: list[str] = []
    if given.command == "init":
        create(spark, given.path, CollectionConfig(given.dim, max_count=given.max))
        said.append(f"created {given.path}")
    elif given.command == "add":
        batch = spark.createDataFrame([(given.id or str(uuid.uuid4()), given.vector, given.metadata, 0)], "id string, vector array<float>, metadata string, batch_ord long")
        append(spark, given.path, batch)
        said.append("added")
    else:
        found = load(spark, given.path)
        rows = exact_topk(found.live(), checked_query(given.vector, found.config.dim), given.top, None, found.config.distance).select("id", "score", "metadata").collect()  # --top rows
        said += [f"ID: {r.id}, Score: {r.score:.4f}, Meta: {r.metadata}" for r in rows]
    print("\n".join(said))
    return said


if __name__ == "__main__":
    main()
