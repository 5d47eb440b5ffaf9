"""A training corpus from raw documents: toxic texts and copies leave, secrets are masked, the rest is packed.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessavec.llm._common import quoted, stored
from tessavec.llm.exact_dedup import drop_duplicates
from tessavec.llm.ngram_join import keep_one_of_each
from tessavec.llm.packing import pack, token_pieces
from tessavec.llm.secrets import redact_secrets
from tessavec.llm.toxicity import fit_severity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model finds toxic go."""
    model = fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).where(~F.col("toxic")).select(*map(quoted, docs.columns))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z) the row with the largest doc_id stays."""
    return drop_duplicates(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.75 or more the one with the smallest doc_id stays."""
    return keep_one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked and the documents stay; n_chars follows the text."""
    masked = redact_secrets(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else masked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 1024 tokens."""
    return pack(token_pieces(docs)).drop("uid")


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("n-gram Jaccard join", ngram_jaccard), ("secret scan", secret_scan), ("best-fit packing", packing)]

#: SQL can express neither the model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
