"""A corpus pipeline: documents pass five stages, each written as Parquet and read again by the next.

1. quality rules: documents that fail the base or the learned list go.
2. near-duplicates: one document of each group stays.
3. benchmark decontamination: documents that hold a benchmark item go.
4. secret scans: reported spans are masked in the text; no document goes.
5. BPE: what remains is encoded, and the ids decoded again.

All stages but the last return the columns of documents. Nulls, empty texts, ties, repeated rows, empty tables and other
columns are treated as each operator's module says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import bpe, decontaminate, neardup, quality, secrets
from siftlake.session import shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the packed ids and the text decoded from them."""
    out = bpe.bpe_round_trip(docs.select("doc_id", "text"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", mask_secrets),
    ("BPE", bpe_ids),
]

#: SQL can't express learned rules, alignment or BPE: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over documents."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
