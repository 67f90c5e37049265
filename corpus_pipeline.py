"""A training-data pipeline over ``documents``: five stages, each written and read again.

Language ID drops what it rejects, near-duplicate search keeps one document of
each group, decontamination drops documents with benchmark passages, personal
data are masked, and what is left is encoded and decoded again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import bpe_chunks, decontaminate, language_id, near_dup, pii_crf
from loomwork.llm.common import checkpoint_dir, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_crf.mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_chunks.query(docs)


STAGES = [
    ("language ID", identify),
    ("MinHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("PII", mask),
    ("BPE encoding and decoding", encode),
]

#: Compression, sketches and byte-pair merges have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each keeps is a Parquet table in the shared folder, removed when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    at = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{k - 1}")
            before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(before, True)
    return docs
