"""Corpus pipeline: quality rules, near-duplicates, benchmark leaks, personal
data, packing. Each stage takes (spark, docs, sf_dir) and returns a DataFrame;
all but the last return the columns of ``documents``. :func:`run` writes each
result as Parquet into the shared folder of ``spark.checkpoint.dir`` and reads it
back, so a lost executor never reaches behind the stage at hand.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from storyspark.llm import decontam, host_rules, packing, pii, simhash_cover
from storyspark.session import ensure_checkpoint_dir, ship_package
from storyspark.sources.tables import read_table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host rules keep."""
    _ready(spark)
    return host_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    _ready(spark)
    return simhash_cover.keep_one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    _ready(spark)
    return decontam.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    _ready(spark)
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in training sequences."""
    _ready(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality rules", quality), ("simhash near-dedup", near_duplicates), ("benchmark decontamination", decontamination),
          ("pii", personal_data), ("packing", packed)]

#: SQL has no XXH64 majority bits, edit matching or tokenizer; tests compare with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
