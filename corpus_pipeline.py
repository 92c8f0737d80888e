"""A training corpus from the documents table: quality, near duplicates, repeats, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of documents, with
n_chars of the text as it is now. A null or empty text fails quality; see the operators for ties, repeated rows and null
ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldgate.llm import bayes, packing, quality, secrets, suffix
from yieldgate.llm.common import shared_dir, table
from yieldgate.llm.entry import vocabulary_path


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now, where the table has that column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that every rule of the cascade lets pass."""
    return quality.keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id."""
    return bayes.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes and more that an earlier document holds."""
    return _measured(suffix.remove_repeats(docs))


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked."""
    return _measured(secrets.mask_secrets(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    return packing.pack_texts(docs, vocabulary_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("masked_secrets", masked_secrets),
    ("packed", packed),
]

#: Packing and the order of ties in it cannot be told in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
