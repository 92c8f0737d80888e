"""Queries of the training-data operators and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bayes, bpe, dialogue, fim, langid, media, packing, pseudo, quality, relative, secrets, sharding, suffix
from .common import table


def vocabulary_path() -> str:
    """The byte-level BPE file that the contracts name; the operators take any."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), vocabulary_path())


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op3_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_digest(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op9_relative_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative.relative_digest(table(spark, sf_dir, "documents"))


def op10_bayesian_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes.near_duplicates(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_digest(table(spark, sf_dir, "conversations"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_digest(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_packing, op2_media_columns, op3_bpe_transducer, op4_pseudo_likelihood, op5_suffix_dedup, op6_quality_rules, op7_secret_scans, op8_sharding,
        op9_relative_dedup, op10_bayesian_join, op11_conversation_repair, op12_language_id, op13_fill_in_middle,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_suffix_dedup": suffix.SQL,
        "op6_quality_rules": quality.SQL,
        "op7_secret_scans": secrets.SQL,
        "op8_sharding": sharding.SQL,
        "op9_relative_dedup": relative.SQL,
        "op10_bayesian_join": bayes.SQL,
        "op11_conversation_repair": dialogue.SQL,
        "op13_fill_in_middle": fim.SQL,
    }
