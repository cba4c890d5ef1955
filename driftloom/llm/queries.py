"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftloom.llm import bpe, decontam, embed, langid, licenses, media, mixing, pii, resample, secrets, simhash, tokenbin, whiten
from driftloom.llm.common import tables


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    return langid.identify(docs, "lang", "source").select("doc_id", "lang", "source", "language", "posterior", "text_language", "accepted")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_pages(tables(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(tables(spark, sf_dir, "documents"), vocabulary())


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(tables(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(tables(spark, sf_dir, "documents"))


def op5_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(tables(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(tables(spark, sf_dir, "documents"))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.manifest(tables(spark, sf_dir, "documents"), vocabulary())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(tables(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(tables(spark, sf_dir, "embeddings"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(tables(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(tables(spark, sf_dir, "embeddings"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_bpe, op3_pii, op4_simhash, op5_webp, op6_secrets, op7_training_order, op8_mixing, op9_embeddings, op10_licenses, op11_importance, op12_whitening, op13_decontamination, language_id_pages)
    return {f.__name__: f for f in found}


#: The rows of the other queries can't be had from SQL alone: tests compare them with brute
#: force, an independent library or an exact round trip (tests/llm).
ORACLE_SQL: dict[str, str] = {"op11_importance": resample.SQL, "op13_decontamination": decontam.SQL}
