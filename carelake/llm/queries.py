"""The registered queries of the operators: each one over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carelake.llm.common import read_documents
from carelake.sources.tables import table_path


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from carelake.llm.packing import packing_report

    return packing_report(read_documents(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from carelake.llm.tokenfile import token_file_report

    return token_file_report(spark, sf_dir)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from carelake.llm.ngram_join import join_report

    return join_report(read_documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from carelake.llm.exact import duplicate_report

    return duplicate_report(read_documents(spark, sf_dir))


def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from carelake.llm.chat import chat_report

    return chat_report(spark.read.parquet(table_path(sf_dir, "conversations")))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from carelake.llm.secrets import secret_report

    return secret_report(read_documents(spark, sf_dir))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from carelake.llm.mixing import mix_report

    return mix_report(read_documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from carelake.llm.substring import substring_report

    return substring_report(read_documents(spark, sf_dir))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from carelake.llm.pii import pii_report

    return pii_report(read_documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from carelake.llm.quality import quality_report

    return quality_report(read_documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from carelake.llm.prefix_trie import trie_report

    return trie_report(spark.read.parquet(table_path(sf_dir, "conversations")))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from carelake.llm.sketches import sketch_report

    return sketch_report(read_documents(spark, sf_dir))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from carelake.llm.repair import repair_report

    return repair_report(spark.read.parquet(table_path(sf_dir, "conversations")))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}
