"""The operators as queries over the tables that they are meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, maxent, mixing, pages, pii, quality, quotes, secrets, shard, simhash
from .text import spread, table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(spread(table(spark, sf_dir, "documents")))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.sharded(table(spark, sf_dir, "documents"))


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(spread(table(spark, sf_dir, "documents")))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scored(spread(table(spark, sf_dir, "documents")))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(spread(table(spark, sf_dir, "pages")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allocate(table(spark, sf_dir, "documents"))


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.formatted(table(spark, sf_dir, "conversations"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(spread(table(spark, sf_dir, "documents")))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal(spread(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_duplicates, op2_sharding, op3_repetition, op4_language_model, op5_main_text, op6_mixing, op7_benchmark_leaks, op8_chat, op9_secrets, op10_personal_data)}


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": shard.oracle(), "op3_repetition": quality.oracle(), "op6_mixing": mixing.oracle()}
