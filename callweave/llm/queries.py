"""Queries of the text problems, with SQL for comparison where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import encoding, leaks, mixture, source_files
from callweave.runtime import table


def _files(spark: SparkSession, d: str) -> DataFrame:
    return source_files.classify_files([table(spark, d, t).select("file", "symbol", "context") for t in ("symbol", "def")])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).where(F.col("label") != "handwritten").select(F.col("path").alias("file"))


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select(F.col("path").alias("file"), "label", "confidence")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    return leaks.report_items(leaks.find_leaks(table(spark, d, "documents"), items), items)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_even_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares at the largest size at which every source gets its own."""
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), "even")[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(table(spark, d, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_labels, p6_found, p6_items, p7_mixture, p7_shares, p7_even_shares, p8_found, p8_restored)}


def oracle_sql() -> dict[str, str]:
    return {}
