"""Helpers for text in Python workers."""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import DataFrame

_ASCII_WORD = regex.compile(r"[a-z0-9]+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_INVISIBLE = regex.compile(r"[\p{Cf}͏︀-️]+")


def words(text: str | None) -> list[str]:
    """Runs of letters, marks and digits, case folded, composed, without invisible characters."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    t = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(unicodedata.normalize("NFKC", t.casefold()))


def spread(rows: DataFrame) -> DataFrame:
    """The rows over enough partitions for all cores, when a scan gives fewer."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
