"""The relations: symbol references, definitions and call sites, with the ordinal of the input line."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*names: str) -> T.StructType:
    kinds = {"ord": T.LongType(), "line": T.LongType()}
    return T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])


SYMBOL = _schema("ord", "file", "symbol", "line", "context")
DEF = _schema("ord", "file", "symbol", "line", "context", "kind")
CALLS = _schema("ord", "file", "caller", "line", "context", "callee")
RELATIONS = {"symbol": SYMBOL, "def": DEF, "calls": CALLS}
