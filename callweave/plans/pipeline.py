"""From a source tree or a listing to the stored relations."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from callweave.log import RunLog
from callweave.operators import relations as R
from callweave.runtime import cut, numbered
from callweave.sources import lines as L
from callweave.sources import scanner as S
from callweave.store import Store


def resolve_folder(path: str, root: str | None = None) -> str:
    """A folder named absolutely, relative to root or to the working directory; /c/x is C:/x on Windows."""
    if os.name == "nt" and (m := re.match(r"/([a-zA-Z])/(.*)", path)):
        path = f"{m[1].upper()}:/{m[2]}"
    for p in (path, *( [os.path.join(root, path)] if root else []), os.path.abspath(path)):
        if os.path.isabs(p) and os.path.isdir(p):
            return os.path.abspath(p)
    raise FileNotFoundError(path)


def extract_tree(spark: SparkSession, folder: str, recursive: bool = True) -> dict[str, DataFrame]:
    """symbol, def, calls, callers and includes of a source tree, as DataFrames.

    Ordinals are dense and follow file, line and place within the line.
    """
    scanned = cut(S.scan_lines(L.source_files(spark, folder, recursive)))
    symbol, calls = numbered(S.symbols(scanned), "file", "line"), numbered(S.call_sites(scanned), "file", "line", "place").drop("place")
    return {
        "symbol": symbol,
        "def": numbered(S.definitions(scanned), "file", "line"),
        "calls": calls,
        "callers": R.callers_listing(calls),
        "includes": R.includes(symbol),
    }


def write_extracted(spark: SparkSession, folder: str, out: str, recursive: bool = True) -> dict[str, str]:
    """The five listings as tab-separated text below out; gives their paths.

    Callees have the true callee as a fifth field, which importing them as listed takes up.
    """
    got = extract_tree(spark, folder, recursive)
    calls = got["calls"].withColumnRenamed("caller", "symbol")
    plan = {
        "symbols": (got["symbol"], ("file", "symbol", "line", "context")),
        "definitions": (got["def"], ("file", "symbol", "line", "context")),
        "callees": (calls, ("file", "symbol", "line", "context", "callee")),
        "callers": (got["callers"], ("callee", "caller")),
        "includes": (got["includes"], ("file", "line", "included")),
    }
    for name, (rows, columns) in plan.items():
        L.write_listing(rows, f"{out}/{name}", columns)
    return {n: f"{out}/{n}" for n in plan}


def import_listing(
    store: Store, what: str, path: str, mode: str = "compat", stop_on_error: bool = False, error_log: str | None = None, log: RunLog | None = None
) -> dict[str, int]:
    """Appends a listing to symbol, def or calls; gives processed, succeeded and failed.

    Rows are numbered on from the highest stored ord. Each import replaces the error log.
    """
    lines = L.ordered_lines(store.spark, path, store.next_ord(what))
    if stop_on_error:
        L.stop_on_error(L.ordered_lines(store.spark, path), what)
    rows = {"symbol": L.import_symbols, "def": L.import_defs}[what](lines) if what != "calls" else L.import_calls(lines, mode)
    store.append(what, rows)
    if error_log:
        L.write_error_log(L.parsed(L.ordered_lines(store.spark, path))[1], error_log)
    stats = L.import_stats(lines, "strict" if mode == "strict" else "compat").first().asDict()
    if log:
        log.operation(f"import {what} from {path}: {stats}")
        log.files(lines)
        if log.level > 0:
            for r in L.samples(rows):
                log.debug("sample", str(r))
    return stats
