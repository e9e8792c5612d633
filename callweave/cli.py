"""Command line: extract, import, query and export."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from callweave.log import RunLog
from callweave.operators import export as E
from callweave.operators import graph as G
from callweave.operators import relations as R
from callweave.plans import pipeline as P
from callweave.sources import lines as L
from callweave.store import Store


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="callweave", description=__doc__)
    a.add_argument("--store", default="knowledge", help="folder of the relations")
    sub = a.add_subparsers(dest="command", required=True)
    x = sub.add_parser("extract", help="listings from a source tree")
    x.add_argument("source"), x.add_argument("out"), x.add_argument("--plain", action="store_true", help="the folder itself only")
    x.add_argument("--dry-run", action="store_true", help="name the files only"), x.add_argument("--quiet", action="store_true", help="file:count lines only")
    i = sub.add_parser("import", help="append a listing")
    i.add_argument("what", choices=["symbol", "def", "calls"]), i.add_argument("path")
    i.add_argument("--strict", action="store_true"), i.add_argument("--listed", action="store_true", help="the callee is a fifth field"), i.add_argument("--stop-on-error", action="store_true"), i.add_argument("--error-log")
    i.add_argument("--log", help="folder of the run's log"), i.add_argument("--debug", type=int, default=0, choices=range(4))
    q = sub.add_parser("query", help="ask the relations")
    q.add_argument("what", choices=["stats", "leaves", "cone", "matching", "levels", "level", "order", "calls", "callers", "reaches"]), q.add_argument("symbol", nargs="?", help="a symbol, pattern or level")
    e = sub.add_parser("export", help="graph as JSON")
    e.add_argument("path"), e.add_argument("--filter"), e.add_argument("--max-nodes", type=int)
    for name in ("clear", "compact"):
        sub.add_parser(name)
    o = a.parse_args(argv)
    spark = SparkSession.builder.appName("callweave").getOrCreate()
    store = Store(spark, o.store)
    try:
        if o.command == "extract":
            _extract(spark, o)
        elif o.command == "import":
            print(P.import_listing(store, o.what, o.path, "listed" if o.listed else "strict" if o.strict else "compat", o.stop_on_error, o.error_log, RunLog(o.log, o.debug) if o.log else None))
        elif o.command == "export":
            E.export_to_file(store.table("def"), store.table("calls"), o.path, o.filter, o.max_nodes)
        elif o.command in ("clear", "compact"):
            getattr(store, o.command)()
        else:
            _query(store, o.what, o.symbol)
    except (ValueError, FileNotFoundError) as err:
        print(err, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130
    return 0


def _extract(spark: SparkSession, o: argparse.Namespace) -> None:
    folder = P.resolve_folder(o.source)
    if o.dry_run:
        for r in L.source_files(spark, folder, not o.plain).select("file").orderBy("file").toLocalIterator():
            print(r[0])
        return
    total = 0
    for name, path in P.write_extracted(spark, folder, o.out, not o.plain).items():
        n = L.count_lines(spark, path)
        total += n
        print(f"{name}:{n}" if o.quiet else f"{name}: {path}, {n} lines")
    if not o.quiet:
        print(f"total: {total} lines")


def _query(store: Store, what: str, symbol: str | None) -> None:
    defs, rows = store.table("def"), store.table("calls")
    if what == "levels":
        print(G.format_all_levels(G.level_listing(G.dependency_levels(defs, rows), rows)))
        return
    if what == "level":
        if not (symbol or "").isdigit():
            raise ValueError("level needs a number")
        print(G.format_level(G.level_listing(G.dependency_levels(defs, rows), rows), int(symbol)))
        return
    if what in ("cone", "matching", "calls", "callers", "reaches") and symbol is None:
        raise ValueError(f"{what} needs a symbol")
    out = {
        "stats": lambda: store.statistics(),
        "leaves": lambda: R.leaf_symbols(defs, rows).orderBy("symbol"),
        "cone": lambda: G.dependency_cone(rows, symbol).orderBy("symbol"),
        "reaches": lambda: G.callers_transitive(rows, symbol).orderBy("symbol"),
        "matching": lambda: R.symbols_matching(defs, symbol).orderBy("symbol"),
        "order": lambda: G.conversion_order(G.dependency_levels(defs, rows)),
        "calls": lambda: R.calls(rows, caller=symbol),
        "callers": lambda: R.calls(rows, callee=symbol),
    }[what]()
    for r in out.toLocalIterator():
        print("\t".join(str(v) for v in r))


if __name__ == "__main__":
    sys.exit(main())
