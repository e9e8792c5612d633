"""Lookups and joins over the relations. Rows are bags unless an operator says it gives sets.

Only the named columns are read; extra columns don't matter. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions import text as X

FUNCTION = "function"


def _bound(rows: DataFrame, **values) -> DataFrame:
    for column, v in values.items():
        if v is not None:
            rows = rows.where(F.col(column) == F.lit(v))
    return rows


def symbol_def(defs: DataFrame, file=None, symbol=None, line=None, kind=None) -> DataFrame:
    """(file, symbol, line, kind) with any of them bound."""
    return _bound(defs.select("file", "symbol", "line", "kind"), file=file, symbol=symbol, line=line, kind=kind)


def calls(rows: DataFrame, caller=None, callee=None) -> DataFrame:
    """(caller, callee), one row for each call site; with callee bound, who calls it."""
    return _bound(rows.select("caller", "callee"), caller=caller, callee=callee)


def edge_multiplicity(rows: DataFrame) -> DataFrame:
    """(caller, callee, n_sites)."""
    return rows.groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("n_sites"))


def symbols_matching(defs: DataFrame, pattern: str, bag: bool = False) -> DataFrame:
    """(symbol) holding the pattern; as a bag, one row for each place in each definition."""
    hits = defs.select("symbol").where(X.matches(F.col("symbol"), pattern))
    if not bag:
        return hits.distinct()
    return hits.select("symbol", F.explode(F.sequence(F.lit(1), X.occurrences(F.col("symbol"), pattern))).alias("_i")).select("symbol")


def functions(defs: DataFrame) -> DataFrame:
    """(symbol) of all functions, once each."""
    return defs.where((F.col("kind") == FUNCTION) & F.col("symbol").isNotNull()).select("symbol").distinct()


def leaf_symbols(defs: DataFrame, rows: DataFrame, bag: bool = False) -> DataFrame:
    """(symbol) of functions without any call row; as a bag, one row for each definition."""
    fs = defs.where((F.col("kind") == FUNCTION) & F.col("symbol").isNotNull()).select("symbol")
    callers = rows.select(F.col("caller").alias("_c")).where(F.col("_c").isNotNull()).distinct()
    return (fs if bag else fs.distinct()).join(callers, F.col("symbol") == F.col("_c"), "left_anti")


def entry_points(defs: DataFrame, rows: DataFrame, pattern: str) -> DataFrame:
    """(symbol): matching symbols that call something and that nobody calls."""
    callers = rows.select(F.col("caller").alias("_c")).distinct()
    callees = rows.select(F.col("callee").alias("_d")).distinct()
    return symbols_matching(defs, pattern).join(callers, F.col("symbol") == F.col("_c"), "left_semi").join(
        callees, F.col("symbol") == F.col("_d"), "left_anti"
    )


def isolated_leaves(defs: DataFrame, rows: DataFrame, fewer_than: int = 3) -> DataFrame:
    """(symbol, n_callers): leaves with fewer call rows to them, none included."""
    n = rows.groupBy(F.col("callee").alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    got = F.coalesce("_n", F.lit(0)).cast("bigint")
    return (
        leaf_symbols(defs, rows)
        .join(n, F.col("symbol") == F.col("_d"), "left")
        .select("symbol", got.alias("n_callers"))
        .where(F.col("n_callers") < fewer_than)
    )


def first_definition(defs: DataFrame) -> DataFrame:
    """The first row by ord of each symbol: (symbol, file, line, kind). Null symbols are left out."""
    best = F.min(F.struct("ord", "file", "line", "kind")).alias("b")
    return defs.where(F.col("symbol").isNotNull()).groupBy("symbol").agg(best).select("symbol", "b.file", "b.line", "b.kind")


def ordered_match(order: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of an order whose symbol is wanted, their places kept."""
    return order.join(wanted.select(F.col("symbol").alias("_w")).distinct(), F.col("symbol") == F.col("_w"), "left_semi")


def function_names(symbols: DataFrame, identifiers_only: bool = False) -> DataFrame:
    """(symbol, first_ord): scopes but <global>, with where each came first; if wanted, identifiers only."""
    named = symbols.where((F.col("symbol") != "<global>") & F.col("symbol").isNotNull())
    return (
        (named.where(X.is_identifier(F.col("symbol"))) if identifiers_only else named)
        .groupBy("symbol")
        .agg(F.min("ord").alias("first_ord"))
    )


def first_in_scope(symbols: DataFrame) -> DataFrame:
    """(ord, file, symbol, line, context): in each scope but <global> the first row with a parenthesis."""
    best = F.min(F.struct("ord", "file", "line", "context")).alias("b")
    return (
        symbols.where((F.col("symbol") != "<global>") & F.contains(F.col("context"), F.lit("(")))
        .groupBy("symbol")
        .agg(best)
        .select("b.ord", "b.file", "symbol", "b.line", "b.context")
    )


def extract_definitions(symbols: DataFrame, grammar: str = "loose") -> DataFrame:
    """(ord, file, symbol, line, context): function definitions by scope and what <global> lines define.

    grammar loose takes symbol_in_context without functions, strict takes global_definition.
    """
    rule = X.symbol_in_context if grammar == "loose" else X.global_definition
    found = (
        symbols.where(F.col("symbol") == "<global>")
        .withColumn("_d", rule(F.col("context")))
        .where(F.col("_d").isNotNull() & (F.col("_d.kind") != "function"))
        .select("ord", "file", F.col("_d.name").alias("symbol"), "line", "context")
    )
    return first_in_scope(symbols).unionByName(found)


def extract_calls(symbols: DataFrame) -> DataFrame:
    """(ord, file, caller, line, context, callee): calls that the lines of a scope make.

    One set-oriented pass over the listing; keywords and the scope's own header are no calls.
    """
    names = F.array_distinct(F.filter(X.all_callees(F.col("context")), lambda x: x != F.col("symbol")))
    return symbols.where((F.col("symbol") != "<global>") & F.contains(F.col("context"), F.lit("("))).select(
        "ord", "file", F.col("symbol").alias("caller"), "line", "context", F.explode(names).alias("callee")
    )


def callers_listing(rows: DataFrame) -> DataFrame:
    """(callee, caller) once each: the calls the other way round."""
    return rows.where("caller is not null and callee is not null").select("callee", "caller").distinct()


def includes(symbols: DataFrame) -> DataFrame:
    """(file, line, included) of all include lines."""
    return symbols.select(X.normalize_path(F.col("file")).alias("file"), "line", X.included_file(F.col("context")).alias("included")).where(
        F.col("included").isNotNull()
    )


def statistics(**tables: DataFrame) -> DataFrame:
    """(relation, n_rows), a row for each relation, empty ones included."""
    parts = [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("relation"), "n_rows") for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
