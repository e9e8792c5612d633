"""Symbol listings straight from C sources: lines with their enclosing function, definitions, calls.

An approximation of a compiler's view by lines: comments and literals are blanked, a function begins
at a header in column 0 outside any brace and ends where its braces close. Preprocessor branches are
all read, old-style parameter lists aren't recognised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callweave.functions import text as X

HEADER = rf"\A[A-Za-z_][A-Za-z0-9_\s\*]*?[\s\*]({X.IDENTIFIER})\s*\([^;]*\)?[^;]*\z"


# Comments and literals, whichever begins first; a line end inside is allowed where the language allows it.
_BLOCK = r"/\*(?s:.*?)(?:\*/|\z)"
_LINE = r"//[^\n\\]*+(?:\\(?s:.)[^\n\\]*+)*+"
_TEXT = r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"'
_CHAR = r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'"
HIDDEN = f"{_BLOCK}|{_LINE}|{_TEXT}|{_CHAR}"


def _blank(text):
    """Comments removed and literals emptied, line ends kept."""
    ends = lambda t: F.regexp_replace(t, r"[^\n]", "")
    kept = F.transform(F.regexp_extract_all(text, F.lit(HIDDEN), 0), lambda t: F.concat(F.when(t.startswith("/"), "").otherwise(F.concat(F.substring(t, 1, 1), F.substring(t, 1, 1))), ends(t)))
    return F.array_join(F.zip_with(F.split(text, HIDDEN, -1), kept, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def scan_lines(files: DataFrame) -> DataFrame:
    """(file, line, context, code, scope, header) of each line of (file, text) rows.

    scope is the enclosing function or <global>; header tells the line that opens it. Null text has
    no lines. A file is one window, as its braces have to be counted in order.
    """
    rows = files.where("text is not null").select("file", F.regexp_replace("text", "\r\n?", "\n").alias("text"))
    both = rows.select("file", F.split("text", "\n", -1).alias("a"), F.split(_blank(F.col("text")), "\n", -1).alias("b"))
    lines = both.select("file", F.posexplode(F.arrays_zip("a", "b")).alias("p", "l")).select(
        "file", (F.col("p") + 1).cast("bigint").alias("line"), F.col("l.a").alias("context"), F.coalesce("l.b", F.lit("")).alias("code")
    )
    count = lambda ch: F.length("code") - F.length(F.replace("code", F.lit(ch)))
    by_file = W.partitionBy("file").orderBy("line")
    before = F.coalesce(F.sum(count("{") - count("}")).over(by_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    name = F.regexp_extract(F.split("code", r"\{", 2)[0], HEADER, 1)
    nested = lines.withColumn("_depth", before).withColumn("_after", before + count("{") - count("}"))
    starts = (F.col("_depth") == 0) & (name != "") & ~F.lower(name).isin(*X.KEYWORDS) & ~F.col("code").rlike(r";\s*\z|\A\s*#|\A\s*typedef")
    marked = nested.withColumn("_start", F.when(starts, name))
    # a header belongs to what follows until the braces have closed again
    last = F.last("_start", ignorenulls=True).over(by_file.rowsBetween(W.unboundedPreceding, W.currentRow))
    inside = (F.col("_depth") > 0) | F.col("_start").isNotNull() | (F.col("code").rlike(r"\A\s*\{"))
    scope = F.when(inside, F.coalesce(last, F.lit("<global>"))).otherwise("<global>")
    tag = F.col("code").rlike(r"\A\s*(?:typedef\s+)?(?:struct|union|enum)\b[^()]*\{")
    group = F.sum(F.when((F.col("_depth") == 0) & (F.col("_start").isNotNull() | tag), 1).otherwise(0)).over(by_file.rowsBetween(W.unboundedPreceding, W.currentRow))
    typed = F.max(F.when((F.col("_depth") == 0) & tag & F.col("_start").isNull(), 1).otherwise(0)).over(W.partitionBy("file", "_group"))
    return (
        marked.withColumn("_group", group)
        .withColumn("_type", typed)
        .select("file", "line", "context", "code", F.when(F.col("_type") == 1, "<global>").otherwise(scope).alias("scope"), F.col("_start").isNotNull().alias("header"))
    )


def symbols(lines: DataFrame) -> DataFrame:
    """(file, symbol, line, context) of all lines with an identifier."""
    return lines.where(F.col("code").rlike(X.IDENTIFIER)).select(
        X.normalize_path(F.col("file")).alias("file"), F.col("scope").alias("symbol"), "line", F.trim("context").alias("context")
    )


def function_definitions(lines: DataFrame) -> DataFrame:
    """(file, symbol, line, context, kind) of all function headers."""
    return lines.where("header").select(
        X.normalize_path(F.col("file")).alias("file"), F.col("scope").alias("symbol"), "line", F.trim("context").alias("context"), F.lit("function").alias("kind")
    )


def definitions(lines: DataFrame) -> DataFrame:
    """(file, symbol, line, context, kind): function headers, and the macros and types that global lines define."""
    code = F.trim("code")
    what = F.coalesce(X.global_definition(code), X.symbol_in_context(code))
    other = (
        lines.where("scope = '<global>'")
        .withColumn("_d", what)
        .where(F.col("_d").isNotNull() & (F.col("_d.kind") != "function"))
        .select(X.normalize_path(F.col("file")).alias("file"), F.col("_d.name").alias("symbol"), "line", F.trim("context").alias("context"), F.col("_d.kind").alias("kind"))
    )
    return function_definitions(lines).unionByName(other)


def call_sites(lines: DataFrame) -> DataFrame:
    """(file, caller, line, place, context, callee): every call of a function body, keywords left out;
    place tells the calls of a line apart."""
    found = X.all_callees(F.col("code"))
    names = F.when(F.col("header"), F.filter(found, lambda x: x != F.col("scope"))).otherwise(found)
    return lines.where("scope <> '<global>'").select(
        X.normalize_path(F.col("file")).alias("file"), F.col("scope").alias("caller"), "line", F.trim("context").alias("context"), F.posexplode(names).alias("place", "callee")
    )
