"""Text sources: lines with ordinals, source trees, and the importers of tab-separated listings."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import text as X
from callweave.runtime import after_counts

# Endings of source files, in any letter case, and those that the plain listing takes.
SOURCE_GLOB = "*.{[cC],[hH],[cC][pP][pP],[hH][pP][pP],[cC][cC],[hH][hH]}"
PLAIN_GLOB = "*.{c,h,cpp,hpp}"


def ordered_lines(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """(ord, raw): lines of a text file or folder, numbered from first by file, place and line.

    Splits at LF only. A file of any size is read in blocks: the lines of each block are counted, and
    numbered from the sum of the counts before. A missing path gives no rows.
    """
    try:
        lines = spark.read.option("lineSep", "\n").text(path).select(
            F.col("value").alias("raw"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_at")
        )
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "ord bigint, raw string")
    return after_counts(lines.withColumn("_id", F.monotonically_increasing_id()), first, ("_f", "_at"))


def source_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(file, text) of all C and C++ sources below a folder, endings in any letter case.

    file is the path relative to the folder. Not recursive: only the folder itself, lower-case endings
    of C and C++ without .cc and .hh, and no hidden files, as the plain listing has it.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().getRawPath().rstrip("/") + "/"
    read = spark.read.option("pathGlobFilter", SOURCE_GLOB if recursive else PLAIN_GLOB).option("recursiveFileLookup", str(recursive).lower())
    files = read.schema("value string").text(folder, wholetext=True)
    raw = F.split(F.col("_metadata.file_path"), re.escape(root), 2)[1]
    name = F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    found = files.select(name.alias("file"), F.col("value").alias("text"))
    return found if recursive else found.where(~F.contains("file", F.lit("/")) & ~F.startswith("file", F.lit(".")))


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines of a text file; 0 if it can't be read."""
    try:
        return spark.read.text(path).count()
    except AnalysisException:
        return 0


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((ord, file, symbol, line, context), (ord, raw)): good lines and rejects. Null lines are rejects.

    A line number beyond 64 bits is a reject too.
    """
    ok = X.is_line(F.col("raw")) & X.line_field(F.col("raw"), 3).try_cast("bigint").isNotNull()
    good = lines.where(ok).select(
        "ord",
        X.normalize_path(X.line_field(F.col("raw"), 1)).alias("file"),
        X.line_field(F.col("raw"), 2).alias("symbol"),
        X.line_field(F.col("raw"), 3).try_cast("bigint").alias("line"),
        X.line_field(F.col("raw"), 4).alias("context"),
    )
    return good, lines.where(~ok)


def import_symbols(lines: DataFrame) -> DataFrame:
    return parsed(lines)[0]


def import_defs(lines: DataFrame) -> DataFrame:
    """Definitions with the kind told by their text."""
    return parsed(lines)[0].withColumn("kind", X.infer_kind(F.col("context")))


def import_calls(lines: DataFrame, mode: str = "compat") -> DataFrame:
    """Call sites. compat: one row a line, its callee the first identifier before a parenthesis;
    strict: a row for each callee that isn't a keyword, or one with unknown; listed: the callee is a fifth
    field, as extracted listings have it, and lines without one have unknown."""
    rows = parsed(lines)[0].withColumnRenamed("symbol", "caller")
    if mode == "compat":
        return rows.withColumn("callee", X.first_callee(F.col("context")))
    if mode == "listed":
        five = F.contains("context", F.lit("\t"))
        return rows.withColumn("callee", F.when(five, F.substring_index("context", "\t", -1)).otherwise("unknown")).withColumn(
            "context", F.when(five, F.regexp_replace("context", r"\t[^\t]*\z", "")).otherwise(F.col("context"))
        )
    if mode != "strict":
        raise ValueError("mode is compat, strict or listed")
    found = X.all_callees(F.col("context"))
    one = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))
    return rows.withColumn("callee", F.explode(one))


def line_fields(lines: DataFrame) -> DataFrame:
    """(ord, file, symbol, line, context) of lines of four fields, none of which is checked or changed."""
    f = X.line_fields(F.col("raw"))
    return lines.select("ord", f.alias("f")).where(F.col("f").isNotNull()).select("ord", "f.*")


def listed_names(lines: DataFrame) -> DataFrame:
    """(symbol, first_ord): the second field of lines with two tabs or more, but for <global>; the last
    that came up is the first row."""
    name = F.split(F.col("raw"), "\t", 3)
    named = lines.where(F.size(name) == 3).select("ord", name[1].alias("symbol")).where(F.col("symbol") != "<global>")
    return named.groupBy("symbol").agg(F.min("ord").alias("first_ord")).orderBy(F.desc("first_ord"))


def samples(rows: DataFrame, n: int = 5) -> list[dict]:
    """The first rows by ord, for a look at what was read."""
    return [r.asDict() for r in rows.orderBy("ord").limit(n).collect()]


def import_stats(lines: DataFrame, mode: str = "compat") -> DataFrame:
    """(processed, succeeded, failed) in one row; compat counts one more as processed than there are."""
    ok = X.is_line(F.col("raw")) & X.line_field(F.col("raw"), 3).try_cast("bigint").isNotNull()
    return lines.agg(
        (F.count(F.lit(1)) + (1 if mode == "compat" else 0)).alias("processed"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
    )


def stop_on_error(lines: DataFrame, what: str) -> None:
    """Raises with the first rejected line, before anything is written."""
    first = parsed(lines)[1].orderBy("ord").limit(1).collect()
    if first:
        raise ValueError(f"parse_error({what}, {first[0]['ord'] + 1}, {first[0]['raw']!r})")


def error_log(rejects: DataFrame) -> DataFrame:
    """(value): the text of an error log, one entry for each rejected line, in order."""
    entry: Column = F.concat(
        F.lit("Line "), (F.col("ord") + 1).cast("string"), F.lit(": Parse failed\n  Content: "), F.coalesce("raw", F.lit("")), F.lit("\n")
    )
    return rejects.orderBy("ord").select(entry.alias("value"))


def write_error_log(rejects: DataFrame, path: str) -> None:
    """Overwrites the log, as each import does."""
    error_log(rejects).write.mode("overwrite").text(path)


def write_listing(rows: DataFrame, path: str, columns: tuple[str, ...] = ("file", "symbol", "line", "context")) -> None:
    """Tab-separated lines, the form the importers read."""
    rows.select(X.tab_line(*[F.col(c).cast("string") for c in columns]).alias("value")).write.mode("overwrite").text(path)


def reformat_index_lines(lines: DataFrame) -> DataFrame:
    """(ord, value): blank-separated index lines as tab-separated ones; short lines are dropped."""
    f = X.index_line(F.col("raw"))
    return lines.select("ord", f.alias("f")).where(F.col("f").isNotNull()).select("ord", X.tab_line("f.file", "f.scope", "f.line", "f.context").alias("value"))


def reformat_call_lines(lines: DataFrame, caller: Column, keep_callee: bool = False) -> DataFrame:
    """Index lines (ord, raw, ...) of calls: the callee gives way to the caller or becomes a fifth field."""
    fields = ["f.file", "_caller", "f.line", "f.context"] + (["f.scope"] if keep_callee else [])
    split = lines.select("ord", X.index_line(F.col("raw")).alias("f"), caller.alias("_caller")).where(F.col("f").isNotNull())
    return split.select("ord", X.tab_line(*fields).alias("value"))
