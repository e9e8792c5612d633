"""Lines that can't become typed rows, set apart with the reason.

A line holds file, symbol, line and context, parted by one tab each, with an optional line end.
Structural checks look at each line; the values of the typed columns are checked and cast once for
each distinct value, and the dictionary of typed values and reasons is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.operators.skew import checked_join
from callweave.runtime import cut, cut_counting

# The file name endings of a source file, in any letter case.
SOURCE_ENDINGS = (".c", ".h", ".cpp", ".hpp", ".cc", ".hh")

# Reasons in the order in which the first that applies is given.
STRUCTURAL = ("null line", "nul character", "line break inside", "broken quoting", "wrong column count")


def _body(raw: Column) -> Column:
    """The line without its one line end."""
    return F.regexp_replace(raw, r"(?:\r\n|\n\r|\n|\r)\z", "")


# One field. Possessive repeats make the match linear and free of recursion on texts of any length.
_FIELD = r'(?:"(?:[^"\r\n\x00]|"")*+"|[^"\t\r\n\x00]*+)'
QUOTED = rf"\A{_FIELD}(?:\t{_FIELD})*+\z"
FOUR = rf"\A({_FIELD})\t({_FIELD})\t({_FIELD})\t({_FIELD})\z"


def split_fields(body: Column) -> tuple[Column, Column]:
    """Whether the quoting of a line holds, and its fields with quoting undone if there are four.

    Of a line with quotes and another number of fields the second is an array of another length.
    """
    quotes = F.contains(body, F.lit('"'))
    ok = ~quotes | body.rlike(QUOTED)

    def unquoted(f: Column) -> Column:
        return F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)

    each = F.transform(F.array(*[F.regexp_extract(body, FOUR, n) for n in (1, 2, 3, 4)]), unquoted)
    four = F.when(body.rlike(FOUR), each).otherwise(F.array().cast("array<string>"))
    return ok, F.when(quotes, four).otherwise(F.split(body, "\t", -1))


def bad_line_number(value: Column) -> Column:
    """Why a value isn't a line number, or null."""
    return (
        F.when(~value.rlike(r"\A[0-9]+\z"), F.lit("line isn't digits"))
        .when(value.try_cast("bigint").isNull(), F.lit("line out of range"))
        .otherwise(F.lit(None).cast("string"))
    )


def bad_file(value: Column) -> Column:
    """Why a value isn't the path of a source file, or null."""
    lowered = F.lower(value)
    ends = lowered.endswith(SOURCE_ENDINGS[0])
    for ending in SOURCE_ENDINGS[1:]:
        ends = ends | lowered.endswith(ending)
    return (
        F.when(value.rlike(r"\A\s*\z"), F.lit("blank file"))
        .when(~ends, F.lit("not a source file"))
        .otherwise(F.lit(None).cast("string"))
    )


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """The rows with further columns that are computed once for each row, however often they are
    used: a generator of one row keeps the optimizer from copying their expressions."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _split(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """(_key, _why, _file, _symbol, _line, _context): the structural reason, or four untyped fields."""
    base = _once(rows.select(F.col(key).alias("_key"), F.col(raw).alias("_raw")), _body=_body(F.col("_raw"))).drop("_raw")
    ok, fields = split_fields(F.col("_body"))
    split = _once(base, _ok=ok, _s=fields)
    structural = (
        F.when(F.col("_body").isNull(), STRUCTURAL[0])
        .when(F.contains(F.col("_body"), F.lit("\x00")), STRUCTURAL[1])
        .when(F.col("_body").rlike(r"[\r\n]"), STRUCTURAL[2])
        .when(~F.col("_ok"), STRUCTURAL[3])
        .when(F.size("_s") != 4, STRUCTURAL[4])
    )
    fields = F.when(F.col("_why").isNull(), F.col("_s"))
    return _once(split, _why=structural).select(
        "_key", "_why", *[fields[i].alias(n) for i, n in enumerate(("_file", "_symbol", "_line", "_context"))]
    )


def value_dictionary(fields: DataFrame) -> DataFrame:
    """(col, value, number, reason): each distinct file and line value once, with its typed value or
    the reason why it has none."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"_{c}").alias("value")) for c in ("file", "line")])
    values = fields.select(F.inline(pairs)).distinct()
    reason = F.when(F.col("col") == "file", bad_file(F.col("value"))).otherwise(bad_line_number(F.col("value")))
    return values.select("col", "value", F.when(F.col("col") == "line", F.col("value").try_cast("bigint")).alias("number"), reason.alias("reason"))


def parse_with_reasons(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, reason, file, symbol, line, context): one row for each input row, repeated rows included.

    reason is null for a valid row, which has typed fields; a rejected row has a reason and null
    fields. Null raw is rejected. Of several faults, structural ones come first, then the file, then
    the line number. Other columns of the input are left out; an empty input gives no rows. Lines are
    parsed once and kept; rows that fail by structure take no part in the joins with the dictionary,
    which is broadcast only up to a counted size; beyond it, values that most rows have are salted.
    """
    return _resolved(cut(_split(rows, key, raw)), key)


def reject_reasons(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, reason) of the rejected rows alone: as parse_with_reasons, without carrying the other fields."""
    parsed = _split(rows, key, raw).select("_key", "_why", "_file", F.lit(None).cast("string").alias("_symbol"), "_line", F.lit(None).cast("string").alias("_context"))
    return _resolved(cut(parsed), key).where(F.col("reason").isNotNull()).select(key, "reason")


def _resolved(parsed: DataFrame, key: str) -> DataFrame:
    whole = parsed.where(F.col("_why").isNull()).drop("_why")
    cost = F.octet_length("value") + 64  # bytes, with what a row takes besides
    each = {c: F.coalesce(F.sum(F.when(F.col("col") == c, cost)), F.lit(0)) for c in ("file", "line")}
    words, size = cut_counting(value_dictionary(whole), **each)
    files = words.where(F.col("col") == "file").select(F.col("value").alias("_file"), F.col("reason").alias("_bad_file"))
    numbers = words.where(F.col("col") == "line").select(F.col("value").alias("_line"), "number", F.col("reason").alias("_bad_line"))
    joined = checked_join(checked_join(whole, files, "_file", size["file"]), numbers, "_line", size["line"])
    why = F.coalesce("_bad_file", "_bad_line")
    typed = {"file": F.col("_file"), "symbol": F.col("_symbol"), "line": F.col("number"), "context": F.col("_context")}
    valued = joined.select(F.col("_key").alias(key), why.alias("reason"), *[F.when(why.isNull(), c).alias(n) for n, c in typed.items()])
    empty = [F.lit(None).cast("bigint" if n == "line" else "string").alias(n) for n in typed]
    return valued.unionByName(parsed.where(F.col("_why").isNotNull()).select(F.col("_key").alias(key), F.col("_why").alias("reason"), *empty))
