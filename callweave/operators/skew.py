"""Results for each key when a few keys hold most of the rows.

A mergeable sketch names the keys that may be heavy, an exact count of those few confirms them.
Rows of heavy keys meet them in a broadcast join, are salted and aggregated in two steps; all other
rows take the ordinary shuffle on the key. No row is dropped, capped or sampled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.runtime import cut


def heavy_hitters(rows: DataFrame, key: str, share: float = 0.03) -> DataFrame:
    """(hot_key, n_rows): each non-null key with at least share of all rows, nulls counted in the total.

    The sketch follows enough keys that no key above the share can be missing among its candidates,
    of which there are at most 4/share; their exact counts decide. An empty table has no heavy key.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    one = rows.select(F.col(key).alias("_k"))
    candidates = _candidates(one, share).select(F.col("item").alias("_c"))
    exact = (
        one.join(F.broadcast(candidates), F.col("_k") == F.col("_c"), "left")
        .groupBy("_c")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    few = exact.agg(F.sum("n").alias("_all"), F.collect_list(F.struct("_c", "n")).alias("_each"))
    return (
        few.select("_all", F.inline("_each"))
        .where(F.col("_c").isNotNull() & (F.col("n") >= F.lit(share) * F.col("_all")))
        .select(F.col("_c").alias("hot_key"), F.col("n").alias("n_rows"))
    )


def _candidates(one: DataFrame, share: float) -> DataFrame:
    """(item, count) of the at most 4/share keys of the column _k that a sketch gives as the most frequent."""
    k = math.ceil(4 / share)
    sketch = one.where(F.col("_k").isNotNull()).agg(F.expr(f"approx_top_k(_k, {k}, {max(10_000, 100 * k)})").alias("top"))
    return sketch.select(F.inline("top"))


def key_counts(key: Column, share: float = 1 / 64) -> Column:
    """An aggregate, such as cut_counting takes, for hot_parts: the most frequent keys by a sketch."""
    k = math.ceil(2 / share)
    return F.call_function("approx_top_k", key, F.lit(k), F.lit(10 * k))


def hot_parts(counts: list | None, total: int | None, share: float = 1 / 64) -> dict:
    """Keys with about share of all rows or more, with the number of parts to split each into."""
    least = share * max(total or 0, 1)
    return {r["item"]: math.ceil(r["count"] / least) for r in counts or [] if r["item"] is not None and r["count"] >= least}


def salted_join(rows: DataFrame, other: DataFrame, key: str, how: str = "inner", share: float = 1 / 64, parts: dict | None = None) -> DataFrame:
    """rows joined with other on a column that both have, for a key that may hold most of the rows.

    A sketch over rows names at most 2/share keys with about share of the rows or more; only these few
    are broadcast, with the number of parts that each is split into. Their rows in other are repeated
    once for each part. other should have few rows a key. how is inner, left or left_semi. Null keys
    match nothing; with left they are kept, and spread. parts hands in hot_parts where the keys were
    counted when rows was written; if there are none it is an ordinary join.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError("how is inner, left or left_semi")
    if parts is not None and not parts:
        return rows.join(other, key, how)
    if parts is not None:
        each = [F.struct(F.lit(k).alias("_hot"), F.lit(n).alias("_parts")) for k, n in parts.items()]
        hot = rows.sparkSession.range(1).select(F.inline(F.array(*each)))
    else:
        sketch = rows.select(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_all"), key_counts(F.col("_k"), share).alias("_top"))
        hot = (
            sketch.select("_all", F.inline("_top"))
            .where(F.col("count") >= F.lit(share) * F.col("_all"))
            .select(F.col("item").alias("_hot"), F.ceil(F.col("count") / (F.lit(share) * F.col("_all"))).cast("int").alias("_parts"))
        )
    hot = F.broadcast(hot)
    spread = F.xxhash64(*rows.columns)
    mine = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.when(F.col(key).isNull(), spread).otherwise(F.pmod(spread, F.coalesce("_parts", F.lit(1))))
    )
    theirs = other.join(hot, F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)).cast("bigint") - 1))
    )
    return mine.drop("_hot", "_parts").join(theirs.drop("_hot", "_parts"), [key, "_salt"], how).drop("_salt")


#: Up to so many bytes a table may be sent to every executor.
BROADCAST_BYTES = 8 << 20


def checked_join(rows: DataFrame, other: DataFrame, key: str, size: int, how: str = "inner") -> DataFrame:
    """rows joined with other, whose size in bytes was counted: broadcast if it is at most BROADCAST_BYTES,
    else by salted_join, with the same result."""
    return rows.join(F.broadcast(other), key, how) if size <= BROADCAST_BYTES else salted_join(rows, other, key, how)


def per_key(
    rows: DataFrame,
    key: str,
    partial: dict[str, Column],
    final: dict[str, Column],
    distinct: str | None = None,
    share: float = 0.03,
    salts: int = 64,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """One row for each key, the null key included, from mergeable aggregates.

    partial names aggregates of rows, final how their columns merge (for a count: sum). distinct
    names a column whose non-null values are counted exactly as n_distinct: its values serve as the
    salt of a heavy key, so that equal values of a key meet, and a hot value is no problem because
    each task first reduces its own rows. Without distinct, heavy keys are salted by a hash of
    the whole row, the null key always. heavy may hand in the result of heavy_hitters; else the
    candidates of the sketch serve, as a key that is salted in vain gives the same result.
    """
    if heavy is None:
        heavy = cut(_candidates(rows.select(F.col(key).alias("_k")), share).select(F.col("item").alias("hot_key")))
    hot = F.broadcast(heavy.select(F.col("hot_key").alias("_hot")))
    is_hot = rows.join(hot, F.col(key) == F.col("_hot"), "left")
    salt_of = F.xxhash64(distinct) if distinct else F.xxhash64(*rows.columns)
    merged = [c.alias(n) for n, c in final.items()]

    def finish(part: DataFrame) -> DataFrame:
        return part.groupBy("_key").agg(*merged, *([F.sum("n_distinct").alias("n_distinct")] if distinct else []))

    def within(part: DataFrame, by: list[str]) -> DataFrame:
        if not distinct:
            return part.groupBy(*by).agg(*[c.alias(n) for n, c in partial.items()])
        values = part.groupBy(*by, F.col(distinct).alias("_value")).agg(*[c.alias(n) for n, c in partial.items()])
        return values.groupBy(*by).agg(*merged, F.count("_value").alias("n_distinct"))

    salted = F.col("_hot").isNotNull() | F.col(key).isNull()
    hot_rows = is_hot.where(salted).withColumn("_key", F.col(key)).withColumn("_salt", F.pmod(salt_of, F.lit(salts)))
    cold_rows = is_hot.where(~salted).withColumn("_key", F.col(key))
    return (
        finish(within(hot_rows, ["_key", "_salt"]))
        .unionByName(within(cold_rows, ["_key"]))
        .withColumnRenamed("_key", "key")
    )
