"""One mixture from several sources near target shares: capped water-filling.

Sizes are tokens of a public tokenizer. A source may occur at most max_repeats times; what a capped
source can't take is spread over the others in proportion to their targets, until all fit. Each
document is then taken a whole number of times plus once more for a seeded part of the documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.text import spread
from callweave.runtime import cut

SLOTS = 65_536


def default_ranks() -> tuple[str, str]:
    """Place and split pattern of the default vocabulary file."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def count_tokens(rows: DataFrame, text: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows with n_tokens; null and empty text has none. The rank file is read by the driver."""
    if ranks is None:
        ranks, pattern = default_ranks()
    with open(ranks, "rb") as f:
        data = rows.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        pairs = (line.split() for line in data.value.splitlines() if line.strip())
        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return rows.withColumn("n_tokens", tokens(F.col(text)))


def water_fill(sizes: dict[str, int], shares: dict[str, float], caps: dict[str, int], total: float) -> dict[str, float]:
    """Tokens for each source: shares of the total, none above size times cap.

    If all caps together hold less than the total, every source is at its cap.
    """
    most = {s: sizes.get(s, 0) * max(caps[s], 0) for s in shares}
    got: dict[str, float] = {}
    open_ = {s for s in shares if shares[s] > 0}
    got |= {s: 0.0 for s in shares if s not in open_}
    left = float(total)
    while open_:
        weight = sum(shares[s] for s in open_)
        over = {s for s in open_ if left * shares[s] / weight >= most[s]}
        if not over:
            return got | {s: left * shares[s] / weight for s in open_}
        got |= {s: float(most[s]) for s in over}
        left = max(0.0, left - sum(most[s] for s in over))
        open_ -= over
    return got


def largest_even_total(sizes: dict[str, int], shares: dict[str, float], caps: dict[str, int]) -> float:
    """The largest size at which all sources that have any tokens get their shares, in proportion to one
    another, without passing a cap. 0 if there is none."""
    have = [s for s in shares if shares[s] > 0 and sizes.get(s, 0) * max(caps[s], 0) > 0]
    return min((sizes[s] * caps[s] / shares[s] for s in have), default=0.0) * sum(shares[s] for s in have)


def normal_source(source: Column) -> Column:
    """Source labels without blanks around them, in lower case."""
    return F.lower(F.trim(source))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, seed: int = 0, ranks: str | None = None, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, report).

    chosen: (doc_id, source, n_tokens, repeats) of every document taken at least once. report:
    (source, target_share, max_repeats, available_tokens, epochs, mixture_tokens, actual_share) with
    a row for each target. total_tokens is the wanted size, by default all tokens of the target
    sources, at which small sources stay at their cap and below their share; "even" takes the largest
    size at which none does. Documents with a null source, or one without a target, aren't taken. The part of a
    source that is taken once more is set by a hash of doc_id and seed; the cut lies where the
    counted tokens come nearest, in 1/65536 of the source. Targets must be few enough to plan on the
    driver; documents stay on the executors. Rows that repeat a doc_id are taken alike.
    """
    plan = {r["source"]: r for r in targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").collect()}
    slot = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SLOTS)).cast("int")
    sized = cut(
        count_tokens(spread(documents.select("doc_id", normal_source(F.col("source")).alias("source"), "text")), "text", ranks, pattern)
        .select("doc_id", "source", "n_tokens", slot.alias("_slot"))
        .where(F.col("source").isin(*plan) if plan else F.lit(False))
    )
    sizes = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum("n_tokens")).collect()}
    shares, caps = {s: float(r["target_share"] or 0) for s, r in plan.items()}, {s: int(r["max_repeats"] or 0) for s, r in plan.items()}
    total = sum(sizes.values()) if total_tokens is None else largest_even_total(sizes, shares, caps) if total_tokens == "even" else total_tokens
    got = water_fill(sizes, shares, caps, total)
    epochs = {s: got[s] / sizes[s] if sizes.get(s) else 0.0 for s in plan}
    rows = [(s, int(epochs[s]), (epochs[s] - int(epochs[s])) * sizes.get(s, 0)) for s in plan]
    spark = documents.sparkSession
    whole = spark.createDataFrame(rows, "_s string, _whole int, _part double")
    # tokens by source and slot: at most 65536 rows a source, whatever the number of documents
    from pyspark.sql import Window as W

    by_slot = sized.groupBy("source", "_slot").agg(F.sum("n_tokens").alias("t"))
    upto = by_slot.withColumn("_upto", F.sum("t").over(W.partitionBy("source").orderBy("_slot"))).join(F.broadcast(whole), F.col("source") == F.col("_s"))
    taken = F.col("_upto") - F.col("t") / 2 <= F.col("_part")
    edge = F.broadcast(upto.where(taken & (F.col("_part") > 0)).groupBy(F.col("source").alias("_e")).agg(F.max("_slot").alias("_edge")))
    repeats = F.col("_whole") + F.when(F.col("_slot") <= F.coalesce("_edge", F.lit(-1)), 1).otherwise(0)
    chosen = cut(
        sized.join(F.broadcast(whole), F.col("source") == F.col("_s"))
        .join(edge, F.col("source") == F.col("_e"), "left")
        .select("doc_id", "source", "n_tokens", repeats.cast("int").alias("repeats"))
        .where(F.col("repeats") > 0)
    )
    used = {r[0]: int(r[1]) for r in chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats"))).collect()}
    all_used = sum(used.values())
    report = [
        (s, r["target_share"], r["max_repeats"], sizes.get(s, 0), round(epochs[s], 6), used.get(s, 0), round(used.get(s, 0) / all_used, 6) if all_used else 0.0)
        for s, r in sorted(plan.items())
    ]
    return chosen, spark.createDataFrame(report, "source string, target_share double, max_repeats int, available_tokens bigint, epochs double, mixture_tokens bigint, actual_share double")
