"""Held-out test items that appear, whole or in part, inside corpus documents: greedy string tiling.

Words are compared, without regard to letter case, punctuation, spacing or Unicode presentation.
Every run of min_match words of an item is a seed. Documents are read for seeds by a rolling hash over
a whole batch; a Bloom filter of the item seeds, of bounded size, lets only those on that an item is
likely to have. The few that are left meet the items in a join, in which seeds that very many documents
share are salted. Where a document shares one with an item, running Karp-Rabin greedy string tiling
marks the longest matches first, none of which overlap, so that passages in another order are covered
too. Documents are read once; only the texts of those with a likely seed are kept and shuffled, once each.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.text import spread, words
from callweave.operators.skew import salted_join
from callweave.runtime import cut

# Ids travel as text, so that a null among them doesn't turn the others into floating-point numbers.
SCHEMA = "doc_id string, item_id string, tiles int, longest int, covered int, item_words int"
_BASE = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier, arithmetic modulo 2^64
#: Bytes of a piece of the filter, as the built-in bitmaps have them, and the most bits of it (64 MB).
PIECE, MAX_BITS = 4096, 29


def tile(doc: list, item: list, min_match: int) -> list[tuple[int, int, int]]:
    """(place in item, place in document, length) of non-overlapping common runs, longest first.

    Running Karp-Rabin: windows of the search length are looked up by hash value; the search length
    halves until min_match, and begins anew when a much longer match comes up.
    """
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    search = max(min_match, min(len(doc), len(item), 64))
    while True:
        longest, matches = _scan(doc, item, free_d, free_i, search)
        if longest > 2 * search:
            search = longest
            continue
        for n in sorted(matches, reverse=True):
            for i, d in matches[n]:
                k = 0
                while k < n and free_i[i + k] and free_d[d + k]:
                    k += 1
                if k == n:
                    free_i[i : i + n] = False
                    free_d[d : d + n] = False
                    out.append((i, d, n))
                elif k >= search:  # what is left of a partly taken match
                    free_i[i : i + k] = False
                    free_d[d : d + k] = False
                    out.append((i, d, k))
        if search == min_match and not matches:
            return out
        if search > min_match:
            search = max(min_match, search // 2)
        elif not any(n >= min_match for n in matches):
            return out


def _scan(doc: list, item: list, free_d: np.ndarray, free_i: np.ndarray, s: int) -> tuple[int, dict[int, list[tuple[int, int]]]]:
    def windows(seq: list, free: np.ndarray) -> Iterator[tuple[int, int]]:
        run, value, power = 0, 0, pow(1_000_003, s - 1, 1 << 61)
        for p, x in enumerate(seq):
            if not free[p]:
                run, value = 0, 0
                continue
            if run >= s:
                value -= hash(seq[p - s]) * power
            value = (value * 1_000_003 + hash(x)) % (1 << 61)
            run += 1
            if run >= s:
                yield p - s + 1, value

    places: dict[int, list[int]] = defaultdict(list)
    for p, h in windows(doc, free_d):
        places[h].append(p)
    longest, matches, done = 0, defaultdict(list), set()
    for i, h in windows(item, free_i):
        for d in places.get(h, ()):
            if (i - d, i) in done or doc[d : d + s] != item[i : i + s]:
                continue
            k = s
            while i + k < len(item) and d + k < len(doc) and free_i[i + k] and free_d[d + k] and item[i + k] == doc[d + k]:
                k += 1
            done.update((i - d, i + j) for j in range(k - s + 1))  # windows inside this match
            matches[k].append((i, d))
            longest = max(longest, k)
    return longest, dict(matches)


_WORDS: dict[str, int] = {}


def _numbers(words_: list[str]) -> list[int]:
    """64-bit hashes of words, remembered by the worker."""
    out = []
    for w in words_:
        h = _WORDS.get(w)
        if h is None:
            if len(_WORDS) > 500_000:
                _WORDS.clear()
            h = _WORDS[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return out


def seeds_of(texts: list[list[str]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, hash) of every window of k words, over a whole batch at once."""
    lengths = np.array([len(t) for t in texts], np.int64)
    total = int(lengths.sum())
    n = total - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    u = np.fromiter((h for t in texts for h in _numbers(t)), np.uint64, total)
    owner = np.repeat(np.arange(len(texts)), lengths)
    value = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            value = value * _BASE + (u[j : j + n] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            value ^= value >> np.uint64(29)
    whole = owner[:n] == owner[k - 1 :]
    return owner[:n][whole], value[whole]


def _places(seed: np.ndarray, bits: int) -> list[np.ndarray]:
    """The four places of each seed in a filter of 2^bits bits."""
    odd = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
    return [(seed * np.uint64(m)) >> np.uint64(64 - bits) for m in odd]


class Filter:
    """A Bloom filter of four places a seed and at most 2^MAX_BITS bits."""

    def __init__(self, bits: int, pieces: list[tuple[int, bytes]]):
        self.bits, self.bytes = bits, np.zeros(max(1 << (bits - 3), PIECE), np.uint8)
        for number, piece in pieces:
            self.bytes[number * PIECE : (number + 1) * PIECE] = np.frombuffer(piece, np.uint8)

    def may_hold(self, seed: np.ndarray) -> np.ndarray:
        ok = np.ones(len(seed), bool)
        for at in _places(seed, self.bits):
            ok &= (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok


def _filter(of_items: DataFrame) -> Filter:
    """The filter of all item seeds, put together on the executors in pieces of 4 KB. Of more seeds than it
    is made for it lets more by, and no result changes."""
    n = of_items.count()
    bits = min(MAX_BITS, max(15, math.ceil(math.log2(max(n, 1) * 64))))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.concatenate(_places(b["seed"].to_numpy().astype(np.uint64), bits))
            yield pd.DataFrame({"at": at.astype(np.int64)})

    # bit positions of the built-in bitmaps begin at 1
    at = of_items.select("seed").mapInPandas(places, "at bigint").select((F.col("at") + 1).alias("at"))
    pieces = at.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("p")).collect()
    return Filter(bits, [(r["b"] - 1, bytes(r["p"])) for r in pieces])


def _measure(doc: list[str], item: list[str], k: int) -> tuple[int, int, int, int] | None:
    tiles = tile(doc, item, k)
    if not tiles:
        return None
    return len(tiles), max(n for _, _, n in tiles), sum(n for _, _, n in tiles), len(item)


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    min_match: int = 12,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, tiles, longest, covered, item_words): pairs with a common run of min_match words.

    tiles counts the marked matches, longest and covered count words of the item. Null and empty
    texts, and texts of fewer than min_match words, share nothing. Rows of documents that come twice
    give their pairs twice, and a null doc_id stays; an item id must be unique, items without one are left out.
    """
    docs = documents.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    its = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("item_text")).where(F.length("item_text") > 0)
    of_items = cut(_seed_rows(its, "item_id", "item_text", min_match))
    known = docs.sparkSession.sparkContext.broadcast(_filter(of_items))

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, seed = seeds_of([words(t) for t in b["text"]], min_match)
            ok = known.value.may_hold(seed)
            if ok.any():
                at, seed = at[ok], seed[ok].astype(np.int64)
                own = np.unique(at)
                cuts = np.searchsorted(at, own[1:])
                yield b.iloc[own].assign(seeds=[np.unique(x) for x in np.split(seed, cuts)])

    some = cut(spread(docs).mapInPandas(likely, "doc_id string, text string, seeds array<bigint>")).withColumn("_row", F.monotonically_increasing_id())
    pairs = salted_join(some.select("_row", F.explode("seeds").alias("seed")), of_items, "seed").select("_row", "item_id").distinct()
    with_item = salted_join(cut(pairs), its, "item_id")

    def measure(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(theirs):
            doc, d = words(mine["text"].iloc[0]), mine["doc_id"].iloc[0]
            for i, t in zip(theirs["item_id"].tolist(), theirs["item_text"].tolist(), strict=True):
                if m := _measure(doc, words(t), min_match):
                    out.append((d, i, *m))
        return pd.DataFrame(out, columns=["doc_id", "item_id", "tiles", "longest", "covered", "item_words"])

    # tiling takes time rather than bytes: a stated number of partitions isn't put together again
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine, theirs = some.select("_row", "doc_id", "text").repartition(parts, "_row"), with_item.repartition(parts, "_row")
    found = mine.groupBy("_row").cogroup(theirs.groupBy("_row")).applyInPandas(measure, SCHEMA)
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("doc_id", "item_id")})


def _seed_rows(rows: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, seed): each seed of a text once."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, seed = seeds_of([words(t) for t in b[text]], k)
            if len(seed):
                yield pd.DataFrame({key: b[key].to_numpy()[at], "seed": seed.astype(np.int64)}).drop_duplicates()

    return rows.select(key, text).mapInPandas(emit, f"{key} string, seed bigint")


def report_items(leaks: DataFrame, items: DataFrame, coverage: float = 0.5) -> DataFrame:
    """(item_id, n_docs, n_covering, longest, best_coverage): a row for each item, leaked or not.

    n_covering counts documents that cover at least the given share of the item's words.
    """
    share = F.col("covered") / F.col("item_words")
    per = leaks.groupBy(F.col("item_id").alias("_i")).agg(
        F.countDistinct("doc_id").alias("n_docs"),
        F.count_distinct(F.when(share >= coverage, F.col("doc_id"))).alias("n_covering"),
        F.max("longest").alias("longest"),
        F.round(F.max(share), 6).alias("best_coverage"),
    )
    zero = lambda c, t: F.coalesce(c, F.lit(0)).cast(t).alias(c)
    return items.join(per, F.col("item_id") == F.col("_i"), "left").select(
        "item_id", zero("n_docs", "bigint"), zero("n_covering", "bigint"), zero("longest", "bigint"), zero("best_coverage", "double")
    )
