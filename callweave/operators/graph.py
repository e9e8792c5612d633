"""Recursive operators over call rows: closure, cones, path counts, levels and orders.

Strict operators give sets and end on cycles. Compat ones keep the multiplicities of the classic
answer, one for each path, and refuse cycles, on which it would never end.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators import hierarchy as H
from callweave.operators.orphans import below
from callweave.operators.relations import functions, leaf_symbols
from callweave.operators.skew import hot_parts, key_counts, salted_join
from callweave.runtime import cut, cut_counting


def _edges(rows: DataFrame) -> DataFrame:
    return H.distinct_edges(rows, "caller", "callee")


def transitive_calls(rows: DataFrame) -> DataFrame:
    """(caller, callee): all pairs joined by one or more calls, once each."""
    return H.reach(_edges(rows)).select(F.col("src").alias("caller"), F.col("dst").alias("callee"))


def dependency_cone(rows: DataFrame, symbol: str, hops: int = 1) -> DataFrame:
    """(symbol): everything the symbol calls directly or not, itself only if it is on a cycle.

    Only what is reachable is followed: each round meets the call rows with the names found last, a
    small set that Spark broadcasts, so the rows are scanned and not shuffled. An unknown symbol has an
    empty cone.
    """
    return _cone(rows.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), symbol, hops)


def callers_transitive(rows: DataFrame, symbol: str, hops: int = 1) -> DataFrame:
    """(symbol): everything that calls the symbol directly or not, itself only if it is on a cycle."""
    return _cone(rows.select(F.col("callee").alias("src"), F.col("caller").alias("dst")), symbol, hops)


def _cone(edges: DataFrame, symbol: str, hops: int) -> DataFrame:
    edges = edges.where("src is not null and dst is not null")
    direct = edges.where(F.col("src") == symbol).select(F.col("dst").alias("name"))
    return below(direct, edges, hops).select(F.col("name").alias("symbol"))


def cone_sizes(rows: DataFrame) -> DataFrame:
    """(symbol, n_symbols): the size of each caller's cone."""
    return transitive_calls(rows).groupBy(F.col("caller").alias("symbol")).agg(F.count(F.lit(1)).alias("n_symbols"))


def path_counts(rows: DataFrame, max_depth: int | None = None, caller: str | None = None) -> DataFrame:
    """(caller, callee, n_paths): how many paths join a pair, repeated call rows counting each.

    With caller only its own pairs, found from it alone. Raises on cycles, or on those that the caller
    reaches, and on paths of more than max_depth edges if that is given. Counts are 64-bit; an overflow
    is an error.
    """
    if caller is not None:
        inside = dependency_cone(rows, caller).select(F.col("symbol").alias("_i"))
        mine = rows.where((F.col("caller") == caller) & F.col("callee").isNotNull())
        others = rows.where(F.col("caller") != caller).join(inside, F.col("caller") == F.col("_i"), "left_semi")
        rows = mine.unionByName(others)
    edges = cut(
        rows.where("caller is not null and callee is not null")
        .groupBy(F.col("caller").alias("src"), F.col("callee").alias("dst"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if not H.on_cycles(edges.select("src", "dst")).isEmpty():
        raise ValueError("path counts are infinite on cycles")
    front = edges if caller is None else edges.where(F.col("src") == caller)
    known, depth = front, 1
    while True:
        step = edges.select(F.col("src").alias("_m"), F.col("dst").alias("_d"), F.col("n").alias("_k"))
        front = cut(
            front.join(step, F.col("dst") == F.col("_m"))
            .groupBy("src", F.col("_d").alias("dst"))
            .agg(F.sum(F.col("n") * F.col("_k")).alias("n"))
        )
        if front.isEmpty():
            break
        depth += 1
        if max_depth is not None and depth > max_depth:
            raise ValueError("paths of more than max_depth edges")
        known = known.unionByName(front)
    return known.groupBy(F.col("src").alias("caller"), F.col("dst").alias("callee")).agg(F.sum("n").alias("n_paths"))


def dependency_levels(defs: DataFrame, rows: DataFrame) -> DataFrame:
    """(level, symbol): each function once, callees below callers.

    Level 1 are functions without any call row. Any other has one level more than its highest callee
    among the functions, at least 2. Functions on a cycle, recursion included, or above one share a
    last level. Levels are peeled: each round counts, for the callers of the functions found last, how
    many of their callees have a level by now; those that have all get the next one. What is never
    peeled makes up the last level. A round touches the callers of one level, not all functions.
    """
    fs = cut(functions(defs))
    name = fs.select(F.col("symbol").alias("_f"))
    inner, seen = cut_counting(
        _edges(rows)
        .join(name, F.col("src") == F.col("_f"), "left_semi")
        .join(name, F.col("dst") == F.col("_f"), "left_semi"),
        n=F.count(F.lit(1)),
        top=key_counts(F.col("dst")),
    )
    hot = hot_parts(seen["top"], seen["n"])
    leaves = leaf_symbols(defs, rows).select(F.col("symbol").alias("_l"))
    needs = inner.groupBy(F.col("src").alias("_s")).agg(F.count(F.lit(1)).alias("_need"))
    need = cut(
        fs.join(needs, F.col("symbol") == F.col("_s"), "left")
        .join(leaves, F.col("symbol") == F.col("_l"), "left")
        .select("symbol", F.coalesce("_need", F.lit(0)).cast("bigint").alias("need"), F.col("_l").isNotNull().alias("leaf"))
    )
    wanted = need.select(F.col("symbol").alias("_w"), "need")
    front = need.where("leaf").select("symbol")
    levels, done, level = front.withColumn("level", F.lit(1)), front.withColumn("have", F.lit(0).cast("bigint")).limit(0), 1
    outside = need.where("need = 0 and not leaf").select("symbol", F.lit(0).cast("bigint").alias("have"), F.lit(True).alias("all"))
    while True:
        more = salted_join(inner, front.withColumnRenamed("symbol", "dst"), "dst", parts=hot).groupBy("src").agg(F.count(F.lit(1)).alias("have"))
        have = done.unionByName(more.select(F.col("src").alias("symbol"), "have")).groupBy("symbol").agg(F.sum("have").alias("have"))
        state = have.join(wanted, F.col("symbol") == F.col("_w")).select("symbol", "have", (F.col("have") == F.col("need")).alias("all"))
        state, got = cut_counting(state.unionByName(outside) if level == 1 else state, n=F.count_if("all"))
        if not got["n"]:
            break
        level += 1
        front, done = state.where("all").select("symbol"), state.where("not all").select("symbol", "have")
        levels = levels.unionByName(front.withColumn("level", F.lit(level)))
        if level % 32 == 0:
            levels = cut(levels)
    rest = fs.join(levels.select(F.col("symbol").alias("_n")), F.col("symbol") == F.col("_n"), "left_anti").withColumn("level", F.lit(level + 1))
    return levels.unionByName(rest).select(F.col("level").cast("bigint").alias("level"), "symbol")


def conversion_order(levels: DataFrame) -> DataFrame:
    """(level, symbol), leaves first, by name within a level: what can be converted one by one."""
    return levels.orderBy("level", "symbol")


def conversion_order_compat(defs: DataFrame, rows: DataFrame, max_steps: int = 1_000_000, max_edges: int = 1_000_000) -> list[str]:
    """The classic visiting order: roots first, names repeated, callees outside the functions too.

    A queue of names, sorted before each visit, has no parallel form; it runs on the driver and is meant
    for graphs that fit there: more than max_edges call rows or functions are an error before anything is
    collected. Raises after max_steps, as on cycles. conversion_order is the order for graphs of any size.
    """
    if max(rows.count(), defs.count()) > max_edges:
        raise ValueError("more than max_edges call rows or definitions: use conversion_order")
    nodes = {r[0] for r in functions(defs).collect()}
    below_: dict[str, set[str]] = {}
    for a, b in _edges(rows).collect():
        below_.setdefault(a, set()).add(b)
    called = {b for a in nodes for b in below_.get(a, ())}
    queue, out = sorted(nodes - called), []
    while queue:
        if len(out) >= max_steps:
            raise ValueError("no end within max_steps: the graph has a cycle below a root")
        node, rest = queue[0], set(queue[1:])
        if node in nodes:
            rest |= below_.get(node, set()) - {node}
        out.append(node)
        queue = sorted(rest)
    return out


def level_listing(levels: DataFrame, rows: DataFrame) -> DataFrame:
    """(level, symbol, ord, callee): a row for each call of each function, ord giving their order; a
    function without calls has one row with nulls."""
    called = rows.where("caller is not null and callee is not null").select("caller", "ord", "callee")
    lone = levels.join(called.select(F.col("caller").alias("_c")), F.col("symbol") == F.col("_c"), "left_anti")
    listed = salted_join(called.withColumnRenamed("caller", "symbol"), levels, "symbol").select("level", "symbol", "ord", "callee")
    empty = lone.select("level", "symbol", F.lit(None).cast("bigint").alias("ord"), F.lit(None).cast("string").alias("callee"))
    return listed.unionByName(empty)


def format_level(listing: DataFrame, level: int) -> str:
    """One level as text, as it is printed: callees joined in the order of their rows."""
    return _text(listing.where(F.col("level") == level).orderBy("symbol", "ord").toLocalIterator(), level)


def _text(rows: Iterable, level: int) -> str:
    lines: list[str] = []
    for symbol, own in itertools.groupby(rows, key=lambda r: r["symbol"]):
        callees = [r["callee"] for r in own if r["callee"] is not None]
        lines.append(symbol + (f" -> {', '.join(callees)}" if callees else ""))
    if not lines:
        return f"Level {level} does not exist\n"
    if level == 1:
        return f"Level 1 (Leaves):\n  [{','.join(lines)}]\n"
    return f"Level {level}:\n" + "".join(f"  {x}\n" for x in lines)


def format_all_levels(listing: DataFrame) -> str:
    """All levels as text, the highest first, in one pass."""
    rows = listing.orderBy(F.desc("level"), "symbol", "ord").toLocalIterator()
    return "\n".join(_text(own, k) for k, own in itertools.groupby(rows, key=lambda r: r["level"])) + "\n"
